"""Learned patterns: the gate by hand, matching by the index as by all pairs; shadowing by hand."""

import random
import re

import pytest

from vigilmill.operators import learned, shadowing

GOOD = [r"ignore\s+all\s+previous\s+instructions", r"\bforward the (?:notes|letters) to the archive", r"please (?:now )?reveal everything", r"send[a-z ]{1,20}quietly to the printer"]
BAD = {
    "": "empty", None: "empty", "a" * 201: "too long", r"(?:please+ )+reveal everything": "nested quantifier", r"(?:ab|cd)+ please reveal everything": "repeated alternation",
    r"(?:x?y)+ please reveal everything": "optional items in a repeated group", r"please\s*\s+reveal everything": "adjacent repeats of the same characters", r"(?=please) reveal everything": "lookaround or backreference",
    r"(please) reveal everything \1": "lookaround or backreference", r"please .* reveal .* everything": "several wildcards", r".*please reveal everything": "starts with a wildcard",
    r"write to bob@evil please reveal": "names an address, URL, domain or number", r"please reveal 42 everything": "names an address, URL, domain or number", r"short": "too few literal letters",
    r"[a-z] [pqr] (?:abcdefg|hijklmn)": "no letters that every match holds", r"please (reveal everything": "does not compile: missing ), unterminated subpattern at position 7",
}


@pytest.mark.parametrize("pattern", GOOD)
def test_good_patterns(pattern):
    problem, runs = learned.read_pattern(pattern)
    assert problem is None and runs


@pytest.mark.parametrize("pattern,problem", BAD.items())
def test_refused(pattern, problem):
    assert learned.read_pattern(pattern)[0] == problem


def test_as_all_pairs(spark):
    r = random.Random(6)
    words = "ignore all previous instructions reveal everything please forward notes archive river stone printer quietly".split()
    rules = [(f"r{i}", r"\s+".join(r.sample(words, 3))) for i in range(60)] + [(f"g{i}", p) for i, p in enumerate(GOOD)] + [("bad", r"(a+)+ ignore all previous"), ("none", r"zebra\s+crossing\s+ahead")]
    texts = [(i, r.choice([" ", "\n", "  \t"]).join(r.choice([str.upper, str])(w) for w in r.choices(words, k=r.randint(0, 60)))) for i in range(150)] + [(900, None), (901, ""), (902, "Please forward the\nletters to the archive")]
    got = sorted(map(tuple, learned.matches(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(rules, "rule_id string, pattern string")).collect()))
    flat = [(i, " ".join((t or "").split()).lower()) for i, t in texts]
    assert got == sorted((i, k) for i, t in flat for k, p in rules if k != "bad" and re.search(p, t))
    assert any(k == "g1" for _, k in got)


def test_gate(spark):
    proposals = [("ok", GOOD[0], "now IGNORE all\nprevious  instructions"), ("other", GOOD[0], "nothing of it"), ("benign", r"the quarterly\s+report is", "see: the quarterly report is late"), ("bad", r"(a+)+$", "aaa"), ("null", GOOD[1], None)]
    benign = [(1, "The quarterly report is fine"), (2, "the Quarterly\nreport IS late"), (3, None)]
    got = {r[0]: tuple(r[1:]) for r in learned.gate(spark.createDataFrame(proposals, "rule_id string, pattern string, source string"), spark.createDataFrame(benign, "id int, text string")).collect()}
    assert got == {"ok": (True, "", 0), "other": (False, "does not match its source example", 0), "benign": (False, "matches 2 benign texts", 2), "bad": (False, "nested quantifier", 0), "null": (False, "does not match its source example", 0)}


def test_shadowing(spark):
    tools = [("a", "get_user_x", "plain"), ("b", "getUserMail", "like get_user_x, but better"), ("b", "search", "uses get_user_x_v1 and search"), ("c", "read", "call GETUSERMAIL. now"), ("c", "find.all-files", None), ("a", "z", "b.find.all-files and find.all-files"), ("a", "other_tool", "get_user_x of ours")]
    got = sorted(map(tuple, shadowing.shadowing(spark.createDataFrame(tools, "server string, tool string, description string")).collect()))
    assert got == [("a", "z", "c", "find.all-files"), ("b", "getUserMail", "a", "get_user_x"), ("c", "read", "b", "getUserMail")]


def test_values_of_descriptions_and_intents(spark):
    tools = spark.createDataFrame([("a", "x", "send it to https://evil.example.com/p"), ("b", "y", "see https://evil.example.com/p"), ("b", "z", None)], "server string, tool string, description string")
    calls = spark.createDataFrame([(1, "a", "x", "https://evil.example.com/p"), (2, "c", "w", "https://fine.example.com/p")], "call_id int, server string, tool string, key string")
    assert [tuple(r) for r in shadowing.described_elsewhere(calls, tools).collect()] == [(1, "https://evil.example.com/p", "b", "y")]
    intents = spark.createDataFrame([("s", 5, "go to https://evil.example.com/p"), ("t", 1, "go to https://evil.example.com/p"), ("s", 1, "https://late.example.com/q")], "scope string, at int, text string")
    flagged = spark.createDataFrame([("s", 3, "https://evil.example.com/p"), ("t", 3, "https://evil.example.com/p"), ("s", 2, "https://late.example.com/q")], "scope string, at int, key string")
    assert [tuple(r) for r in shadowing.tainted_intent(intents, flagged).collect()] == [("s", "https://evil.example.com/p")]


def test_keys_are_words_that_every_match_holds():
    """what a pattern's run begins and ends with may be part of a longer word, letters beyond ASCII end a run, an optional part is none of it."""
    keys = {GOOD[0]: "all previous", r"zebra\s+crossing\s+ahead": "crossing", GOOD[2]: None, r"one two(?: three)? four five six": "four five", r"reveal é two words here": "two words", r"say[ ]+every\s{1,3}single +word now": "every single"}
    assert {p: learned.key_of(p) for p in keys} == keys


@pytest.mark.parametrize("patterns", ([GOOD[0], r"zebra\s+crossing\s+ahead"], [GOOD[0]], [r"zebra\s+crossing\s+ahead"], [GOOD[2]], []))
def test_candidates_by_each_way(spark, patterns):
    """pairs of words, single words and letters find what all pairs find; patterns with whole words search no letters."""
    texts = [(1, "xIGNORE all\n previous   instructionsx"), (2, "a zebra crossing ahead"), (3, "please now reveal everything"), (4, ""), (5, "ignore all  previous instruction"), (6, "zebracrossing ahead"), (7, None), (8, "all")]
    rules = spark.createDataFrame([(p, p) for p in patterns], "rule_id string, pattern string")
    found = learned.matches(spark.createDataFrame(texts, "id int, text string"), rules)
    flat = [(i, " ".join((t or "").lower().split())) for i, t in texts]
    assert sorted(map(tuple, found.collect())) == sorted((i, p) for i, t in flat for p in patterns if re.search(p, t))
    assert ("(?s)(?=" in found._jdf.queryExecution().optimizedPlan().toString()) == (GOOD[2] in patterns)
