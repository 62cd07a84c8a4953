"""Rules learned from attacks as a table of patterns: a gate for proposals, and matching by an index of required letters.

A pattern is read once, by Python's own parser of patterns, which gives what is wrong with it and the runs of letters that every match holds.
Texts meet patterns by an equi join on two words in a row, or one, that such a run holds whole; where a pattern has none, on the rarest three
letters of a run.  Only those pairs are matched, with the pattern as a column.  So ten thousand patterns cost a text one pass for its
words and few searches.

Texts are read as rules read them: readable, in lower case, blanks and line breaks as one blank.  Null texts match nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import pairwise
from re import _constants as C
from re import _parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilmill.functions.nested import held
from vigilmill.functions.normalize import readable_view

MOST_PATTERN, LEAST_LETTERS = 200, 12
#: A bounded repeat of anything this wide counts as unbounded.
WIDE = 200
GRAM = 3
#: Patterns are broadcast up to this many, else joined by a shuffle.
BROADCAST_PATTERNS = 100_000
READ = T.StructType([T.StructField("problem", T.StringType()), T.StructField("letters", T.ArrayType(T.StringType())), T.StructField("key", T.StringType())])

_SPECIFIC = re.compile(r"@|://|www\\?\.|\\?\.(?:com|org|net|io|dev|example|test)\b|[0-9]")
_BOUNDS = re.compile(r"\{[0-9]*,?[0-9]*\}")
_LOOPS = (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT)
_MOST = (C.CATEGORY_NOT_SPACE, C.CATEGORY_NOT_DIGIT, C.CATEGORY_NOT_WORD)
_AROUND = (C.ASSERT, C.ASSERT_NOT, C.GROUPREF, C.GROUPREF_EXISTS, C.ATOMIC_GROUP)


def _parts(op, value) -> list:
    """The sequences inside an item."""
    if op in _LOOPS:
        return [list(value[2])]
    if op is C.SUBPATTERN:
        return [list(value[-1])]
    return [list(b) for b in value[1]] if op is C.BRANCH else []


def _everything(items: list) -> Iterator[tuple]:
    for op, value in items:
        yield op, value
        for part in _parts(op, value):
            yield from _everything(part)


def _broad(items: list) -> bool:
    """Whether one item can stand for almost any character."""
    return any(op is C.ANY or op is C.NOT_LITERAL or op is C.IN and (value[0][0] is C.NEGATE or any(o is C.CATEGORY and v in _MOST for o, v in value)) for op, value in _everything(items))


def _first(items: list) -> set | None:
    """Characters that the items may begin with: a set of letters, None for many."""
    found: set = set()
    for op, value in items:
        if op is C.LITERAL:
            return found | {value}
        if op is C.AT:
            continue
        if op in (C.SUBPATTERN, C.BRANCH) or op in _LOOPS:
            for part in _parts(op, value):
                inner = _first(part)
                if inner is None:
                    return None
                found |= inner
            if op in _LOOPS and value[0] == 0:
                continue
            return found
        return None
    return found


def _loops(items: list, inside: bool = False) -> str | None:
    """What makes a search go back over a text again and again."""
    before: set | None = set()
    for op, value in items:
        if op in _LOOPS:
            low, high, body = value
            body = list(body)
            many = high > 1
            if many and inside:
                return "nested quantifier"
            if many and any(o is C.BRANCH for o, _ in _everything(body)):
                return "repeated alternation"
            if many and any(o in _LOOPS and v[0] == 0 for o, v in _everything(body)):
                return "optional items in a repeated group"
            first = _first(body)
            if many and before != set() and (first is None or before is None or first & before):
                return "adjacent repeats of the same characters"
            if problem := _loops(body, inside or many):
                return problem
            before = (first if many else before) if low == 0 or many else set()
        else:
            for part in _parts(op, value):
                if problem := _loops(part, inside):
                    return problem
            if op is not C.AT:
                before = set()
    return None


def _leads_with_any(items: list) -> bool:
    for op, value in items:
        if op is C.AT:
            continue
        if op in _LOOPS and value[1] > 1 and _broad(list(value[2])):
            return True
        if op in (C.SUBPATTERN, C.BRANCH):
            return any(_leads_with_any(p) for p in _parts(op, value))
        if not (op in _LOOPS and value[0] == 0):
            return False
    return False


def _blank(op, value) -> bool:
    """Whether an item stands for blanks, one at least; in a text as read that is one blank."""
    if op in _LOOPS:
        return value[0] > 0 and len(value[2]) == 1 and _blank(*value[2][0])
    return op is C.LITERAL and value == ord(" ") or op is C.IN and list(value) == [(C.CATEGORY, C.CATEGORY_SPACE)]


def _runs(items: list, blanks: bool = False) -> Iterator[str]:
    """Runs of letters that every match holds as they are, in lower case; with blanks, these are letters too."""
    run: list[str] = []
    for op, value in items:
        if op is C.LITERAL or blanks and _blank(op, value):
            run.append(" " if blanks and _blank(op, value) else chr(value).lower())
            continue
        yield "".join(run)
        run = []
        if op is C.SUBPATTERN or op in _LOOPS and value[0] > 0:
            for part in _parts(op, value):
                yield from _runs(part, blanks)
    yield "".join(run)


@lru_cache(1 << 14)
def read_pattern(pattern: str | None) -> tuple[str | None, tuple[str, ...]]:
    """(what is wrong with a pattern or None, the runs of letters of GRAM or more that each match holds)."""
    if not pattern or not pattern.strip():
        return "empty", ()
    if len(pattern) > MOST_PATTERN:
        return "too long", ()
    try:
        tree = list(_parser.parse(pattern, re.IGNORECASE))
    except (re.error, RecursionError, OverflowError) as e:
        return f"does not compile: {e}", ()
    every = list(_everything(tree))
    if any(op in _AROUND for op, _ in every):
        return "lookaround or backreference", ()
    if problem := _loops(tree):
        return problem, ()
    if sum(op in _LOOPS and value[1] > WIDE and _broad(list(value[2])) for op, value in every) > 1:
        return "several wildcards", ()
    if _leads_with_any(tree):
        return "starts with a wildcard", ()
    if _SPECIFIC.search(_BOUNDS.sub("", pattern)):
        return "names an address, URL, domain or number", ()
    if sum(op is C.LITERAL and chr(value).isalpha() for op, value in every) < LEAST_LETTERS:
        return "too few literal letters", ()
    runs = tuple(dict.fromkeys(r for r in _runs(tree) if len(r) >= GRAM and r.isascii()))
    return (None, runs) if runs else ("no letters that every match holds", ())


@lru_cache(1 << 14)
def key_of(pattern: str) -> str | None:
    """The longest two words in a row between blanks that every match holds, else the longest word, else None."""
    runs = [re.split(r"[^\x00-\x7f]", r) for r in _runs(list(_parser.parse(pattern, re.IGNORECASE)), blanks=True)]
    # What a run begins and ends with may be part of a longer word.
    whole = [piece.split(" ")[1:-1] for pieces in runs for piece in pieces]
    pairs = [f"{a} {b}" for words in whole for a, b in pairwise(words) if a and b]
    return max(pairs or [w for words in whole for w in words if w], key=len, default=None)


@F.pandas_udf(READ)
def _read(patterns: pd.Series) -> pd.DataFrame:
    rows = [read_pattern(p) for p in patterns]
    keys = [None if r[0] else key_of(p) for r, p in zip(rows, patterns)]
    return pd.DataFrame({"problem": [r[0] for r in rows], "letters": [list(r[1]) for r in rows], "key": keys})


def safety(pattern: Column) -> Column:
    """Why a pattern may not be used, null for a good one."""
    return _read(pattern)["problem"]


def as_read(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(readable_view(text)), r"\s+", " "))


def _grams(text: Column) -> Column:
    """Every three characters in a row of a text, each once, in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def _words(text: Column, pairs: bool, single: bool) -> Column:
    """Every two words in a row of a text as read, every word, or both, each once."""
    words = F.split(text, " ")
    two = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, two) if pairs and single else two if pairs else words)


def matches(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (id, rule_id) of texts (id, text) that rules (rule_id, pattern) match; rules that fail the gate's safety match nothing."""
    good = held(rules.select("rule_id", "pattern"), ["rule_id", "pattern"], _r=_read(F.col("pattern"))).where("_r.problem is null")
    # Which ways to find candidates the patterns call for; a way that none does would read all texts for nothing.
    some = good.agg(F.count("*").alias("n"), F.count_if(F.col("_r.key").contains(" ")).alias("pairs"), F.count("_r.key").alias("keys")).first()
    near = F.broadcast if some.n <= BROADCAST_PATTERNS else (lambda df: df)
    read = held(texts.where("text is not null"), ["id"], _text=as_read(F.col("text")))
    hit = F.rlike("_text", F.concat(F.lit("(?i)"), "pattern"))
    ways = []
    if some["keys"] or not some.n:
        keyed = good.where("_r.key is not null").select("rule_id", "pattern", F.col("_r.key").alias("key"))
        listed = held(read, ["id", "_text"], _keys=_words(F.col("_text"), some.pairs > 0, some.pairs < some["keys"])).select("id", "_text", F.explode("_keys").alias("key"))
        ways.append(listed.join(near(keyed), "key").where(hit))
    if some.n > some["keys"]:
        wanted = good.where("_r.key is null").select("rule_id", "pattern", F.explode("_r.letters").alias("run")).select("rule_id", "pattern", F.explode(_grams(F.col("run"))).alias("gram")).distinct()
        listed = read.select("id", "_text", F.explode(_grams(F.col("_text"))).alias("gram"))
        # How many texts have each of the patterns' letters: the rarest of a pattern finds its candidates.
        common = listed.select("gram").join(near(wanted.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("texts"))
        # Letters that no text has are the rarest of all: such a pattern has no candidate.
        rare = wanted.join(common, "gram", "left").groupBy("rule_id", "pattern").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), F.col("gram"))).alias("_g")).select("rule_id", "pattern", "_g.gram")
        ways.append(listed.join(near(rare), "gram").where(hit))
    return reduce(DataFrame.unionByName, [w.select("id", "rule_id") for w in ways]).distinct()


def gate(proposals: DataFrame, benign: DataFrame) -> DataFrame:
    """(rule_id, ok, reason, benign_hits) of proposals (rule_id, pattern, source): safe, matching their own example, and no benign text (id, text)."""
    read = held(proposals.select("rule_id", "pattern", "source"), ["rule_id", "pattern"], problem=safety(F.col("pattern")), _source=as_read(F.coalesce("source", F.lit(""))))
    own = F.when(F.col("problem").isNull(), F.rlike("_source", F.concat(F.lit("(?i)"), "pattern")))
    judged = held(read, ["rule_id", "pattern", "problem"], own=own)
    hits = matches(benign, judged.where("own").select("rule_id", "pattern")).groupBy("rule_id").agg(F.count("*").alias("benign_hits"))
    n = F.coalesce("benign_hits", F.lit(0))
    reason = F.when(F.col("problem").isNotNull(), F.col("problem")).when(~F.col("own"), "does not match its source example").when(n > 0, F.concat(F.lit("matches "), n, F.lit(" benign texts"))).otherwise("")
    return judged.join(hits, "rule_id", "left").select("rule_id", (reason == "").alias("ok"), reason.alias("reason"), n.alias("benign_hits"))
