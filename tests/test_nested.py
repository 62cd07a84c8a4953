"""Nested JSON against Python's reader of it."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from vigilmill.functions import nested


def made(r, depth=0):
    kind = r.randrange(8 if depth < 5 else 5)
    if kind >= 5:
        if r.random() < 0.5:
            return {r.choice(["a", "b\n", "é", "c\\", '"q"', "text", "type", "0", "z😀", ""]): made(r, depth + 1) for _ in range(r.randint(0, 4))}
        return [made(r, depth + 1) for _ in range(r.randint(0, 4))]
    return r.choice([None, True, False, r.randint(-(10**9), 10**9), "plain", "x, y|z;", "line\nbreak\t\"quote\" \\ back", "ünï 😀", "", '{"in": [1]}', 0.5, "😀\\"])


@pytest.fixture(scope="module")
def docs():
    r = random.Random(2)
    fixed = [{}, [], "only", 7, None, {"a": {}}, [[], {}], {"a": [{"b": []}, 1]}, ["a", {"text": "b"}, {"text": 3}, ["c", "d"]], {"k": "l\n" * 30_000 + '"' * 20_000 + "\\" * 9000}]
    return fixed + [made(r) for _ in range(150)]


@pytest.fixture(scope="module")
def table(spark, docs):
    return spark.createDataFrame([(i, json.dumps(d, ensure_ascii=i % 2 == 0, indent=[None, 1][i % 3 == 0])) for i, d in enumerate(docs)], "id int, j string").repartition(3)


def lines(d):
    if isinstance(d, dict):
        return [x for k, v in d.items() for x in (k, *lines(v))]
    if isinstance(d, list):
        return [x for v in d for x in lines(v)]
    return [d] if isinstance(d, str) else [str(d)] if isinstance(d, (int, float)) and not isinstance(d, bool) else []


def values(d):
    if isinstance(d, dict):
        return " ".join(map(values, d.values()))
    if isinstance(d, list):
        return "\n".join(map(values, d))
    return d.translate(str.maketrans("|,;", "   ")) if isinstance(d, str) else ""


def canonical(d):
    return json.dumps(d, sort_keys=True, separators=(",", ":"))


def depth(d, at=1):
    children = d.values() if isinstance(d, dict) else d if isinstance(d, list) else ()
    return max([at] + [depth(c, at + 1) for c in children]) if children else at - 1


def test_columns(table, docs):
    found = table.select("id", nested.leaf_text(F.col("j")), nested.values_text(F.col("j")), nested.canonical_json(F.col("j")), nested.stable_hash(F.col("j")), nested.levels(F.col("j"))).collect()
    for i, leaf, value, form, sha, level in found:
        d = docs[i]
        assert leaf == "\n".join(lines(d)), d
        assert value == values(d), d
        assert form == canonical(d) and sha == hashlib.sha256(canonical(d).encode()).hexdigest(), d
        assert level == depth(d), d


def test_rebuilt_from_leaves(table, docs):
    found = dict(nested.rebuilt(nested.leaves(table, "j", "id"), "id").collect())
    assert {i: canonical(json.loads(x)) for i, x in found.items()} == {i: canonical(d) for i, d in enumerate(docs)}
    assert all(x == json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in found.values())


def blocks(d, path=()):
    if isinstance(d, dict):
        return [b for k, v in d.items() for b in blocks(v, (*path, k))]
    if not isinstance(d, list):
        return []
    texts = [t for t in ((x["text"] if isinstance(x, dict) and isinstance(x.get("text"), str) else x) for x in d) if isinstance(t, str)]
    mine = [(".".join(path), " ".join(texts), "".join(texts))] if len(texts) > 1 else []
    return mine + [b for i, v in enumerate(d) for b in blocks(v, (*path, str(i)))]


def test_joined_blocks(table, docs):
    found = sorted(map(tuple, nested.joined_blocks(table, "j", "id").collect()))
    assert found == sorted((i, *b) for i, d in enumerate(docs) for b in blocks(d))


def test_surface(spark):
    df = spark.createDataFrame([(1, '{"b": {"c": ["x", "p  q"]}, "a": 1}'), (2, '{"va\\u200blue": "1", "value": "2"}'), (3, "broken{"), (4, None)], "id int, j string")
    got = dict(nested.argument_surface(df, "j", "id").collect())
    assert got[1] == "a = 1\nb.c.[0] = x\nb.c.[1] = p q" and got[2].count("value = ") == 2 and set(got) == {1, 2}


def test_broken_deep_and_repeated_keys(spark):
    deep = '{"a":' * 40 + "[1]" + "}" * 40
    rows = [(1, "bad{"), (2, None), (3, '{"a":1,"a":2}'), (4, deep), (5, ""), (6, "null")]
    df = spark.createDataFrame(rows, "id int, j string")
    got = {r[0]: tuple(r[1:]) for r in df.select("id", nested.leaf_text(F.col("j")), nested.canonical_json(F.col("j")), nested.stable_hash(F.col("j")), nested.too_deep(F.col("j"), 40)).collect()}
    assert got[1][:3] == ("bad{", None, None) and got[2] == (None,) * 4 and got[3][:2] == ('{"a":1,"a":2}', None) and got[5][:2] == ("", None) and got[6][:2] == ("", "null")
    assert got[4][0] == "\n".join("a" * 40) + "\n1" and got[4][3] is True
    found = nested.leaves(df, "j", "id").collect()
    assert [(r["id"], len(r["path"]), r["kind"]) for r in found] == [(4, 16, "deep"), (6, 0, "null")]
    assert dict(nested.rebuilt(nested.leaves(df, "j", "id"), "id").collect()) == {4: deep, 6: "null"}
    assert spark.range(1).select(nested.too_deep(F.lit("[" * 65 + "0" + "]" * 65)), nested.too_deep(F.lit("[" * 64 + "[]" + "]" * 64))).first() == (True, False)


def test_order_of_keys_and_blanks_do_not_count(spark):
    df = spark.createDataFrame([('{"b":[1,2],"a":"\\u00e9"}', '{ "a" : "é",\n "b" : [1, 2.0] }')], "x string, y string")
    assert df.select(nested.stable_hash(F.col("x")) == nested.stable_hash(F.col("y"))).first()[0]
