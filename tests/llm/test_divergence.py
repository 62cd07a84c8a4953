"""Source divergence against a plain program in exact integers."""

import random
import re
from collections import Counter, defaultdict

import pytest

from vigilmill.llm import divergence, queries


def by_hand(rows, least=10, top=10):
    documents, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang, source].update(terms)
        documents[lang].update(set(terms))
    found = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in documents[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        n = {s: [counts[lang, s][t] for t in kept] for s in sources}
        p = {s: [1 + 10**9 * (c + 2) // (sum(v) + 2 * len(kept)) for c in v] for s, v in n.items()}
        whole = [sum(v) for v in zip(*n.values())]
        q = [1 + 10**9 * (c + 2) // (sum(whole) + 2 * len(kept)) for c in whole]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(map(f, p[s], p[o]))) for o in sources if o != s]
            terms = [(t, f(a, b)) for t, c, a, b in zip(kept, n[s], p[s], q) if c and a > b]
            for part, items, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
                order = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                found |= {(lang, s, part, t, v, i + 1) for i, (t, v) in enumerate(order)}
    return found


WORDS = "alpha Beta gamma ÉTÉ naïve 中文字 delta-epsilon x1y2z Ω omega a b c d e".split()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    out = []
    for i in range(700):
        lang, source = r.choice(["en", "en", "en", "de", None, ""]), r.choice(["s0"] * 5 + [f"s{j}" for j in range(12)] + [None])
        words = r.choices(WORDS + [f"rare{r.randint(0, 60)}"], weights=[1 + (hash_(w, source) % 9) for w in WORDS] + [2], k=r.randint(0, 40))
        out.append((r.choice([" ", ",", "\n", "\x00"]).join(words) or None, lang, source))
    return out + out[:30] + [("lonely words here", "fr", "one"), (None, "fr", "two"), ("Ab " * 300_000 + "éa " * 10, "en", "long")]


def hash_(*x):
    return sum(map(ord, "".join(map(str, x))))


SCHEMA = "text string, lang string, source string"


def write(spark, rows, folder):
    spark.createDataFrame([(*r, i, 3, "z") for i, r in enumerate(rows)], SCHEMA + ", doc_id bigint, N int, term string").repartition(4).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_as_by_hand(spark, rows, tmp_path):
    found = queries.op12_source_divergence(spark, write(spark, rows, tmp_path)).collect()
    assert {tuple(r) for r in found} == by_hand(rows) and len(found) == len(by_hand(rows))


def test_small_buffers_and_batches(spark, rows, tmp_path, monkeypatch):
    """Runs that go on over buffers, batches and emissions give the same."""
    folder = write(spark, rows, tmp_path)
    small = [spark.read.parquet(f"{folder}/documents.parquet")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = divergence.divergences(small[0], least=4, top=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in found} == by_hand(rows, 4, 3)


def test_scan_emits_before_it_holds_too_much(spark, rows, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "BUFFER_ENTRIES", 7)
    read = [pa.record_batch({"lang": [x[1] or "" for x in rows], "source": [x[2] or "" for x in rows], "text": [(x[0] or "").encode() for x in rows]})]
    runs = pa.Table.from_batches(list(divergence._read(iter(read)))).sort_by([("term", "ascending"), ("lang", "ascending"), ("source", "ascending")])
    merged = pa.Table.from_batches(list(divergence._merge(1)(iter(runs.to_batches(max_chunksize=5))))).to_pylist()
    n, d = Counter(), Counter()
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        for t, c in Counter(terms).items():
            n[lang or "", t, source or ""] += c
            d[lang or "", t, source or ""] += 1
    assert {(r["lang"], r["term"], r["source"]): (r["documents"], r["n"]) for r in merged} == {k: (d[k], n[k]) for k in n}
    table = pa.table({"lang": [r["lang"] for r in merged], "term": [r["term"] for r in merged], "source": [r["source"] for r in merged],
                      "p": [r["n"] * 100 + 1 for r in merged], "p0": [1] * len(merged), "q": [150] * len(merged)})
    table = table.set_column(3, "p", table["p"].cast(pa.int64()))
    whole = pa.Table.from_batches(list(divergence._scan(3)(iter(table.to_batches(max_chunksize=4))))).to_pylist()
    sums, best = Counter(), defaultdict(set)
    for r in whole:
        if r["part"] == "pair":
            sums[r["lang"], r["source"], r["item"]] += r["value"]
        else:
            best[r["lang"], r["source"]].add((-r["value"], r["item"].encode()))
    expected, terms, by_term = Counter(), defaultdict(set), defaultdict(list)
    for r in table.to_pylist():
        by_term[r["lang"], r["term"]].append(r)
        if r["p"] > r["q"]:
            terms[r["lang"], r["source"]].add((-((r["p"] - r["q"]) ** 2 // (r["p"] + r["q"])), r["term"].encode()))
    f = lambda a, b: (a - b) ** 2 // (a + b)
    for run in by_term.values():
        for i, a in enumerate(run):
            for b in run[i + 1 :]:
                expected[a["lang"], a["source"], b["source"]] += f(a["p"], b["p"]) - f(a["p"], 1) - f(1, b["p"])
    assert sums == expected
    assert {k: sorted(v)[:3] for k, v in best.items()} == {k: sorted(v)[:3] for k, v in terms.items()}


def test_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    big = [(10**13 + 7, 3 * 10**13 + 1, 10**6), (0, 10**15, 77), (5, 5, 1), (0, 0, 3), (0, 0, 0)]
    got = spark.createDataFrame(big, "n bigint, total bigint, terms bigint").select(divergence._p(F.col("n"), F.col("total"), F.col("terms"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 2) // (t + 2 * v) if v else 1 for n, t, v in big]


def test_many_sources_meet_in_several_tasks(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES_A_TASK", 5)
    docs = spark.createDataFrame(rows[:200], SCHEMA)
    assert {tuple(r) for r in divergence.divergences(docs).collect()} == by_hand(rows[:200])


def test_corner_rows(spark, corner_dir, corner_rows, empty_dir):
    found = queries.op12_source_divergence(spark, corner_dir).collect()
    assert {tuple(r) for r in found} == by_hand([(t, lang, source) for _, t, lang, source, *_ in corner_rows]) and found
    assert queries.op12_source_divergence(spark, empty_dir).collect() == []


def test_empty(spark):
    assert divergence.divergences(spark.createDataFrame([], SCHEMA)).collect() == []
