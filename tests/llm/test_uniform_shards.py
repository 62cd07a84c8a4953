"""The uniform shuffle: exact sizes, gapless slots, and the laws that a uniform shuffle has."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vigilmill.llm import queries
from vigilmill.llm import uniform_shards as shards


def probabilities(total, good, draws):
    return {x: math.comb(good, x) * math.comb(total - good, draws - x) / math.comb(total, draws) for x in range(max(0, draws + good - total), min(draws, good) + 1)}


@pytest.mark.parametrize("total,good,draws", [(10, 4, 5), (50, 45, 20), (7, 7, 3), (9, 0, 4), (400, 60, 200), (1000, 990, 995)])
def test_hypergeometric_law(spark, total, good, draws):
    """Inverting an even grid of u gives each count its probability, up to the grid's step."""
    steps = 4000
    drawn = spark.range(steps).select(shards.hypergeometric(*(F.lit(x).cast("bigint") for x in (total, good, draws)), (F.col("id") + 0.5) / steps).alias("x"))
    found = {r[0]: r[1] / steps for r in drawn.groupBy("x").count().collect()}
    law = probabilities(total, good, draws)
    assert set(found) <= set(law) and all(abs(found.get(x, 0) - p) <= 1.5 / steps for x, p in law.items())


def test_hypergeometric_large(spark):
    """Mean and deviation of draws from 10^11 places; bounds of the support."""
    n = 300
    drawn = spark.range(n).select(shards.hypergeometric(*(F.lit(x).cast("bigint") for x in (10**9, 10**8, 10**6)), shards._uniform(F.col("id"))).alias("x"))
    mean, deviation = drawn.agg(F.avg("x"), F.stddev("x")).first()
    sd = math.sqrt(10**6 * 0.1 * 0.9)
    assert abs(mean - 10**5) < 5 * sd / math.sqrt(n) and 0.8 < deviation / sd < 1.2
    assert spark.range(1).select(shards.hypergeometric(*(F.lit(0).cast("bigint"),) * 3, F.lit(0.5))).first()[0] == 0


@pytest.mark.parametrize("sizes", [[5], [3, 0, 9, 1, 1], [1000, 2, 30, 400, 77, 0, 123], [0, 0, 1], list(range(40))])
def test_matrix_adds_up(spark, sizes):
    parts = spark.createDataFrame([(i, n) for i, n in enumerate(sizes) if n], "part bigint, rows bigint")
    got = sorted(shards.communication_matrix(parts, 8, 3, len(sizes)).collect())
    total = sum(sizes)
    assert [r[0] for r in got] == list(range(len(sizes))) and [sum(r[1]) for r in got] == sizes
    assert [sum(c) for c in zip(*(r[1] for r in got))] == [total // 8 + (j < total % 8) for j in range(8)]
    assert all(x >= 0 for r in got for x in r[1])


def test_matrix_has_the_shuffles_law(spark):
    """Over some seeds, what partition 1 sends to shard 0 has the mean of the hypergeometric law."""
    parts = spark.createDataFrame([(0, 3), (1, 5), (2, 4)], "part bigint, rows bigint")
    n = 16
    sent = [dict(shards.communication_matrix(parts, 3, seed, 3).collect())[1][0] for seed in range(n)]
    sd = math.sqrt(5 * (4 / 12) * (8 / 12) * (7 / 11))
    assert abs(sum(sent) / n - 5 * 4 / 12) < 4 * sd / math.sqrt(n) and len(set(sent)) > 1


def check(rows, n, count=8):
    assert len(rows) == n
    by = {}
    for shard, slot in rows:
        by.setdefault(shard, []).append(slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(count))
    assert [len(by.get(j, [])) for j in range(count)] == [n // count + (j < n % count) for j in range(count)]


def test_query_on_corners(spark, corner_dir, corner_rows, empty_dir):
    found = queries.op13_uniform_shards(spark, corner_dir).collect()
    check([(r["shard"], r["slot"]) for r in found], len(corner_rows))
    text = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((r[0], len(text(r[1])) + 1, zlib.crc32(text(r[1]))) for r in corner_rows)
    assert {(r["law"], r["grown_shard"]) for r in found} == {("rows", None)}
    assert queries.op13_uniform_shards(spark, empty_dir).collect() == []


def test_uniform_over_shards_and_slots(spark, monkeypatch):
    """Every row keeps its columns; where a row goes does not depend on where it stood; several bins a shard."""
    monkeypatch.setattr(shards, "BIN_ROWS", 200)
    n = 8003
    rows = spark.range(n, numPartitions=7).select("id", F.lit(5).alias("Shard"), F.lit("k").alias("key"), F.lit(1).alias("at"), F.lit("b").alias("bin"))
    got = shards.uniform_shards(rows, 8, seed=4).collect()
    check([(r["shard"], r["slot"]) for r in got], n)
    assert sorted(r["id"] for r in got) == list(range(n)) and {(r["key"], r["at"], r["bin"]) for r in got} == {("k", 1, "b")}
    # Chi-square of (stretch of the input, shard): 49 degrees of freedom; of (stretch, stretch of slots) alike.
    for place in (lambda r: r["shard"], lambda r: r["slot"] * 8 // 1001):
        cells = Counter((r["id"] * 8 // n, place(r)) for r in got)
        assert sum((cells[i, j] - n / 64) ** 2 / (n / 64) for i in range(8) for j in range(8)) < 95
    assert {(r["id"], r["shard"], r["slot"]) for r in got} == {(r["id"], r["shard"], r["slot"]) for r in shards.uniform_shards(rows, 8, seed=4).collect()}
    assert {(r["id"], r["shard"], r["slot"]) for r in got} != {(r["id"], r["shard"], r["slot"]) for r in shards.uniform_shards(rows, 8, seed=5).collect()}


def test_fewer_rows_than_shards(spark):
    check([tuple(r) for r in shards.uniform_shards(spark.range(3), 8).select("shard", "slot").collect()], 3)


def test_no_python_in_the_plan(spark, sample_docs):
    plan = shards.uniform_shards(sample_docs.select("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan
