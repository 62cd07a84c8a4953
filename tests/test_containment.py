"""Containment of word 3-grams: both directions and anchors from one reading of the texts."""

import pytest
from pyspark.sql import functions as F

from vigilmill.operators import similarity as sim


@pytest.fixture(scope="module")
def sides(spark):
    prints = spark.createDataFrame(
        [(1, "a b c d e f".split(), "a b c d".split()), (2, "a b c".split(), []), (3, "x y".split(), "x y".split()), (4, [], []), (5, "a b c d e f".split(), "q r s".split()), (6, "a b c d e f".split(), None)],
        "print_id int, words array<string>, anchor array<string>",
    )
    texts = spark.createDataFrame([(10, "z a b c d e f z".split()), (11, "a b c".split()), (12, "x y".split()), (13, []), (14, None), (15, "c d e f a b c a b c".split())], "text_id int, words array<string>")
    return prints, texts


def _scores(df):
    return {(r.print_id, r.text_id): round(r.score, 6) for r in df.collect()}


def test_scores_by_hand(sides):
    prints, texts = sides
    words = prints.select("print_id", "words")
    whole = {(p, 10): 1.0 for p in (1, 2, 5, 6)} | {(2, 11): 1.0, (3, 12): 1.0, (2, 15): 1.0}
    near = {(p, 15): 0.75 for p in (1, 5, 6)}
    assert _scores(sim.contained(words, texts)) == whole | near
    assert _scores(sim.both_ways(words, texts)) == whole | near | {(p, 11): 1.0 for p in (1, 5, 6)}
    # An anchor of which a text holds less than half, or none, or a null one keeps the print out; an empty one asks nothing.
    assert _scores(sim.anchored(prints, texts)) == {(1, 10): 1.0, (2, 10): 1.0, (2, 11): 1.0, (3, 12): 1.0, (2, 15): 1.0, (1, 15): 0.75}


@pytest.mark.parametrize("find", (sim.contained, sim.both_ways, sim.anchored))
def test_texts_are_read_once(spark, sides, find):
    """The words of the texts are made and unfolded by one step, however many shares are asked."""
    texts = spark.range(1000).select(F.col("id").alias("text_id"), F.split(F.concat(F.lit("a b c "), "id"), " ").alias("words"))
    plan = find(sides[0], texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1
