"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and an equi join that
adaptive execution may split on a hot node; nothing is collected but one checksum row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilmill.llm.common import cut


def _pairs(*columns: tuple[str, str]):
    """Rows (u, v) from pairs of columns, without reading the table once for each pair."""
    return F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in columns]))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(_pairs(("u", "v"), ("v", "u")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(_pairs(("v", "m"), ("u", "m")))


def components(edges: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node that it reaches.

    Loops and repeated edges are allowed; null ends are ignored.  Raises if `rounds` do not suffice
    (about log2 of the longest path is needed).
    """
    current = (
        edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
        .where("u is not null and v is not null and u != v")
        .distinct()
    )
    current = cut(current)
    seen = None
    for _ in range(rounds):
        current = cut(_small(_large(current).distinct()).where("u != v").distinct())
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return current.select(_pairs(("u", "v"), ("v", "v"))).distinct().select(F.col("u").alias("node"), F.col("v").alias("root"))
