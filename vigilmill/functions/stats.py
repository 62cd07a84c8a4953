"""Rates, intervals and tests as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959964


def wilson(k: Column, n: Column, z: float = Z95, empty: tuple[float, float] = (0.0, 1.0)) -> tuple[Column, Column]:
    """Lower and upper end of Wilson's interval; `empty` for n = 0."""
    k, m = k.cast("double"), n.cast("double")
    p = k / m
    bottom = F.lit(1.0) + F.lit(z * z) / m
    middle = (p + F.lit(z * z / 2) / m) / bottom
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / m + F.lit(z * z / 4) / (m * m)) / bottom
    return (
        F.when(n == 0, F.lit(empty[0])).otherwise(F.greatest(F.lit(0.0), middle - half)),
        F.when(n == 0, F.lit(empty[1])).otherwise(F.least(F.lit(1.0), middle + half)),
    )


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided binomial tail at one half; 1 without pairs.

    Terms are summed from the largest down, each relative to it by recurrence, and the largest comes from logarithms of
    factorials, so no count underflows.
    """
    n, low = (wins + losses).cast("int"), F.least(wins, losses).cast("int")
    log_factorial = lambda m: F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.log(i.cast("double")))
    top = log_factorial(n) - log_factorial(low) - log_factorial(n - low) - n * F.log(F.lit(2.0))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))
    step = lambda acc, i: F.struct((acc["term"] * i / (n - i + 1)).alias("term"), (acc["total"] + acc["term"]).alias("total"))
    down = F.sequence(low, F.lit(0), F.lit(-1))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * F.aggregate(down, start, step)["total"] * 2))


def nearest_rank(values: str, group: list[str], share: float = 0.95):
    """DataFrame step: the value at position min(n - 1, floor(share * n)) of each group in ascending order."""

    def step(df):
        w = Window.partitionBy(*group)
        ranked = df.withColumn("_i", F.row_number().over(w.orderBy(values)) - 1).withColumn("_n", F.count("*").over(w))
        return ranked.where(F.col("_i") == F.least(F.col("_n") - 1, F.floor(F.lit(share) * F.col("_n"))))

    return step


def cluster_bootstrap_gap(per: DataFrame, cluster: str, first: str, second: str, n: str, draws: int = 2_000, level: float = 0.95) -> DataFrame:
    """(low, high, share): percentile interval of (sum first - sum second) / sum n over draws of clusters with replacement, and the share of draws not below zero.

    per: one row a cluster.  Draw r takes cluster hash(r, j) modulo the number of clusters for each j, the same for both arms, so reruns agree.
    Clusters are numbered in order of their names; the table of draws is draws times clusters rows, spread over tasks.
    """
    c = per.withColumn("i", F.row_number().over(Window.orderBy(cluster)) - 1)
    size = c.agg(F.count("*").alias("c"))
    d = per.sparkSession.range(draws).withColumnRenamed("id", "r").join(F.broadcast(size)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c") - 1)))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("r").cast("string"), F.col("j").cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint") % F.col("c")
    b = d.withColumn("i", draw).join(c, "i").groupBy("r").agg(((F.sum(first) - F.sum(second)) / F.sum(n)).alias("gap"))
    o = b.withColumn("pos", F.row_number().over(Window.orderBy("gap")) - 1)
    low, high = round(draws * (1 - level) / 2), draws - 1 - round(draws * (1 - level) / 2)
    at = lambda k: F.round(F.min(F.when(F.col("pos") == k, F.col("gap"))), 6)
    return o.agg(at(low).alias("low"), at(high).alias("high"), F.round(F.count_if(F.col("gap") >= 0) / F.count("*"), 6).alias("share"))


def order_statistics(rows: DataFrame, value: str, group: list[str], positions: dict[str, Column], bins: int = 4096) -> DataFrame:
    """(group, n, one column for each name in positions): the value at each position (from 0, ascending) of a group's values.

    positions are columns over `n`, the group's number of values; null values are left out.  No group is sorted: a histogram of its
    range finds the bin of each position, and only the distinct values of that bin are put in order, so neither a large group
    nor a value that fills half of it comes together in one task.
    """
    some = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("v"))
    stats = some.groupBy(*group).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    side = stats.select(*[F.col(c).alias(f"_{c}") for c in group], "n", "lo", "hi")
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group], F.lit(True))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(F.lit(0)).cast("int")
    binned = some.join(side, on).select(*group, "v", at.alias("bin"))
    counts = binned.groupBy(*group, "bin").agg(F.count("*").alias("c"))
    upto = counts.withColumn("before", F.sum("c").over(Window.partitionBy(*group).orderBy("bin")) - F.col("c"))
    wanted = side.select(*[F.col(f"_{c}") for c in group], F.explode(F.array(*[F.struct(F.lit(k).alias("name"), p.cast("bigint").alias("pos")) for k, p in positions.items()])).alias("w"))
    wanted = wanted.select(*[F.col(f"_{c}") for c in group], "w.name", "w.pos")
    hit = upto.join(wanted, on).where((F.col("before") <= F.col("pos")) & (F.col("pos") < F.col("before") + F.col("c"))).select(*[F.col(f"_{c}") for c in group], F.col("bin").alias("_bin"), "name", "pos", "before")
    values = binned.join(hit.select(*[F.col(f"_{c}") for c in group], "_bin").distinct(), on & (F.col("bin") == F.col("_bin")), "left_semi").groupBy(*group, "bin", "v").agg(F.count("*").alias("c"))
    inside = values.withColumn("less", F.sum("c").over(Window.partitionBy(*group, "bin").orderBy("v")) - F.col("c"))
    found = inside.join(hit, on & (F.col("bin") == F.col("_bin"))).where((F.col("before") + F.col("less") <= F.col("pos")) & (F.col("pos") < F.col("before") + F.col("less") + F.col("c")))
    told = found.groupBy(*group).agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in positions])
    return told.join(side.select(*[F.col(f"_{c}") for c in group], "n"), on).select(*group, "n", *positions)
