"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows each partition sends to each shard is drawn first, as a uniform shuffle of all rows would have it: rows of the
matrix add up to the partitions' rows, columns to the shards' sizes.  Then each partition permutes its rows locally and
cuts them by its row of the matrix, the rows are exchanged, and each shard permutes what it got.

The matrix is drawn down a tree of partitions: of a node's places in the shards, how many the left half of its partitions gets is
multivariate hypergeometric, one shard after the other.  A draw is by inversion, from the mode outward, with weights that follow
from their ratios; weights farther than REACH standard deviations from the mode are below 1e-17 in all.  Every level of the tree is
one step over the nodes, in native expressions; so is all the rest.

No task sees more than a partition of the input, or one bin of a shard: the last permutation deals a shard by ranges
of a random key, counts the ranges, and numbers rows within them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilmill.llm.blocks import beside
from vigilmill.llm.common import cut, free_names

#: Standard deviations from the mode within which counts are drawn.
REACH = 9
#: Rows of a bin of a shard, about.
BIN_ROWS = 20_000
#: Levels of the tree between two written tables.
LEVELS_A_PLAN = 4


def _uniform(*key: Column) -> Column:
    """A number in (0, 1) from 52 bits of a hash of the key."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of `draws` out of `total` places, `good` of them marked, are marked; by inversion of u in (0, 1).

    All columns bigint but u; 0 for an empty population.
    """
    n, k, t = draws.cast("double"), good.cast("double"), total.cast("double")
    share = k / F.greatest(t, F.lit(1.0))
    deviation = F.sqrt(n * share * (1 - share) * (t - n) / F.greatest(t - 1, F.lit(1.0)))
    least, most = F.greatest(F.lit(0).cast("bigint"), draws + good - total), F.least(draws, good)
    peak = F.floor((n + 1) * (k + 1) / (t + 2)).cast("bigint")
    known = F.struct(
        n.alias("n"), k.alias("k"), t.alias("t"), u.alias("u"), least.alias("least"), most.alias("most"),
        F.least(most, F.greatest(least, peak)).alias("mode"), (F.ceil(deviation * REACH).cast("bigint") + 8).alias("reach"),
    )
    return _let(known, _inverted)


def _inverted(p: Column) -> Column:
    n, k, t, mode = p["n"], p["k"], p["t"], p["mode"]
    widest = F.least(p["reach"], F.greatest(mode - p["least"], p["most"] - mode))
    steps = F.sequence(F.lit(1).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), widest))

    def above(i: Column, weight: Column) -> Column:
        """Weight of mode + i from that of mode + i - 1."""
        x = (mode + i).cast("double")
        return F.when((x <= k) & (x <= n), weight * (k - x + 1) * (n - x + 1) / (x * (t - k - n + x))).otherwise(F.lit(0.0))

    def below(i: Column, weight: Column) -> Column:
        """Weight of mode - i from that of mode - i + 1."""
        x = (mode - i).cast("double")
        return F.when((x >= 0) & (x >= n + k - t), weight * (x + 1) * (t - k - n + x + 1) / ((k - x) * (n - x))).otherwise(F.lit(0.0))

    first = lambda: (above(F.lit(1), F.lit(1.0)).alias("a"), below(F.lit(1), F.lit(1.0)).alias("b"))
    following = lambda s, i: (above(i + 1, s["a"]).alias("a"), below(i + 1, s["b"]).alias("b"))
    all_weights = F.aggregate(
        steps, F.struct(*first(), F.lit(1.0).alias("sum")), lambda s, i: F.struct(*following(s, i), (s["sum"] + s["a"] + s["b"]).alias("sum")), lambda s: s["sum"]
    )
    # left: what is still to be passed of u * all weights, the mode first, then one above, one below, and so on.
    found = F.aggregate(
        steps,
        F.struct(*first(), (p["u"] * all_weights - 1).alias("left"), mode.alias("x")),
        lambda s, i: F.struct(
            *following(s, i),
            F.when(s["left"] < 0, s["left"]).otherwise(s["left"] - s["a"] - s["b"]).alias("left"),
            F.when(s["left"] < 0, s["x"]).when(s["left"] < s["a"], mode + i).otherwise(mode - i).alias("x"),
        ),
        lambda s: s["x"],
    )
    return F.when(p["least"] >= p["most"], p["least"]).otherwise(F.greatest(p["least"], F.least(p["most"], found)))


def _left_half(node: str, rows: Column, seats: Column, shards: int, seed: int) -> Column:
    """array<bigint>: of the seats left in each shard, those that `rows` rows get."""
    state = F.struct(F.array().cast("array<bigint>").alias("got"), rows.alias("rows"), F.aggregate(seats, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("all"))

    def step(s: Column, i: Column) -> Column:
        mine = F.element_at(seats, i + 1)
        got = hypergeometric(s["all"], mine, s["rows"], _uniform(F.lit(seed), F.col(node), i))
        return F.struct(F.concat(s["got"], F.array(got)).alias("got"), (s["rows"] - got).alias("rows"), (s["all"] - mine).alias("all"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), state, step, lambda s: s["got"])


def communication_matrix(parts: DataFrame, shards: int, seed: int, n_parts: int) -> DataFrame:
    """(part, sends array<bigint>): rows that each partition sends to each shard.

    parts: (part, rows), part from 0 to n_parts - 1, which may miss where rows are 0.  Sizes of shards differ by one at most, the first are the larger.
    """
    total = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    filled = parts.sparkSession.range(n_parts).select(F.col("id").alias("part")).join(parts, "part", "left")
    # One number a partition: a table of a row for each partition of the input.
    root = filled.agg(F.array_sort(F.collect_list(F.struct("part", F.coalesce("rows", F.lit(0)).alias("rows")))).alias("both"))
    root = root.select(F.lit(0).cast("bigint").alias("first"), F.lit(1).cast("bigint").alias("node"), F.transform("both", lambda b: b["rows"]).alias("sizes"))
    seats = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.call_function("div", total, F.lit(shards)) + (j < total % shards).cast("bigint"))
    nodes = cut(root.withColumn("seats", seats))
    for level in range(max(0, (n_parts - 1).bit_length())):
        half = F.call_function("div", F.size("sizes") + 1, F.lit(2)).cast("int")
        nodes = nodes.withColumn("half", half).withColumn("left", F.slice("sizes", F.lit(1), F.col("half")))
        nodes = nodes.withColumn("right", F.slice("sizes", F.col("half") + 1, F.size("sizes")))
        nodes = nodes.withColumn("left_rows", F.aggregate("left", F.lit(0).cast("bigint"), lambda a, x: a + x))
        got = F.when(F.size("sizes") > 1, _left_half("node", F.col("left_rows"), F.col("seats"), shards, seed)).otherwise(F.col("seats"))
        nodes = nodes.withColumn("got", got)
        rest = F.zip_with("seats", "got", lambda a, b: a - b)
        child = lambda first, node, sizes, seats: F.struct(first.alias("first"), node.alias("node"), sizes.alias("sizes"), seats.alias("seats"))
        left = child(F.col("first"), F.col("node") * 2, F.col("left"), F.col("got"))
        right = child(F.col("first") + F.col("half"), F.col("node") * 2 + 1, F.col("right"), rest)
        nodes = nodes.select(F.explode(F.when(F.size("sizes") > 1, F.array(left, right)).otherwise(F.array(left))).alias("child")).select("child.*")
        nodes = cut(nodes.repartition("node")) if level % LEVELS_A_PLAN == LEVELS_A_PLAN - 1 else nodes
    return cut(nodes.select(F.col("first").alias("part"), F.col("seats").alias("sends")))


def uniform_shards(rows: DataFrame, shards: int = 8, seed: int = 11) -> DataFrame:
    """rows with `shard` (0 to shards - 1, counts at most one apart) and `slot` (gapless from 0 in the shard), a uniform shuffle.

    Every row is dealt for itself: nulls, repeated rows and equal texts play no part, columns named shard or slot are replaced.  The
    rows are written once, so that a lost executor finds the partitions as they were counted.  Fewer rows than shards leave
    some shards empty; an empty table gives no row.
    """
    kept = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    part, at, rank, key, bin_ = free_names(kept, "part", "at", "rank", "key", "bin")
    # Place in the partition: the low 33 bits of the id.
    placed = rows.select(*kept, F.spark_partition_id().cast("bigint").alias(part), F.monotonically_increasing_id().alias(at))
    placed = cut(placed)
    sizes = cut(placed.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("rows")))
    n, n_parts = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("part"), F.lit(-1)) + 1).first()
    if not n:
        return placed.select(*kept, F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    sends, send = free_names([*kept, part, at, rank, key, bin_], "sends", "part_no")
    matrix = communication_matrix(sizes, shards, seed, n_parts).select(F.col("part").alias(send), F.col("sends").alias(sends))

    # Permute locally: rows of a task in the order of a hash, numbered in that order.
    mixed = placed.withColumn(key, F.xxhash64(F.lit(seed), F.lit("local"), F.col(at))).sortWithinPartitions(key, at)
    ranked = mixed.withColumn(rank, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ranked = ranked.join(beside(matrix), F.col(part) == F.col(send))
    cuts = F.aggregate(
        sends,
        F.struct(F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("upto")),
        lambda s, x: F.struct((s["shard"] + (s["upto"] + x <= F.col(rank)).cast("int")).alias("shard"), (s["upto"] + x).alias("upto")),
        lambda s: s["shard"],
    )
    # Exchange, and permute again: a shard's rows go to bins by a random key, and are numbered by it within their bin.
    bins = max(1, -(-n // (shards * BIN_ROWS)))
    second = F.xxhash64(F.lit(seed), F.lit("shard"), F.col(at))
    sent = ranked.select(*kept, at, cuts.alias("shard"), second.alias(key))
    sent = sent.withColumn(bin_, F.floor(F.shiftrightunsigned(key, 11).cast("double") / F.lit(float(1 << 53)) * bins).cast("int"))
    sent = cut(sent)
    before = Window.partitionBy("shard").orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    (start,) = free_names([*kept, at, key, bin_, "shard"], "start")
    starts = sent.groupBy("shard", bin_).agg(F.count("*").alias("bin_rows")).select("shard", bin_, F.coalesce(F.sum("bin_rows").over(before), F.lit(0)).alias(start))
    order = Window.partitionBy("shard", bin_).orderBy(key, at)
    numbered = sent.withColumn("slot", F.row_number().over(order).cast("bigint") - 1).join(beside(cut(starts)), ["shard", bin_])
    return numbered.select(*kept, "shard", (F.col("slot") + F.col(start)).alias("slot"))
