"""Pigeonhole block keys of 64-bit codes and their distribution over tasks.

Two codes that differ in at most r of 64 bits agree on at least (b - r) of b blocks, so a table for each
choice of (b - r) blocks brings every such pair together.  Buckets of more than `limit` rows are dealt to
several cells: the bucket's rows fall into c chunks, and a row goes to the c cells that hold its chunk, so
that any two rows meet in at least one cell and no cell holds more than about two chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilmill.llm.common import cut

#: Tables of large buckets are broadcast up to this many rows, else joined by a shuffle.
BROADCAST_ROWS = 100_000


def masks(blocks: int, radius: int) -> list[int]:
    """Bit masks of all choices of (blocks - radius) blocks of a 64-bit code."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("0 <= radius < blocks <= 64 is needed")
    edge = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edge, edge[1:])]
    return [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_keys(code: Column, blocks: int, radius: int) -> Column:
    """array<bigint>: a hashed key of each table."""
    return F.array(*[F.xxhash64(F.lit(i), code.bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks(blocks, radius))])


def _overfull(rows: DataFrame, key: str, limit: int, expected: int) -> DataFrame:
    """(key, bucket_rows) of the keys of over `limit` rows, found exactly.

    Counts by a coarse hash of the key are combined before their shuffle, and only keys in overfull coarse bins are counted one by one.
    """
    bins = 1 << max(14, (4 * expected // limit).bit_length())
    coarse = F.pmod(F.xxhash64(key), F.lit(bins)).alias("coarse")
    full = cut(rows.groupBy(coarse).count().where(F.col("count") > limit).select("coarse"))
    suspects = rows.select(key, coarse).join(beside(full), "coarse", "left_semi")
    return cut(suspects.groupBy(key).agg(F.count("*").alias("bucket_rows")).where(F.col("bucket_rows") > limit))


def beside(table: DataFrame) -> DataFrame:
    """A written table for a join: broadcast if it has `BROADCAST_ROWS` rows at most."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def dealt(rows: DataFrame, key: str, row_hash: Column, limit: int, expected: int, band: Column | None = None) -> DataFrame:
    """rows with a column `cell`: the key, or for a bucket of over `limit` rows one row for each cell of its chunk.

    Dealt to tasks by cell and sorted by it, as `whole_runs` needs it.  `expected` (about the number of rows) sets how finely
    large buckets are looked for.  With `band`, an integer by which only rows of equal or neighbouring values can belong
    together, a large bucket is first parted into one for each two neighbouring bands.
    """
    large = _overfull(rows, key, limit, expected)
    if large.isEmpty():
        return rows.withColumn("cell", F.col(key)).repartition("cell").sortWithinPartitions("cell")
    sized, by = rows.join(beside(large), key, "left"), key
    if band is not None:
        by = "part_key"
        parts = F.array(*[F.xxhash64(F.col(key), band + i) for i in (0, 1)])
        # Keys of other buckets stay out of the counts of parts.
        only = rows.join(beside(large.select(key)), key, "left_semi").select(F.explode(parts).alias(by))
        large = _overfull(only, by, limit, expected)
        sized = sized.withColumn(by, F.explode(F.when(F.col("bucket_rows").isNotNull(), parts).otherwise(F.array(F.col(key))))).drop("bucket_rows")
        sized = sized.join(beside(large), by, "left")
    chunks = F.ceil(F.col("bucket_rows") / F.lit(limit)).cast("bigint")
    mine = F.pmod(row_hash, chunks)
    cells = F.when(
        F.col("bucket_rows").isNotNull(),
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), chunks - 1),
            lambda j: F.xxhash64(F.col(by), F.least(mine, j), F.greatest(mine, j)),
        ),
    ).otherwise(F.array(F.col(by)))
    return sized.withColumn("cell", F.explode(cells)).drop("bucket_rows").repartition("cell").sortWithinPartitions("cell")


def whole_runs(frames: Iterator[pd.DataFrame], column: str = "cell") -> Iterator[pd.DataFrame]:
    """The rows again, cut so that all rows of a value of the sorted column are in one frame."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        values = frame[column].to_numpy()
        at = int(np.searchsorted(values, values[-1]))  # where the last run starts
        if at == 0 and (not held or held[-1][column].iat[-1] == values[0]):
            held.append(frame)
            continue
        done = pd.concat([*held, frame.iloc[:at]], ignore_index=True)
        held = [frame.iloc[at:]]
        yield done
    if held:
        yield pd.concat(held, ignore_index=True)


def near_pairs(cell: np.ndarray, code: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of the rows of equal cell (sorted) whose codes (uint64) differ in `radius` bits at most."""
    at, d = np.arange(len(cell)), 1
    while len(at := at[at + d < len(cell)]) and len(at := at[cell[at] == cell[at + d]]):
        near = at[np.bitwise_count(code[at] ^ code[at + d]) <= radius]
        if len(near):
            yield near, near + d
        d += 1


class Links:
    """Union by smallest member over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
