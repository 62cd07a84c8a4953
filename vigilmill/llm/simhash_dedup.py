"""SimHash near-duplicates of documents, searched with BK-trees.

A document's fingerprint is the bitwise majority of the XXH64 (seed 42) of its word shingles.  Distinct
fingerprints are sharded by pigeonhole blocks; each shard is searched with a BK-tree (children keyed by
their integer Hamming distance to the parent, only edges within the radius followed), and the spanning
links of all shards are joined to components.

The shard trees travel by a shuffle on the shard key: a broadcast of all trees would grow with the corpus
and so has no proven size bound.  Shards over `shard_limit` fingerprints are split into pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilmill.llm.blocks import Links, block_keys, dealt, masks, whole_runs
from vigilmill.llm.common import cut, free_names
from vigilmill.llm.components import components


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of a text as a signed integer; 0 if it has no word."""
    found = (text or "").encode("utf-8", "replace").lower().split()  # on bytes both know ASCII only
    if not found:
        return 0
    if len(found) < words:
        grams = [b" ".join(found)]
    else:
        grams = list(map(b" ".join, zip(*[found[i:] for i in range(words)])))
    digest, ones, step = xxhash.xxh64_digest, np.zeros(64, np.int64), 1 << 16
    for at in range(0, len(grams), step):
        raw = np.frombuffer(b"".join([digest(g, 42) for g in grams[at : at + step]]), np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(grams)).tobytes(), "big", signed=True)


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self):
        self.root = None

    def within(self, code: int, radius: int) -> list[int]:
        """Positions (in order of insertion) of the codes within the radius."""
        found, open_nodes = [], [self.root] if self.root else []
        while open_nodes:
            value, position, children = open_nodes.pop()
            d = (value ^ code).bit_count()
            if d <= radius:
                found.append(position)
            for edge, child in children.items():
                if -radius <= edge - d <= radius:
                    open_nodes.append(child)
        return found

    def add(self, code: int, position: int) -> None:
        if self.root is None:
            self.root = (code, position, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ code).bit_count()
            if d in node[2]:
                node = node[2][d]
            else:
                node[2][d] = (code, position, {})
                return


def shard_links(codes: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """(code, smallest code of its group) for the codes of one shard that have a neighbour."""
    codes = sorted(set(codes))
    tree, links = BKTree(), Links(len(codes))
    for i, code in enumerate(codes):
        plain = code & 0xFFFFFFFFFFFFFFFF
        for j in tree.within(plain, radius):
            links.join(i, j)
        tree.add(plain, i)
    for i, code in enumerate(codes):
        if (r := links.root(i)) != i:
            yield code, codes[r]


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text_key, fp) of every row; text_key is a hash that tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t, words) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), fps], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, fp bigint")


def fingerprint_groups(codes: DataFrame, radius: int = 2, blocks: int = 4, shard_limit: int = 4096) -> DataFrame:
    """(fp, root) for the fingerprints that have another one within the radius; codes: distinct `fp`."""
    keys = block_keys(F.col("fp"), blocks, radius)
    keyed = codes.select("fp", F.explode(keys).alias("shard"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, int]] = []
        for f in whole_runs(frames):
            cell, fp = f["cell"].to_numpy(), f["fp"].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            stops = np.concatenate((starts[1:], [len(cell)]))
            for k in np.flatnonzero(stops - starts > 1).tolist():
                found.extend(shard_links(fp[starts[k] : stops[k]].tolist(), radius))
            if len(found) > 50_000:
                yield pd.DataFrame(found, columns=["a", "b"])
                found = []
        if found:
            yield pd.DataFrame(found, columns=["a", "b"])

    expected = codes.count() * len(masks(blocks, radius))
    edges = dealt(keyed, "shard", F.xxhash64("fp"), shard_limit, expected).select("cell", "fp").mapInPandas(run, "a bigint, b bigint")
    return components(edges, "a", "b").select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3, blocks: int = 4, shard_limit: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, text_key, fp, root (of its group of fingerprints), component_id (the group's smallest doc_id).

    Null, empty and blank texts have fingerprint 0 and form one group with whatever lies within the radius.
    Repeated rows stay repeated; component_id is null only where every doc_id of a group is.  No group is
    collected: a group is its root, its members are rows.
    """
    rows = cut(fingerprints(docs, words))
    codes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = fingerprint_groups(codes.select("fp"), radius, blocks, shard_limit)
    rooted = cut(codes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each near-duplicate group: the one of the smallest (doc_id, text_key), null doc_id last.

    Rows repeated with the same doc_id and text count as one document.  Columns and their order are those of docs.
    """
    id_, key_, mine_ = free_names(docs.columns, "keep_id", "keep_key", "mine")
    found = near_duplicates(docs, **options)
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")
    best = found.groupBy("root").agg(F.min(rank).alias("best")).select(F.col("best.doc_id").alias(id_), F.col("best.text_key").alias(key_))
    tagged = docs.withColumn(mine_, F.xxhash64("text"))
    same = (F.col(mine_) == F.col(key_)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_))
    return tagged.join(best, same, "left_semi").dropDuplicates(["doc_id", mine_]).select(*docs.columns)
