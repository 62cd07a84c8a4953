"""Order MinHash: signatures whose likeness follows edit distance.

Every k-mer of a text's code points is numbered by its occurrence, so that repeats differ.  For each of `rows`
hash functions the `tuple_size` least (k-mer, occurrence) pairs are selected, put back into text order and hashed
together.  Likeness is the share of equal tuple hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilmill.llm.common import sampled

K = 8
ROWS = 48
TUPLE = 2
#: Columns of the hash matrix that are worked on at once.
STRIDE = 1 << 14
#: Ranges of (doc_id, text hash) at most, and rows sampled for each; the sample and the least row of each range are all that reaches the driver (some 100 MB).
MAX_PARTS = 200_000
SAMPLED = 16

_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_R33 = np.uint64(33)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _R33)) * _M1
        h = (h ^ (h >> _R33)) * _M2
    return h ^ (h >> _R33)


def _kmers(text: str, k: int) -> np.ndarray:
    """Hash of every k-mer (of the whole text, if it is shorter)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    k = min(k, len(points))
    n = len(points) - k + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * _M3 + points[i : i + n] + np.uint64(1)
    return _mixed(h)


def _occurrences(h: np.ndarray) -> np.ndarray:
    """How many equal values come before each."""
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    at = np.arange(len(h))
    out = np.empty(len(h), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


_SEEDS = _mixed(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def signature(text: str | None, rows: int = ROWS, tuple_size: int = TUPLE, k: int = K) -> np.ndarray:
    """uint16[rows]; zeros for an empty text."""
    if not text:
        return np.zeros(rows, np.uint16)
    kmer = _kmers(text, k)
    with np.errstate(over="ignore"):
        unique = _mixed(kmer + _occurrences(kmer).astype(np.uint64) * _M3)
        # Multiply-shift hashes of the upper and lower halves; the low bits carry nothing that the order needs.
        low, high = unique.astype(np.uint32), (unique >> np.uint64(32)).astype(np.uint32)
        a, b = (_SEEDS[:rows].astype(np.uint32) | np.uint32(1))[:, None], (_SEEDS[:rows] >> np.uint64(32)).astype(np.uint32)[:, None]
        size = min(tuple_size, len(kmer))
        best_v, best_p = [], []
        for lo in range(0, len(kmer), STRIDE):
            v = (low[lo : lo + STRIDE] ^ b) * a + high[lo : lo + STRIDE]
            each = np.arange(rows)
            for _ in range(min(size, v.shape[1])):
                p = v.argmin(axis=1)
                best_v.append(v[each, p])
                best_p.append(p + lo)
                v[each, p] = np.uint32(0xFFFFFFFF)
        values, places = np.stack(best_v, axis=1), np.stack(best_p, axis=1)
        if values.shape[1] > size:
            pick = np.lexsort((places, values), axis=1)[:, :size]
            places = np.take_along_axis(places, pick, axis=1)
        places = np.sort(places, axis=1)
        h = np.full(rows, np.uint64(size))
        for j in range(size):
            h = _mixed(h * _M3 + kmer[places[:, j]] + _SEEDS[:rows])
    return (h >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


_NULL_ID = -(1 << 63)


def rank_among(ids: np.ndarray, keys: np.ndarray, bound_ids: np.ndarray, bound_keys: np.ndarray) -> np.ndarray:
    """How many of the bounds (ascending pairs) are at or below each pair (id, key)."""
    lo, hi = np.searchsorted(bound_ids, ids, "left"), np.searchsorted(bound_ids, ids, "right")
    out = lo.astype(np.int64)
    tied = np.flatnonzero(hi > lo)
    for i in np.unique(ids[tied]):
        rows = tied[ids[tied] == i]
        a, b = lo[rows[0]], hi[rows[0]]
        out[rows] = a + np.searchsorted(bound_keys[a:b], keys[rows], "right")
    return out


def with_next(docs: DataFrame, per_task: int = 4_000) -> DataFrame:
    """Rows (part, lead, doc_id, text, key) in ranges of (doc_id, text hash), one a task, sorted within each; a part ends with a copy (lead) of the row that follows it.

    Bounds come from a hash sample of about `SAMPLED` rows for each `per_task` rows, so neither null nor repeated doc_ids fill a
    part; only rows equal in doc_id and text stay together.  Order: doc_id (null first), then the text's hash.  After the last row
    comes the first.  One shuffle moves each text once, and the least row of each part twice.
    """
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    place = [F.coalesce("doc_id", F.lit(_NULL_ID)).alias("id"), "key"]
    total = docs.count()
    parts = min(MAX_PARTS, max(1, total // per_task))
    if parts > 1:
        some = keyed.where(sampled(F.xxhash64("doc_id", "key", F.lit("parts")), SAMPLED * parts, total)).select(*place).toPandas().sort_values(["id", "key"])
        some = some.iloc[SAMPLED::SAMPLED].drop_duplicates()
    else:
        some = pd.DataFrame({"id": [], "key": []}, dtype="int64")
    bound_ids, bound_keys = some["id"].to_numpy(), some["key"].to_numpy()
    parts = len(some) + 1

    @F.pandas_udf("int")
    def part_of(ids: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series(rank_among(ids.to_numpy(), keys.to_numpy(), bound_ids, bound_keys))

    tagged = keyed.withColumn("part", part_of(*place) if parts > 1 else F.lit(0))
    # The least row of every part, one row for a part.
    least = F.struct(F.col("doc_id").isNotNull().alias("n"), "doc_id", "key")
    heads = [(r["part"], r["h"]["doc_id"], r["h"]["key"]) for r in tagged.groupBy("part").agg(F.min(least).alias("h")).orderBy("part").collect()]
    copies = keyed.sparkSession.createDataFrame([(*heads[i], heads[i - 1][0]) for i in range(len(heads))], "p int, id bigint, k bigint, before int")
    same = (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k"))
    own = F.struct("part", F.lit(0).alias("lead"))
    both = F.array(own, F.struct(F.col("before").alias("part"), F.lit(1).alias("lead")))
    every = tagged.join(F.broadcast(copies), same, "left").select(F.inline(F.when(F.col("p").isNull(), F.array(own)).otherwise(both)), "doc_id", "text", "key")
    return every.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "lead", F.col("doc_id").asc_nulls_first(), "key")


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def fingerprint_documents(docs: DataFrame, rows: int = ROWS, tuple_size: int = TUPLE, k: int = K) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and the likeness to that and to the next document's.

    A null text is empty; rows of equal doc_id follow each other by text; repeated rows follow themselves.  A single
    document is its own next.  Equal texts have equal fingerprints; two empty texts have likeness 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (doc_id, text, signature)
        at = None
        for b in batches:
            out: list[tuple] = []
            for part, lead, doc_id, text in zip(*[b.column(c).to_pylist() for c in ("part", "lead", "doc_id", "text")]):
                mine = signature(text, rows, tuple_size, k)
                if held is not None and at == part:
                    changed = edited(held[1], text)
                    other = held[2] if changed == held[1] else signature(changed, rows, tuple_size, k)
                    out.append((held[0], len(held[1]), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), held[2].astype(">u2").tobytes().hex(),
                                other.astype(">u2").tobytes().hex(), likeness(held[2], other), likeness(held[2], mine)))
                # Rows equal to the least one of the next part lead too; the first of them is enough.
                held, at = (None, None) if lead else ((doc_id, text, mine), part)
            if out:
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return with_next(docs).select("part", "lead", "doc_id", "text").mapInArrow(run, SCHEMA)
