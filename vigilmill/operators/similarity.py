"""Set containment, nearest neighbours and term ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilmill.functions import text as tx
from vigilmill.functions.nested import held


def _grams(rows: DataFrame, key: str, n: int, words: str = "words") -> DataFrame:
    """(key, how many grams, gram): a row for each distinct gram of a row's words, made in one pass."""
    made = held(rows, [key], _g=tx.grams(F.col(words), n))
    return made.select(key, F.size("_g").alias(f"{key}_n"), F.explode("_g").alias("gram"))


def contained(prints: DataFrame, texts: DataFrame, least: float = 0.6, n: int = 3) -> DataFrame:
    """(print_id, text_id, score): share of a print's grams that a text holds, where it is `least` or more.

    prints: print_id, words; texts: text_id, words (arrays), one row an id.  An inverted index on grams: both sides are exploded to distinct
    grams once and joined on them; only texts' grams that some print has survive the join.  How many a print has travels with them.
    """
    hits = _grams(texts, "text_id", n).join(_grams(prints, "print_id", n), "gram").groupBy("print_id", "text_id").agg(F.count("*").alias("hits"), F.first("print_id_n").alias("n"))
    return hits.withColumn("score", F.col("hits") / F.col("n")).where(F.col("score") >= least).select("print_id", "text_id", "score")


def anchored(prints: DataFrame, texts: DataFrame, least: float = 0.6, anchor_least: float = 0.5, n: int = 3) -> DataFrame:
    """`contained`, of prints whose anchor (words of the sentence that was matched) the text holds to `anchor_least` as well.

    prints: print_id, words, anchor; an empty anchor asks nothing.  Grams of prints and anchors are one index, so a text is read once.
    """
    whole = held(prints, ["print_id"], _g=tx.grams(F.col("words"), n), _a=F.coalesce(tx.grams(F.col("anchor"), n), F.array().cast("array<string>")), _free=F.size("anchor") == 0)
    every = whole.select("print_id", F.size("_g").alias("n"), F.size("_a").alias("na"), "_free", "_g", "_a", F.explode(F.array_union("_g", "_a")).alias("gram"))
    index = every.select("print_id", "n", "na", "_free", "gram", F.array_contains("_g", F.col("gram")).cast("int").alias("own"), F.array_contains("_a", F.col("gram")).cast("int").alias("of_anchor"))
    met = _grams(texts, "text_id", n).join(index, "gram").groupBy("print_id", "text_id").agg(F.sum("own").alias("hits"), F.sum("of_anchor").alias("ha"), *[F.first(c).alias(c) for c in ("n", "na", "_free")])
    asked = F.col("_free") | ((F.col("ha") > 0) & (F.col("ha") / F.col("na") >= anchor_least))
    return met.where("hits > 0").withColumn("score", F.col("hits") / F.col("n")).where((F.col("score") >= least) & asked).select("print_id", "text_id", "score")


def both_ways(prints: DataFrame, others: DataFrame, least: float = 0.6, n: int = 3) -> DataFrame:
    """(print_id, text_id, score): the greater of the shares that each of two texts holds of the other; others: text_id, words.

    The grams that both have are counted once and divided by the lesser number of grams.
    """
    met = _grams(others, "text_id", n).join(_grams(prints, "print_id", n), "gram").groupBy("print_id", "text_id").agg(F.count("*").alias("hits"), F.first("print_id_n").alias("n"), F.first("text_id_n").alias("m"))
    return met.withColumn("score", F.col("hits") / F.least("n", "m")).where(F.col("score") >= least).select("print_id", "text_id", "score")


def around_hits(sentences: Column, hits: Column, reach: int) -> Column:
    """array<struct<d, said>>: a text's sentences within `reach` of one that is a hit, with the least distance; hits: array<boolean>, one a sentence.

    Both are looked into for each sentence, so they are to be columns that stand, not expressions.
    """

    def placed(said: Column, i: Column) -> Column:
        at = lambda j: F.coalesce(F.get(hits, j), F.lit(False))
        return F.struct(F.coalesce(*[F.when(at(i - k) | at(i + k), F.lit(k)) for k in range(reach + 1)]).alias("d"), said.alias("said"))

    return F.filter(F.transform(sentences, placed), lambda p: p["d"].isNotNull())


def nearest_to_match(near: DataFrame, most: int) -> DataFrame:
    """(doc_id, value, d, apart): the values beside hits with their least distance, the `most` nearest of a text (ties: by value).

    near: doc_id, d, value, as the sentences of `around_hits` have them: what lies further off is never read nor shuffled.  Rows without d are
    values of elsewhere; apart says whether a value is among these.
    """
    v = near.groupBy("doc_id", "value").agg(F.min("d").alias("d"), F.bool_or(F.col("d").isNull()).alias("apart")).where("d is not null")
    w = Window.partitionBy("doc_id").orderBy("d", "value")
    return v.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("doc_id", "value", "d", "apart")


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a, b):
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for lo in range(0, len(f), 4096):
            part = f.iloc[lo : lo + 4096]
            yield pd.DataFrame({"ids": [part["iid"].tolist()], "vectors": [[np.asarray(v, float).tolist() for v in part["iv"]]], "labels": [part["label"].tolist()]})


def _unit(rows) -> np.ndarray:
    m = np.array([np.asarray(r, float) for r in rows])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _scores(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The k best of every chunk of the index for each query of a block."""
    for f in frames:
        for ids, vectors, labels, qids, qvs in zip(f["ids"], f["vectors"], f["labels"], f["qids"], f["qvs"]):
            ids, labels, qids = np.asarray(ids), np.asarray(labels), np.asarray(qids)
            sim = np.round(_unit(qvs) @ _unit(vectors).T, 6)
            sim[qids[:, None] == ids[None, :]] = -np.inf
            best = [b[np.isfinite(row[b])] for row in sim for b in [np.lexsort((ids, -row))[:k]]]
            n, at = [len(b) for b in best], np.concatenate(best).astype(np.int64)
            yield pd.DataFrame({"qid": np.repeat(qids, n), "iid": ids[at], "label": labels[at], "sim": sim[np.repeat(np.arange(len(qids)), n), at]})


#: Queries of a block: a block's vectors are what a task holds beside a batch of the index.
BLOCK = 1024


def nearest(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of index for each query by cosine, rounded to six places (ties: smaller id); a row is never its own neighbour.

    queries: a stated set (qid, qv); index: (iid, iv, label).  Queries are held in blocks of `BLOCK` rows against the whole index: a task
    normalises its batch of the index once and takes one matrix product for the block, and keeps k rows a query of each batch, so
    what is shuffled is k rows for each query and batch.
    """
    blocks = max(1, -(-queries.count() // BLOCK))
    q = queries.select("qid", "qv", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block"))
    packed = q.groupBy("block").agg(F.collect_list("qid").alias("qids"), F.collect_list("qv").alias("qvs"))  # a block has about BLOCK rows
    # Blocks by chunks of the index: a stated query set against all rows, a matrix product a pair of them.
    pairs = index.select("iid", "iv", "label").mapInPandas(_chunks, "ids array<bigint>, vectors array<array<double>>, labels array<int>")
    scored = pairs.crossJoin(packed).mapInPandas(lambda frames: _scores(frames, k), "qid bigint, iid bigint, label int, sim double")
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "iid")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "iid", "label", "sim", "rank")


def balanced_vote(neighbours: DataFrame, positives: int, negatives: int) -> DataFrame:
    """(qid, vote): similarity to the positive class over both, each class divided by its size."""
    yes = F.sum(F.when(F.col("label") == 0, F.greatest("sim", F.lit(0.0))).otherwise(0.0)) / positives
    no = F.sum(F.when(F.col("label") != 0, F.greatest("sim", F.lit(0.0))).otherwise(0.0)) / negatives
    return neighbours.groupBy("qid").agg((yes / (yes + no)).alias("vote"))


def bm25(docs: DataFrame, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the documents with a term of the query; docs: id, terms (array).  Corpus figures are one row."""
    sized = docs.withColumn("len", F.size("terms"))
    stats = sized.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    tf = sized.select("id", "len", F.explode(F.filter("terms", lambda t: t.isin(*query))).alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy("id").agg(F.sum(part).alias("score"))
