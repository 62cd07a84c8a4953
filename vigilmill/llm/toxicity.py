"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded (compatibility forms and accents resolved, lower case, homoglyphs, digit substitutions, one class for i, l, 1
and |; every sign that is no letter parts words, but words spelled out letter by letter are closed up) and cut into words.  The
lexicon's entries are whole words and word beginnings with a weight; matches inside an exception phrase do not
count.  The sum of weights, divided by a slowly growing function of the text's length, passes through
a logistic curve.  Weights and curve are fitted on a bounded sample of labelled rows; without labels the
seed lexicon and a fixed curve serve.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilmill.llm.common import cut, free_names, sampled

#: Labelled rows that a model is fitted on at most (about; chosen by a hash of the id).
SAMPLE_ROWS = 12_000
#: Entries of a learned lexicon at most: those of greatest weight times documents.  A sample of `SAMPLE_ROWS` rows gives some thousands.
ENTRIES = 65_536
LEAST_TOXIC = 4
LEAST_ODDS = 20.0
CUTOFF = 0.7

# Seed words of the lexicon, and phrases in which an entry is harmless.
SEED = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "imbecile", "retard")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown nose", "sore loser", "loser bracket", "disgusting smell", "pathetic fallacy")

# Look-alikes of Latin letters (Cyrillic, Greek, others without a decomposition) and digits and signs used for letters.
_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
    "ℓ": "l", "ɑ": "a", "ɩ": "i", "ɪ": "i", "ᴏ": "o", "ᴛ": "t",
}
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "l": "i"}

_BANG = re.compile(r"(?<=[^\W\d_])!(?=[^\W\d_])")
#: Letters (or digits for letters) one by one with the same sign or blank between them: three or more with a sign, four or more with a blank.
_SPELLED = re.compile(r"(?<![^\W_])[^\W_](?:([.\-_*·])[^\W_](?:\1[^\W_])+|(?: [^\W_]){3,})(?![^\W_])")
_TWO_SINGLE = re.compile(r"[ .\-_*·]\w[ .\-_*·]\w[ .\-_*·]|^\w[ .\-_*·]\w[ .\-_*·]")
_BETWEEN = re.compile(r"[ .\-_*·]")


class _Fold(dict):
    """str.translate table over compatibility-decomposed text, filled on demand: letters to their class, marks and invisible signs away, all else to blanks."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        c = _LOOKALIKES.get(c, c)
        c = _SIGNS.get(c, c)
        kind = unicodedata.category(c[0])
        self[code] = "" if kind in ("Mn", "Me", "Cf") else c if c[0].isalpha() else " "
        return self[code]


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """' word word ' of a text's folded words; ' ' for none."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    if "!" in text:
        text = _BANG.sub("i", text)
    if _TWO_SINGLE.search(text):  # two of three single letters have a separator behind them
        text = _SPELLED.sub(lambda m: _BETWEEN.sub("", m[0]), text)
    return f" {' '.join(text.translate(_FOLD).split())} "


@dataclass(frozen=True)
class Model:
    """entries: (pattern, weight), a pattern being ' word ' or ' beginning'; exceptions: folded phrases; a, b: the curve over strength."""

    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = field(default=tuple(fold(x) for x in EXCEPTIONS))
    a: float = -3.0
    b: float = 1.5


def seed_model() -> Model:
    return Model(tuple((fold(w), 3.0) for w in SEED))


@lru_cache(4)
def matcher(model: Model):
    found = ahocorasick.Automaton()
    for p, w in model.entries:
        found.add_word(p, (len(p), w))
    for p in model.exceptions:
        found.add_word(p, (len(p), 0.0))
    found.make_automaton()
    return found


def strength(folded: str, automaton) -> tuple[float, int]:
    """Sum of the weights of a folded text's matched words over its length's share, and the number of matched words.

    Of several entries that match one word the heaviest counts; a word inside an exception phrase counts nothing.
    """
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, w) in automaton.iter(folded):
        at = end - n + 1
        if w > 0:
            if w > best.get(at, 0.0):
                best[at] = w
        else:
            spared.append((at, end))
    if spared:  # both in order of place: how far the phrases reach that begin up to a match
        spared.sort()
        left, i, reach = {}, 0, -1
        for at in sorted(best):
            while i < len(spared) and spared[i][0] <= at:
                reach = max(reach, spared[i][1])
                i += 1
            if at >= reach:
                left[at] = best[at]
        best = left
    if not best:
        return 0.0, 0
    words = folded.count(" ") - 1
    return sum(best.values()) / (1.0 + math.log1p(words / 200.0)), len(best)


def score(text: str | None, model: Model) -> float:
    s, n = strength(fold(text), matcher(model))
    return _curve(s, model)


def _curve(s: float, model: Model) -> float:
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, model.a + model.b * math.log1p(s)))))


def patterns(folded: str, shortest: int = 4, longest: int = 6) -> set[str]:
    words = set(folded.split())
    found = {f" {w} " for w in words}
    for n in range(shortest, longest + 1):
        found.update(" " + w[:n] for w in words if len(w) > n)
    return found


def crc_part(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, sample_rows: int = SAMPLE_ROWS, entries: int = ENTRIES) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic); `allowed` tells by doc_id which labelled rows may be used.

    A row labelled both ways counts as toxic; null labels, ids and texts are left out.  The sample is by a hash of
    doc_id at the rate that gives about `sample_rows` rows.
    """
    named = labels.where("doc_id is not null and toxic is not null")
    if allowed is not None:
        named = named.where(allowed)
    named = named.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    total = named.count()
    if not total:
        return seed_model()
    part = sampled(F.xxhash64("doc_id", F.lit("toxicity")), sample_rows, total)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null").where(part)
    sample = cut(texts.join(named.where(part), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")))
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}  # two rows
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return seed_model()

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yes, no = Counter(), Counter()
            for text, label in zip(f["text"], f["toxic"]):
                (yes if label else no).update(patterns(fold(text)))
            keys = list(yes.keys() | no.keys())
            if keys:
                yield pd.DataFrame({"pattern": keys, "yes": [yes[k] for k in keys], "no": [no[k] for k in keys]})

    found = sample.mapInPandas(counts, "pattern string, yes long, no long").groupBy("pattern").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    odds = ((F.col("yes") + 0.5) / (toxic + 1.0)) / ((F.col("no") + 0.5) / (clean + 1.0))
    listed = found.where(F.col("yes") >= LEAST_TOXIC).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    top = listed.orderBy(F.desc(F.col("yes") * F.log("odds")), "pattern").limit(entries).collect()  # at most `entries` rows
    chosen = {r["pattern"]: math.log(r["odds"]) for r in top}
    for w in SEED:
        chosen.setdefault(fold(w), 3.0)
    model = Model(tuple(sorted(chosen.items())))

    def strengths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"s": [strength(fold(t), matcher(model))[0] for t in f["text"]], "toxic": f["toxic"]})

    rows = sample.mapInPandas(strengths, "s double, toxic int").toPandas()  # the sample's two numbers a row
    a, b = _logistic(np.log1p(rows["s"].to_numpy()), rows["toxic"].to_numpy(float))
    return Model(model.entries, model.exceptions, a, b)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Newton's steps with a light ridge, in a fixed order of rows so that reruns agree."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    design = np.stack((np.ones_like(x), x), axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.05))


def score_documents(docs: DataFrame, model: Model, score_column: str = "__score", matches_column: str = "__matches") -> DataFrame:
    """docs (any columns; of the two names' own they are replaced) with a score and the number of matched words; null and empty texts score as a text without a match."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in (score_column.lower(), matches_column.lower())])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = matcher(model)
        for b in batches:
            found = [strength(fold(t), automaton) for t in b.column(names.index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([_curve(s, model) for s, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int32())],
                [*names, score_column, matches_column],
            )

    schema = T.StructType([*docs.schema.fields, T.StructField(score_column, T.DoubleType()), T.StructField(matches_column, T.IntegerType())])
    return docs.mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """docs without those that score `cutoff` or more; columns as they were, whatever their names."""
    score_, matches_ = free_names(docs.columns, "score", "matches")
    return score_documents(docs, model, score_, matches_).where(F.col(score_) < cutoff).select(*docs.columns)
