"""Language identification by a byte convolutional network trained in numpy.

Windows of a fixed number of bytes pass through filters of several widths over one-hot bytes (so a filter is a table
with a row for each byte at each offset), rectification, max pooling over the window and a softmax.  A text is cut into
consecutive windows; all of them count, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Labelled rows of each language that a model is fitted on at most (about); all windows of a row are read.
SAMPLE_ROWS = 800
#: Values of lang that are learned, the most frequent ones, and rows of all of them together.
LANGUAGES = 1000
SAMPLE_TOTAL = 40_000
EPOCHS = 7
#: Windows that are convolved at once.
BATCH = 64


@dataclass
class Network:
    """tables[w]: float32[w, 256, filters]; bias: float32[len(widths) * filters]; out: float32[.., languages]."""

    languages: tuple[str, ...]
    tables: tuple[np.ndarray, ...]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray, places: bool = False):
        """float32[n, features] of uint8[n, window]; with `places` also where each maximum was."""
        parts, at = [], []
        for table in self.tables:
            w = len(table)
            n = windows.shape[1] - w + 1
            total = table[0][windows[:, :n]]
            for k in range(1, w):
                total += table[k][windows[:, k : k + n]]
            if places:
                p = total.argmax(axis=1)
                at.append(p)
                parts.append(np.take_along_axis(total, p[:, None, :], axis=1)[:, 0])
            else:
                parts.append(total.max(axis=1))
        x = np.maximum(np.concatenate(parts, axis=1) + self.bias, 0)
        return (x, np.concatenate(at, axis=1)) if places else x

    def log_odds(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for lo in range(0, len(windows), BATCH):
            z = self.pooled(windows[lo : lo + BATCH]) @ self.out + self.out_bias
            z -= z.max(axis=1, keepdims=True)
            out[lo : lo + BATCH] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out


def cut_windows(text: str, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """uint8[n, size] and the bytes of the text in each; the last is filled with zeros."""
    raw = text.encode("utf-8", "replace")
    n = max(1, -(-len(raw) // size))
    data = np.frombuffer(raw.ljust(n * size, b"\0"), np.uint8).reshape(n, size)
    return data, np.minimum(size, len(raw) - np.arange(n) * size)


def train(windows: np.ndarray, labels: np.ndarray, languages: tuple[str, ...], widths=WIDTHS, filters: int = FILTERS, epochs: int = EPOCHS, seed: int = 1) -> Network:
    """Adagrad over shuffled batches; gradients reach a filter's tables at the bytes of its maxima alone."""
    rng = np.random.default_rng(seed)
    features = len(widths) * filters
    net = Network(
        languages, tuple((rng.standard_normal((w, 256, filters)) * 0.3).astype(np.float32) for w in widths),
        np.zeros(features, np.float32), (rng.standard_normal((features, len(languages))) * 0.2).astype(np.float32), np.zeros(len(languages), np.float32),
    )
    params = [*net.tables, net.bias, net.out, net.out_bias]
    seen = [np.full_like(p, 1e-3) for p in params]
    weight = len(labels) / (len(languages) * np.maximum(1, np.bincount(labels, minlength=len(languages))))
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            x, y = windows[pick], labels[pick]
            h, at = net.pooled(x, places=True)
            z = h @ net.out + net.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = z / z.sum(axis=1, keepdims=True)
            d[np.arange(len(y)), y] -= 1
            d *= (weight[y] / len(y))[:, None].astype(np.float32)
            dh = (d @ net.out.T) * (h > 0)
            grads = [np.zeros_like(t) for t in net.tables] + [dh.sum(axis=0), h.T @ d, d.sum(axis=0)]
            for t, w in enumerate(widths):
                part = dh[:, t * filters : (t + 1) * filters]
                where = at[:, t * filters : (t + 1) * filters]
                f = np.broadcast_to(np.arange(filters), part.shape)
                for k in range(w):
                    np.add.at(grads[t][k], (np.take_along_axis(x, where + k, axis=1), f), part)
            for p, s, g in zip(params, seen, grads):
                s += g * g
                p -= 0.1 * g / np.sqrt(s)
    return net


def crc_part(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def fit(docs: DataFrame, allowed: Column, sample_rows: int = SAMPLE_ROWS, languages: int = LANGUAGES, sample_total: int = SAMPLE_TOTAL) -> Network | None:
    """A network from text and lang of the allowed rows with both; None if there is none.

    The `languages` most frequent values of lang are learned (ties by name); rarer ones are never predicted.  Of each about `sample_rows` rows
    are taken by a hash of doc_id and text (all, if it has no more), fewer where they would be over `sample_total` in all; copies of a text count
    once.  The whole texts of the sampled rows come to the driver, and nothing else but the counts of those languages.
    """
    labelled = docs.where(allowed).where("lang is not null and text is not null").select("doc_id", "lang", "text")
    totals = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not totals:
        return None
    rate = max(1, min(sample_rows, sample_total // len(totals)))
    upto = docs.sparkSession.createDataFrame([(r["lang"], max(1, min((1 << 63) - 1, (rate << 63) // r["count"]))) for r in totals], "lang string, _upto bigint")
    chosen = labelled.join(F.broadcast(upto), "lang")  # a row for each of the languages
    sample = chosen.where(F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit("language")), 1) < F.col("_upto")).select("lang", "text").distinct().toPandas()
    rows = [(bytes(w), lang) for lang, text in zip(sample["lang"], sample["text"]) if has_letter(text) for w in cut_windows(text)[0]]
    if not rows:
        return None
    rows.sort()  # whatever the order in which they came
    languages = tuple(sorted(set(lang for _, lang in rows)))
    windows = np.frombuffer(b"".join(x for x, _ in rows), np.uint8).reshape(-1, WINDOW)
    number = {lang: i for i, lang in enumerate(languages)}
    return train(windows, np.array([number[lang] for _, lang in rows]), languages)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score of every row: the mean log probability of its windows, by bytes, as a softmax.

    Texts that are null or have no letter, and all texts where nothing could be learned, are `und` with score 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            for lo in range(0, len(texts), 256):
                chosen = [i for i in range(lo, min(lo + 256, len(texts))) if net is not None and has_letter(texts[i])]
                if not chosen:
                    continue
                cuts = [cut_windows(texts[i]) for i in chosen]
                logs = net.log_odds(np.concatenate([c[0] for c in cuts]))
                logs = logs * np.concatenate([c[1] for c in cuts])[:, None]
                firsts = np.cumsum([0] + [len(c[1]) for c in cuts[:-1]])
                mean = np.add.reduceat(logs, firsts, axis=0) / np.array([c[1].sum() for c in cuts])[:, None]
                z = np.exp(mean - mean.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
                for i, p in zip(chosen, z):
                    names[i], scores[i] = net.languages[int(p.argmax())], float(min(1.0, p.max()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
