"""Licence scan by a positional index of rare tokens, in DataFrame functions only.

Licence texts are cut into clauses of up to `CLAUSE` words, so that a word more or less breaks one clause and not the text.  The
words of all clauses and phrases form the licence vocabulary, whose inverse document frequency is counted over the whole
corpus.  The index maps each clause's rarest words to postings (clause, position).  A file looks up the places of its own
indexed words; a place minus a posting's position proposes a start, and the postings of a clause are intersected by that
relative position: a start stands if enough of the clause's indexed words propose it.  There the clause is verified word for word,
and a licence counts if the clauses found hold enough of its rarity and all of its mandatory key phrases stand in the file.

All of it is array work inside a row, linear in the file's words but for one sort of the proposals, so files are never
exploded or shuffled; only the vocabulary's counts are.
"""

from __future__ import annotations

import math
import re
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilmill.llm.license_texts import PHRASES, TEMPLATES

#: Words of a clause at most, and its rarest words that are indexed.
CLAUSE = 24
KEYS = 6
#: Indexed words of a clause that have to agree on its start (all, if it has fewer).
AGREE = 3
#: Share of a clause's rarity that must stand in place, and of a licence's rarity that its clauses must hold.
IN_PLACE = 0.8
LEAST = 0.6
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Proposals are integers: item, then place less position, kept positive.
_BITS, _SHIFT = 34, 1 << 20
_ITEM = 1 << _BITS


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def clauses(text: str, most: int = CLAUSE) -> list[list[str]]:
    """The words of a licence text in even runs of `most` at most, cut at sentences where these are longer than three words."""
    parts: list[list[str]] = []
    for sentence in re.split(r"[.;:](?=\s|$)", text):
        words = _words(sentence)
        if parts and len(words) < 4:
            parts[-1] += words
        elif words:
            parts.append(words)
    found = []
    for words in parts:
        n = -(-len(words) // most)
        found += [words[len(words) * i // n : len(words) * (i + 1) // n] for i in range(n)]
    return found


def words_of(text: Column) -> Column:
    """array<string>: the words of a text with A-Z in lower case."""
    text = F.coalesce(text, F.lit(""))
    # Two letters beyond ASCII have ASCII lower case; texts with them go letter by letter.
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lower = F.when(text.rlike("[\\u0130\\u212A]"), plain).otherwise(F.lower(text))
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def rarity(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """ln((1 + n) / (1 + df)) + 1 of each word of the vocabulary over all rows; at most the vocabulary comes to the driver."""
    held = F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary)))
    found = docs.select(F.explode(F.array_append(held, F.lit(""))).alias("w")).groupBy("w").count().collect()
    df = {r["w"]: r["count"] for r in found}
    n = df.get("", 0)
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}


def rarest(words: list[str], idf: dict[str, float], keys: int) -> list[str]:
    """The `keys` rarest words, the earlier of equals."""
    return sorted(set(words), key=lambda w: (-idf[w], words.index(w)))[:keys]


def _let(value: Column, use) -> Column:
    """use(value), with value computed once for a row however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _literal(value) -> str:
    """SQL of a word, a number or a list of such; words are letters and digits alone."""
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(_literal, value))})"
    return f"'{value}'" if isinstance(value, str) else f"{value!r}D" if isinstance(value, float) else f"{value}L" if value > 1 << 30 else str(value)


def literal(values: list, kind: str) -> Column:
    return F.expr(f"cast({_literal(values)} as array<{kind}>)")


def _proposals(words: Column, index: dict[str, list[int]]) -> Column:
    """array<bigint>, ascending: what the places of indexed words propose.  Words are looked up in a table of hash slots, so a word costs the same however large the index is."""
    slots = 1 << max(4, (2 * len(index)).bit_length())
    table: list[list[str]] = [[] for _ in range(slots)]
    for w in sorted(index):
        table[crc32(w.encode()) % slots].append(f"named_struct('w', '{w}', 'posts', cast({_literal(index[w])} as array<bigint>))")
    looked_up = F.expr(f"cast(array({', '.join(f'array({", ".join(slot)})' for slot in table)}) as array<array<struct<w:string,posts:array<bigint>>>>)")

    def posts(w: Column, i: Column) -> Column:
        slot = F.get(looked_up, F.pmod(F.crc32(w.cast("binary")), F.lit(slots)).cast("int"))
        return F.flatten(F.transform(F.filter(slot, lambda e: e["w"] == w), lambda e: F.transform(e["posts"], lambda p: p + i)))

    return F.sort_array(F.flatten(F.transform(words, posts)))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, keys: int = KEYS, agree: int = AGREE, in_place: float = IN_PLACE, least: float = LEAST) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts every place of every phrase; first_word and last_word are the least and greatest start, null without any.
    score is the greatest share of a licence's rarity in verified clauses, 1 where a phrase stands; licences with a
    key phrase missing count nothing.  Null and empty texts have 0 words, no labels and score 0; repeated rows have equal
    results; other columns are not read.
    """
    parts = [clauses(t) for _, t, _ in templates]
    key_phrases = sorted({k for _, _, ks in templates for k in ks})
    items = [c for found in parts for c in found] + [_words(p) for p, _ in phrases] + [_words(k) for k in key_phrases]
    n_clauses = sum(map(len, parts))
    n_phrases = n_clauses + len(phrases)
    vocabulary = sorted({w for ws in items for w in ws})
    idf = rarity(docs, vocabulary)

    # A phrase is looked up by its rarest word, at every place that this has in it, and must stand in full.
    index: dict[str, list[int]] = {}
    needed = []
    for i, ws in enumerate(items):
        rare = rarest(ws, idf, keys if i < n_clauses else 1)
        needed.append(min(agree, len(rare)) if i < n_clauses else 1)
        for at, w in enumerate(ws):
            if w in rare:
                index.setdefault(w, []).append(i * _ITEM + _SHIFT - at)

    words = F.col("words")
    item_words, item_weights = literal(items, "array<string>"), literal([[idf[w] for w in ws] for ws in items], "array<double>")
    demands = literal([in_place * sum(idf[w] for w in ws) if i < n_clauses else sum(idf[w] for w in ws) - 1e-9 for i, ws in enumerate(items)], "double")

    def stands(p: Column) -> Column:
        """Whether an item has enough of its rarity in place at a proposed start."""
        item, start = F.shiftright(p, _BITS).cast("int"), (p.bitwiseAND(F.lit(_ITEM - 1)) - _SHIFT).cast("int")
        mine, there = F.get(item_words, item), F.slice(words, start + 1, F.size(F.get(item_words, item)))
        # Beyond the end of the file zip_with pads with null, which equals nothing.
        hits = F.zip_with(F.zip_with(mine, there, lambda a, b: F.coalesce(a == b, F.lit(False))), F.get(item_weights, item), lambda ok, w: F.when(ok, w).otherwise(F.lit(0.0)))
        return (start >= 0) & (F.aggregate(F.when(start >= 0, hits), F.lit(0.0), lambda a, x: a + x) >= F.get(demands, item))

    def met(sorted_: Column) -> Column:
        """Each proposal once, if as many indexed words as its item needs agree on it."""
        last = lambda p, i: i + F.get(literal(needed, "int"), F.shiftright(p, _BITS).cast("int")) - 1
        return F.filter(sorted_, lambda p, i: ((i == 0) | (F.get(sorted_, i - 1) != p)) & F.coalesce(F.get(sorted_, last(p, i)) == p, F.lit(False)))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), words_of(F.col("text")).alias("words"))
    # A file without any indexed word has nothing to look up.
    some = F.arrays_overlap(words, literal(sorted(index), "string"))
    found = F.when(some, F.filter(_let(_proposals(words, index), met), stands)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("doc_id", F.size("words").cast("bigint").alias("n_words"), found.alias("found"))
    rows = rows.withColumn("items", F.array_distinct(F.transform("found", lambda p: F.shiftright(p, _BITS).cast("int"))))
    base = F.filter("found", lambda p: (p >= F.lit(n_clauses * _ITEM)) & (p < F.lit(n_phrases * _ITEM)))
    rows = rows.withColumn("base", F.transform(base, lambda p: F.struct(F.shiftright(p, _BITS).cast("int").alias("item"), (p.bitwiseAND(F.lit(_ITEM - 1)) - _SHIFT).alias("start"))))

    described, at = [], 0
    for (label, _, ks), cs in zip(templates, parts):
        weights = [sum(idf[w] for w in c) for c in cs]
        held = ", ".join(f"named_struct('item', {at + j}, 'share', {_literal(w / sum(weights))})" for j, w in enumerate(weights))
        described.append(f"named_struct('label', '{label}', 'clauses', array({held}), 'keys', {_literal([n_phrases + key_phrases.index(k) for k in ks])})")
        at += len(cs)

    def share(t: Column) -> Column:
        total = F.aggregate(F.filter(t["clauses"], lambda c: F.array_contains("items", c["item"])), F.lit(0.0), lambda a, c: a + c["share"])
        return F.when(F.size(F.array_except(t["keys"], F.col("items"))) == 0, total).otherwise(F.lit(0.0))

    shares = F.transform(F.expr(f"array({', '.join(described)})"), lambda t: F.struct(t["label"].alias("label"), share(t).alias("share")))
    nothing = F.array().cast("array<struct<label:string,share:double>>")
    rows = rows.withColumn("licences", F.when(F.size("items") > 0, F.filter(shares, lambda t: t["share"] >= least)).otherwise(nothing))
    names = literal([n for _, n in phrases], "string")
    base_labels = F.array_distinct(F.transform("base", lambda p: F.get(names, p["item"] - n_clauses)))
    starts = F.transform("base", lambda p: p["start"])
    best = F.coalesce(F.array_max(F.transform("licences", lambda t: t["share"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.transform("licences", lambda t: t["label"]))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), best)).alias("score"),
    )
