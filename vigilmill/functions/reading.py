"""What of a long text is worth reading: encoded runs put away by their entropy, and a budgeted choice of windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilmill.functions import text as tx

#: Characters of an encoded run, of its alphabet, and bits a character at least.
FLOOR, ALPHABET, BITS = 400, 16, 5.0
# What a request to a reader looks like.
CUES = ("you", "your", "assistant", "agent", "ai", "please", "send", "forward", "email", "upload", "share", "post", "call", "run", "delete", "transfer", "pay", "must", "should")
CUE = r"(?i)@|https?://|\b(?:" + "|".join(CUES) + r")\b"
_RUN = rf"[A-Za-z0-9+/=_\-\r\n]{{{FLOOR},}}"
_WORD = r"(?<![A-Za-z0-9])(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*|[A-Z]{2,})(?![A-Za-z0-9])"


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def entropy(text: Column) -> Column:
    """Shannon's entropy of a text's characters in bits; 0 for an empty one."""

    def bits(chars: Column) -> Column:
        counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars))
        return F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return F.when(F.length(text) > 0, _let(F.split(text, ""), bits)).otherwise(F.lit(0.0))


def is_blob(run: Column) -> Column:
    """Whether a long run is data and not words: hexadecimal, or characters spread as an encoding spreads them with few words between its joints."""

    def judged(flat: Column) -> Column:
        pieces = F.filter(F.split(flat, "[+/=_-]+"), lambda p: p != "")
        words = F.size(F.filter(pieces, lambda p: p.rlike("^[A-Za-z]{2,15}$")))
        mixed = F.size(F.array_distinct(F.split(flat, ""))) >= ALPHABET
        return (F.length(flat) >= FLOOR) & mixed & (flat.rlike(r"\A[0-9A-Fa-f]+\z") | ((entropy(flat) >= BITS) & (words * 2 < F.size(pieces))))

    return _let(F.regexp_replace(run, r"[\r\n]", ""), judged)


def without_blobs(text: Column) -> Column:
    """The text with each encoded run of FLOOR characters or more as a note of its length and the words found in it; one pass, line breaks belong to a run."""
    form = rf"((?s:.*?))(?:({_RUN})|\z)"

    def note(run: Column) -> Column:
        words = F.filter(F.regexp_extract_all(run, F.lit(_WORD), F.lit(0)), lambda w: F.length(w).between(2, 24))
        said = F.concat(F.lit("["), F.length(F.regexp_replace(run, r"[\r\n]", "")), F.lit(" base64-like characters omitted"))
        return F.concat(said, F.when(F.size(words) > 0, F.concat(F.lit("; words in it: "), F.array_join(words, " "))).otherwise(""), F.lit("]"))

    parts = F.zip_with(F.regexp_extract_all(text, F.lit(form), F.lit(1)), F.regexp_extract_all(text, F.lit(form), F.lit(2)), lambda gap, run: F.concat(gap, F.when((run != "") & is_blob(run), note(run)).otherwise(run)))
    return F.when(text.rlike(_RUN), F.array_join(parts, "")).otherwise(text)


def chosen_windows(text: Column, size: int, limit: int, overlap: int, seed: Column) -> Column:
    """struct<kept, unread>: overlapping windows of a text, `limit` at most, in order, and how many were left.

    The first and the last are kept; half of the other places go to the windows with most cues of a request (ties: the earlier), the rest by a
    seeded hash, so that a writer who fills the text with decoys cannot tell which are read.  limit: 2 or more.
    """

    def choose(parts: Column) -> Column:
        n, places = F.size(parts), limit - 2
        half = (places + 1) // 2
        inner = F.filter(F.transform(parts, lambda w, i: F.struct((-F.regexp_count(w, F.lit(CUE))).alias("order"), i.alias("i"))), lambda x: (x["i"] > 0) & (x["i"] < n - 1))

        def rest(ranked: Column) -> Column:
            left = F.transform(F.slice(ranked, half + 1, F.greatest(n, F.lit(1))), lambda x: F.struct(F.md5(F.concat_ws(":", seed, x["i"]).cast("binary")).alias("order"), x["i"].alias("i")))
            at = F.concat(F.array(F.lit(0), n - 1), F.transform(F.slice(ranked, 1, half), lambda x: x["i"]), F.transform(F.slice(F.array_sort(left), 1, places - half), lambda x: x["i"]))
            return F.transform(F.array_sort(F.array_distinct(at)), lambda i: F.get(parts, i))

        kept = F.when(n <= limit, parts).otherwise(_let(F.array_sort(inner), rest))
        return F.struct(kept.alias("kept"), F.greatest(n - limit, F.lit(0)).alias("unread"))

    return _let(tx.char_windows(text, size, overlap), choose)
