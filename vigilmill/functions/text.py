"""Native text columns: content tokens, shingles, windows, chunks, sentences, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without content.
STOP_WORDS = tuple(
    "a about above after again all also am an and any are as at be been being but by can could did do does doing during each etc for from had has have having he her here "
    "hers him his how i if in into is it its itself just let me more most my of off on once only or other our ours out over own per please s same she should so some such t "
    "than that the their them then there these they this those through to too under until up us very via was we were what when where which while who whom why will with would "
    "you your yours".split()
)
#: Placeholders of masked values: words of a text, but not content of their own.
PLACEHOLDERS = ("xurl", "xemail", "xpath", "xid")

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
LONG_NUMBER = r"[0-9]{9,}"
URL = r"https?://[^\x00-\x20\"<>]+"


def masked(text: Column) -> Column:
    """URLs, e-mail addresses, IPv4 addresses and long numbers replaced by placeholders."""
    for pattern, mark in ((URL, "<url>"), (EMAIL, "<email>"), (IPV4, "<ip>"), (LONG_NUMBER, "<number>")):
        text = F.regexp_replace(text, pattern, mark)
    return text


def value_masked(text: Column) -> Column:
    """URLs, e-mail addresses, paths and long numbers as the placeholder words of `content_tokens`."""
    for pattern, mark in ((URL, " xurl "), (EMAIL, " xemail "), (r"(?:~|\.{1,2})?(?:/[\w.-]+){2,}/?", " xpath "), (r"\b(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}|[A-Za-z]{1,8}-[0-9]{4,}|[0-9]{9,})\b", " xid ")):
        text = F.regexp_replace(text, pattern, mark)
    return text


def content_tokens(text: Column) -> Column:
    """Lower-case ASCII words of two letters or more with values masked and without stop words; -ing off words of over five letters, else -s (not -ss) off those of over three."""
    words = F.regexp_extract_all(F.lower(value_masked(text)), F.lit("[a-z]+"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))
    return F.transform(kept, stemmed)


def stemmed(w: Column) -> Column:
    return (
        F.when((F.length(w) > 5) & w.endswith("ing"), F.left(w, F.length(w) - 3))
        .when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.left(w, F.length(w) - 1))
        .otherwise(w)
    )


def content_words(words: Column) -> Column:
    """How many words are no placeholders."""
    return F.size(F.filter(words, lambda w: ~w.isin(*PLACEHOLDERS)))


def grams(words: Column, n: int = 3) -> Column:
    """Distinct n-grams of an array of words; the whole if it has fewer words, none if it has none."""
    some = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, F.array_distinct(some)).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def head_and_tail(text: Column, limit: int = 20_000) -> Column:
    """First and last half of a text over the limit, joined by a newline."""
    half = limit // 2
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(half)), F.lit("\n"), F.right(text, F.lit(half)))).otherwise(text)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once for a row however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_chunks(text: Column, size: int = 48, stride: int = 32, most: int | None = 32) -> Column:
    """Overlapping windows of blank-separated words; one window for a short text, `most` at most (None: all of the text)."""

    def cut(words: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(words) - size) / stride).cast("int"))
        last = F.least(F.lit(most - 1), last) if most else last
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * stride + 1, size), " "))

    return _let(F.filter(F.split(text, "[ \t\r\n]+"), lambda w: w != ""), cut)


def sentences(text: Column) -> Column:
    """Sentences end after . ! ? before a blank, or at a newline."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n"), "\n"), lambda s: F.trim(s) != "")


def char_windows(text: Column, size: int = 1000, most_overlap: int = 16) -> Column:
    """Overlapping windows of characters.  The text is cut into steps in one pass; a window is a step and the start of the next one."""
    over = min(size // 5, most_overlap)
    step = size - over

    def joined(cuts: Column) -> Column:
        following = lambda i: F.coalesce(F.left(F.get(cuts, i + 1), F.lit(over)), F.lit(""))
        n = F.size(cuts)
        # A last step that lies within the overlap of the one before it is no window of its own.
        last = F.when((n > 1) & (F.length(F.get(cuts, n - 1)) <= over), n - 2).otherwise(n - 1)
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(F.get(cuts, i), following(i)))

    cuts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(_let(cuts, joined))
