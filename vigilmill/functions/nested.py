"""Nested JSON text read natively: in document order by its tokens, and as a table of leaves by VARIANT.

Functions over a column read the text's tokens, at any depth.  `leaves` unfolds a document into one row a leaf, down to a stated
depth, in one pass of generators; `rebuilt` writes documents from such rows again, so that a change of a nested document is a
change of rows: a leaf is dropped, cut to a prefix of its path, or given another value.

Text that is no JSON (or repeats a key in an object) has no leaves and null for the rest; `leaf_text` reads it as one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilmill.functions.normalize import readable_view

#: Levels that `leaves` unfolds; what lies deeper is one leaf of kind `deep`.
DEPTH = 16
#: Levels of objects and lists that a schema may have.
MOST_LEVELS = 64

# Control characters do not stand in JSON strings as they are, so two of them can stand for an escaped backslash and quote.
_BACKSLASH, _QUOTE = "\x01", "\x02"
_NUMBER = r"-?[0-9][0-9.eE+\-]*"


def parsed(json: Column) -> Column:
    return F.try_parse_json(json)


def _masked(json: Column) -> Column:
    """The text with escaped backslashes and quotes out of the way: each string is then what stands between two quotes."""
    return F.replace(F.replace(json, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))


def _string(token: Column) -> Column:
    """What a string token says."""
    back = F.replace(F.replace(token, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
    plain = ~token.rlike(r"[\\\x01\x02]")
    return F.when(plain, F.substr(token, F.lit(2), F.length(token) - 2)).otherwise(F.try_variant_get(parsed(back), "$", "string"))


def leaf_text(json: Column) -> Column:
    """Keys, strings and numbers in document order, one a line; true, false and null are left out, numbers stay as written."""
    tokens = F.regexp_extract_all(_masked(json), F.lit(f'"[^"]*"|{_NUMBER}'), F.lit(0))
    lines = F.transform(tokens, lambda t: F.when(t.startswith('"'), _string(t)).otherwise(t))
    return F.when(parsed(json).isNotNull(), F.array_join(lines, "\n")).otherwise(json)


def values_text(json: Column) -> Column:
    """Strings without keys: what is in one object stands in one line, items of lists in lines of their own; `|`, `,` and `;` read as blanks."""
    tokens = F.regexp_extract_all(_masked(json), F.lit(r',\s*"[^"]*"\s*:|\{\s*"[^"]*"\s*:|,|"[^"]*"'), F.lit(0))
    said = lambda t: F.when(t == ",", "\n").when(t.startswith(","), " ").when(t.startswith("{"), "").otherwise(F.translate(_string(t), "|,;", "   "))
    return F.when(parsed(json).isNotNull(), F.array_join(F.transform(tokens, said), ""))


def ascii_json(json: Column) -> Column:
    """JSON with every character beyond ASCII written as its UTF-16 escapes."""
    units = F.regexp_extract_all(F.hex(F.encode(json, "UTF-16BE")), F.lit("...."), F.lit(0))
    written = F.array_join(F.transform(units, lambda u: F.when(u < "0080", F.char(F.conv(u, 16, 10).cast("bigint"))).otherwise(F.concat(F.lit("\\u"), F.lower(u)))), "")
    return F.when(json.rlike(r"[^\x00-\x7f]"), written).otherwise(json)


def canonical_json(json: Column) -> Column:
    """The document with sorted keys, without blanks, in ASCII; numbers of equal value are written alike (1.0 as 1)."""
    return ascii_json(F.to_json(parsed(json)))


def stable_hash(json: Column) -> Column:
    """SHA-256 of the canonical form: equal for documents that differ in order of keys, blanks and escapes alone."""
    return F.sha2(canonical_json(json).cast("binary"), 256)


def levels(json: Column) -> Column:
    """How deep objects and lists nest, empty ones not counted; of text that is no JSON too, as far as its brackets say."""
    bare = F.regexp_replace(F.regexp_replace(_masked(json), '"[^"]*"', "0"), r"\{\s*\}|\[\s*\]", "0")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, mark: Column) -> Column:
        now = s["now"] + F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(marks, zero, step, lambda s: s["most"])


def too_deep(json: Column, most: int = MOST_LEVELS) -> Column:
    """Whether objects and lists nest in more than `most` levels."""
    return levels(json) > most


def held(rows: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """The kept columns and new ones, each computed once: filters and later columns do not repeat their expressions, as they do over a plain select."""
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def leaves(docs: DataFrame, json: str, *by: str, depth: int = DEPTH) -> DataFrame:
    """(*by, path, kind, text, json): a row for each string, number, boolean, null and empty object or list of a JSON column.

    path: array<struct<key,pos>> from the top, key null in lists.  kind: string, number, boolean, null, object, array (both empty) or deep.
    text: what a string says, else as in JSON.  json: the leaf as JSON.

    Documents are dealt by their keys first: a table of many small ones is one file that one task would unfold, and what groups the leaves by
    these keys again needs no further exchange.
    """
    spark = docs.sparkSession
    rows = docs.repartition(*map(F.col, by)).select(*by, parsed(F.col(json)).alias("_v0")).where("_v0 is not null")
    for i in range(1, depth + 1):
        rows = rows.lateralJoin(spark.tvf.variant_explode_outer(F.col(f"_v{i - 1}").outer()).toDF(f"_p{i}", f"_k{i}", f"_v{i}"))
    every = F.array(*[F.struct(F.col(f"_k{i}").alias("key"), F.col(f"_p{i}").alias("pos")) for i in range(1, depth + 1)])
    leaf = F.coalesce(*[F.col(f"_v{i}") for i in range(depth, -1, -1)])
    rows = held(rows, list(by), path=F.filter(every, lambda s: s["pos"].isNotNull()), _leaf=leaf, json=F.to_json(leaf))
    kind = (
        F.when(F.col("json").startswith('"'), "string").when(F.col("json").isin("true", "false"), "boolean").when(F.col("json") == "null", "null")
        .when(F.col("json") == "{}", "object").when(F.col("json") == "[]", "array").when(F.col("json").rlike(r"\A[\[{]"), "deep").otherwise("number")
    )
    text = F.when(F.col("json").startswith('"'), F.try_variant_get("_leaf", "$", "string")).otherwise(F.col("json"))
    return held(rows, [*by, "path", "json"], kind=kind, text=text).select(*by, "path", "kind", "text", "json")


def path_text(path: Column) -> Column:
    """`a.0.b` of a path."""
    return F.array_join(F.transform(path, lambda s: F.coalesce(s["key"], s["pos"].cast("string"))), ".")


def rebuilt(rows: DataFrame, *by: str) -> DataFrame:
    """(*by, json): documents in canonical order from (*by, path, json) rows.

    Of rows with one path any stays (they are to be equal), and a row whose path another goes on is dropped, so that
    `{}` or `[]` at a prefix stands only where nothing is left below it.  Gaps in lists close up.
    """
    order = Window.partitionBy(*by).orderBy("path")
    after = F.lead("path").over(order)
    extended = F.coalesce(F.slice(after, F.lit(1), F.greatest(F.size("path"), F.lit(1))) == F.col("path"), F.lit(False)) | (after.isNotNull() & (F.size("path") == 0))
    kept = rows.select(*by, "path", "json").withColumn("_gone", extended).where("not _gone").drop("_gone")
    before = F.lag("path").over(order)
    kept = kept.withColumn("_before", before).withColumn("_after", F.lead("path").over(order))
    shared = lambda other: F.when(other.isNull(), 0).otherwise(F.array_position(F.zip_with("path", other, lambda a, b: a.eqNullSafe(b)), False).cast("int") - 1)
    opened = lambda s: F.when(s["key"].isNotNull(), "{").otherwise("[")
    # A key as JSON: the one item of a list, without the list's brackets.
    named = lambda s: F.when(s["key"].isNotNull(), F.concat(F.regexp_replace(F.regexp_replace(F.to_json(F.array(s["key"])), r"\A\[", ""), r"\]\z", ""), F.lit(":"))).otherwise(F.lit(""))
    kept = kept.withColumn("_same", shared(F.col("_before"))).withColumn("_next", shared(F.col("_after")))
    rest = F.slice("path", F.col("_same") + 1, F.greatest(F.size("path") - F.col("_same"), F.lit(0)))
    heads = F.transform(rest, lambda s, i: F.concat(F.when((i == 0) & F.col("_before").isNotNull(), ",").otherwise(opened(s)), named(s)))
    ended = F.when(F.col("_after").isNull(), F.size("path")).otherwise(F.size("path") - F.col("_next") - 1)
    closing = F.reverse(F.slice("path", F.size("path") - ended + 1, ended))
    tails = F.transform(closing, lambda s: F.when(s["key"].isNotNull(), "}").otherwise("]"))
    piece = F.concat(F.array_join(heads, ""), F.col("json"), F.array_join(tails, ""))
    pieces = kept.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("path", piece.alias("piece")))).alias("_pieces"))
    return pieces.select(*by, F.array_join(F.transform("_pieces", lambda x: x["piece"]), "").alias("json"))


def argument_surface(docs: DataFrame, json: str, *by: str, depth: int = DEPTH) -> DataFrame:
    """(*by, surface): the document's leaves as `keys = value`, all of it as rules read it, sorted, one a line.

    Keys that become equal only by reading stay two lines.  Positions in lists are written in brackets.  Documents without leaves have no row.
    """
    found = leaves(docs, json, *by, depth=depth)
    said = F.concat_ws(" ", F.concat_ws(".", F.transform("path", lambda s: F.coalesce(s["key"], F.concat(F.lit("["), s["pos"], F.lit("]"))))), F.lit("="), F.col("text"))
    read = F.trim(F.regexp_replace(readable_view(said), r"\s+", " "))
    return found.select(*by, read.alias("line")).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("surface"))


def joined_blocks(docs: DataFrame, json: str, *by: str, depth: int = DEPTH) -> DataFrame:
    """(*by, path, spaced, glued): for each list of two or more text blocks, the blocks with a blank between them and with nothing.

    A block is a string of the list or the `text` of an object in it, in the list's order.
    """
    found = leaves(docs, json, *by, depth=depth).where(F.col("kind") == "string")
    last, size = F.try_element_at("path", F.lit(-1)), F.size("path")
    of_object = (F.coalesce(last["key"], F.lit("")) == "text") & (size > 1) & F.when(size > 1, F.get("path", size - 2)["key"].isNull())
    of_list = (size > 0) & last["key"].isNull()
    blocks = found.where((size > 0) & (of_object | of_list))
    at = F.when(of_list, size - 1).otherwise(size - 2)
    blocks = blocks.select(*by, F.slice("path", F.lit(1), at).alias("path"), F.get("path", at)["pos"].alias("_i"), "text")
    joined = blocks.groupBy(*by, "path").agg(F.array_sort(F.collect_list(F.struct("_i", "text"))).alias("_b")).where(F.size("_b") > 1)
    texts = F.transform("_b", lambda b: b["text"])
    return joined.select(*by, path_text(F.col("path")).alias("path"), F.array_join(texts, " ").alias("spaced"), F.array_join(texts, "").alias("glued"))
