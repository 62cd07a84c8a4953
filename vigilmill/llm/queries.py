"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilmill.llm import conversation_repair, divergence, language_id, licenses, line_dedup, mixing, order_minhash, packing, simhash_dedup, tiff, tokens, toxicity, uniform_shards
from vigilmill.llm.common import table


def op1_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a TIFF file and read back: one row a document; null and empty texts are fill bytes alone, equal texts have equal values, repeated rows stay, other columns are not read."""
    return tiff.text_media(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every text, learned from labels of rows that are not held out: one row a document; null and empty texts score as a text without a match, equal texts alike, a null doc_id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = toxicity.crc_part(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score_documents(docs, model)
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= toxicity.CUTOFF).cast("int").alias("predicted"), F.col("__matches").alias("matches"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence words, places and labels of every text: one row a document; null and empty texts have none and score 0, repeated rows have equal results."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from rows that are not held out: one row a document; null texts and such without a letter are `und`, a null doc_id or lang is not learned from, equal odds go to the first language in order."""
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.crc_part(F.col("doc_id"), 4) == 2
    net = language_id.fit(docs, F.coalesce(~held_out, F.lit(False)))
    found = language_id.predict(docs, net)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without lines that repeat an earlier one: one row a document; a null text has 0 lines, lines without a word stay, of equal lines the first by (doc_id, line) stays, repeated rows of one doc_id and text are one document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = line_dedup.dedup_lines(docs)
    return cleaned.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars_left"), "text")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text: one row a document; null and empty texts have 0 tokens, repeated rows stay."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text: one row a document; null texts are empty, two empty texts have likeness 1, documents of one doc_id follow each other by text, the last is followed by the first."""
    return order_minhash.fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences: each id of each document in one piece; null and empty texts are the closing id alone, repeated rows are documents of their own."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text: one row a document; null, empty and blank texts have fingerprint 0 and belong together, ties in doc_id do not matter, component_id is null only where every doc_id of a group is."""
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document: one row a document; null texts have size 0 and are taken in whole copies alone, a null source is a source, rows of one doc_id and text share their draw."""
    mixed = mixing.pareto_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage, faults, cheapest repair and its hash: one row for every conv_id of the table, a null one too; a conversation all of whose rows are dropped has zeros, an empty audit and the hash of nothing; rows of equal turn go by role and text hash."""
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    found = conversation_repair.repair_report(damaged)
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "repaired_rows")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ: every pair, and the ten terms of each source above the language's share; nulls are empty strings and groups of their own, a row is a document, ties go by item."""
    return divergence.divergences(table(spark, sf_dir, "documents"))


def op13_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 8 shards whose counts are at most one apart: one row a document; a null text has size 1 and the CRC of nothing, equal texts and repeated rows are dealt each for itself."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = uniform_shards.uniform_shards(docs, shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_ALL = (op1_tiff, op2_toxicity, op3_licenses, op4_language_id, op5_line_dedup, op6_token_counts, op7_order_minhash, op8_packing, op9_simhash, op10_mixing, op11_conversation_repair, op12_source_divergence, op13_uniform_shards)
QUERIES = {q.__name__: q for q in _ALL}
ORACLE_SQL: dict[str, str] = {"op10_mixing": mixing.ORACLE_SQL, "op11_conversation_repair": conversation_repair.ORACLE_SQL, "op12_source_divergence": divergence.ORACLE_SQL}
