"""Learning from attacks: what the rules found teaches indicators and fingerprints, which are gated, merged into a snapshot, escalated and capped.

Each batch of attacks is one job over one snapshot: read the last version, add, evict, write the next version and rename it into place.  A
batch that was learned is not learned again, and a writer that another one has overtaken is refused, so a job that is run again after
a failure changes nothing twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilmill.functions import rules as ru
from vigilmill.functions import text as tx
from vigilmill.functions import values as v
from vigilmill.functions.nested import held
from vigilmill.operators import memory, similarity
from vigilmill.sources import snapshots

# Values taken from one attack, words that a fingerprint needs.
MOST_VALUES, LEAST_WORDS = 20, 8

SIGHTINGS = "kind string, value string, host string, run_key string, source string, seen timestamp"
PRINTS = "print_id string, words array<string>, run_key string, seen timestamp"
BATCHES = "batch_id string"


def _sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+|[\r\n]+")


def taught(attacks: DataFrame, allowed: DataFrame) -> DataFrame:
    """(attack_id, value): addresses, accounts and paths within a sentence of one that a rule of outputs fires on, the nearest first, MOST_VALUES of an attack.

    attacks: attack_id, text, trusted (what the user typed); allowed: value, a value or a host that covers what lies under it.  What the user
    named, what is allowed, and shared sites teach nothing.
    """
    # A text is scanned once, row by row, and only sentences beside an order are read for values: nothing else of it is shuffled.
    texts = held(attacks.where("attack_id is not null"), ["attack_id", "trusted"], sentences=_sentences(F.coalesce("text", F.lit(""))))
    scanned = held(texts, ["attack_id", "trusted", "sentences"], fires=F.transform("sentences", lambda s: ru.any_fires(s, "output"))).where(F.col("trusted").isNotNull() | F.array_contains("fires", True))
    # What the user typed goes along without a distance.
    own = F.filter(F.array(F.struct(F.lit(None).cast("int").alias("d"), F.col("trusted").alias("said"))), lambda p: p["said"].isNotNull())
    parts = held(scanned, ["attack_id"], parts=F.concat(similarity.around_hits(F.col("sentences"), F.col("fires"), 1), own)).select("attack_id", F.inline("parts"))
    read = held(parts, ["attack_id", "d"], values=v.values(F.col("said")))
    keys = F.when(F.col("d").isNull(), v.keys_of(F.col("values"))).otherwise(v.authority_keys(F.col("values")))
    every = held(read, ["attack_id", "d"], keys=keys).select(F.col("attack_id").alias("doc_id"), "d", F.explode("keys").alias("value"))
    found = similarity.nearest_to_match(every, MOST_VALUES).where("not apart").select(F.col("doc_id").alias("attack_id"), "value")
    found = held(found, ["attack_id", "value"], host=v.domain_of(F.col("value")))
    found = found.where(F.col("host").isNull() | ~v.shared_host(F.col("host")))
    covers = held(found, ["attack_id", "value"], names=F.array_distinct(F.concat(F.array("value"), F.coalesce(v.host_suffixes(F.col("host")), F.array().cast("array<string>")))))
    listed = allowed.select(F.col("value").alias("name"), F.lit(True).alias("spared")).distinct()
    named = covers.select("attack_id", "value", F.explode("names").alias("name")).join(listed, "name", "left")
    return named.groupBy("attack_id", "value").agg(F.count("spared").alias("n")).where("n = 0").select("attack_id", "value")


def fingerprints(attacks: DataFrame, benign: DataFrame) -> DataFrame:
    """(print_id, words, attack_id): content words of each sentence that a rule fires on and of the one after it, of LEAST_WORDS or more, that no benign text (text_id, words) contains."""
    parts = attacks.select("attack_id", _sentences(F.coalesce("text", F.lit(""))).alias("s"))
    pairs = parts.select("attack_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.struct(F.get("s", i).alias("said"), F.concat_ws(" ", F.get("s", i), F.get("s", i + 1)).alias("window")))).alias("x")).select("attack_id", "x.*")
    hits = pairs.where(F.size(ru.scan(F.col("said"), "output")) > 0)
    made = held(hits, ["attack_id"], words=tx.content_tokens(F.col("window")))
    made = made.where(tx.content_words(F.col("words")) >= LEAST_WORDS).withColumn("print_id", F.left(F.sha2(F.array_join("words", " "), 256), F.lit(32)))
    harmless = similarity.contained(made.select("print_id", "words").dropDuplicates(["print_id"]), benign).select("print_id").distinct()
    return made.join(harmless, "print_id", "left_anti").select("print_id", "words", "attack_id")


def revoked_by_benign(prints: DataFrame, benign: DataFrame) -> DataFrame:
    """Distinct print_id of fingerprints (print_id, words) that a text newly told to be benign (text_id, words) contains, or that contain it."""
    return similarity.both_ways(prints, benign).select("print_id").distinct()


def learn(spark: SparkSession, store: str, batch_id: str, attacks: DataFrame, allowed: DataFrame, benign: DataFrame, cap: int = memory.CAP, source_cap: int = memory.SOURCE_CAP) -> int:
    """The version of the store that holds the batch: a new one, or the last where it was learned before.

    attacks: attack_id, text, trusted, source, run_key, at.  Values and prints that were seen in a run count once for it; the newest stay within the caps.
    """
    at = snapshots.version(spark, store)
    batches = snapshots.read(spark, store, at, "batches", BATCHES)
    if batches.where(F.col("batch_id") == batch_id).limit(1).count():
        return at
    about = attacks.select("attack_id", "run_key", "source", F.col("at").alias("seen"))
    values = held(taught(attacks, allowed), ["attack_id", "value"], host=v.domain_of(F.col("value"))).join(about, "attack_id")
    # Scanned once and written, as several steps below read what was found.
    stage = f"{store}/_stage-{uuid.uuid4().hex}"
    try:
        values.select(F.lit("exact").alias("kind"), "value", "host", "run_key", "source", "seen").write.parquet(stage)
        return _merge(spark, store, at, batch_id, spark.read.schema(SIGHTINGS).parquet(stage), fingerprints(attacks, benign).join(about, "attack_id"), allowed, batches, cap, source_cap)
    finally:
        snapshots.remove(spark, stage)


def _merge(spark: SparkSession, store: str, at: int, batch_id: str, fresh: DataFrame, prints: DataFrame, allowed: DataFrame, batches: DataFrame, cap: int, source_cap: int) -> int:
    old = snapshots.read(spark, store, at, "sightings", SIGHTINGS)
    # Once a run and source; the last time it was seen.
    sightings = old.where("kind = 'exact'").unionByName(fresh).groupBy("kind", "value", "host", "run_key", "source").agg(F.max("seen").alias("seen"))
    items = sightings.groupBy("kind", "value").agg(F.max("seen").alias("last_seen"), F.max_by("source", F.struct("seen", "source")).alias("source")).withColumn("status", F.lit("observed"))
    kept = memory.capped(items, cap, source_cap).select("kind", "value")
    sightings = sightings.join(kept, ["kind", "value"], "left_semi")
    shared = sightings.where(v.shared_host(F.col("host"))).select("host").distinct()
    hosts = memory.escalated(sightings.where("host is not null").select("host", "value", "run_key", "source"), allowed.select(F.col("value").alias("host")), shared).select("host")
    domains = sightings.join(hosts, "host", "left_semi").groupBy("host", "run_key", "source").agg(F.max("seen").alias("seen")).select(F.lit("domain").alias("kind"), F.col("host").alias("value"), "host", "run_key", "source", "seen")
    prints = prints.select("print_id", "words", "run_key", "seen")
    prints = snapshots.read(spark, store, at, "prints", PRINTS).unionByName(prints).groupBy("print_id", "run_key").agg(F.first("words").alias("words"), F.max("seen").alias("seen")).select("print_id", "words", "run_key", "seen")
    done = batches.unionByName(spark.createDataFrame([(batch_id,)], BATCHES))
    return snapshots.commit(spark, store, at, {"sightings": sightings.unionByName(domains).select(*[c.split()[0] for c in SIGHTINGS.split(", ")]), "prints": prints, "batches": done})
