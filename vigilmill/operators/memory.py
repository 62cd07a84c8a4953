"""Threat memory as folds: upsert of sightings, sticky operator decisions, escalation, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilmill.functions.values import domain_of, host_suffixes
from vigilmill.operators import fold as folds

# Days an observed item lives, caps, escalation limits.
TTL_DAYS, CAP, SOURCE_CAP = 30, 5_000, 200
INDICATORS, RUNS, SERVERS = 2, 2, 3


def fold(sightings: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row for each (kind, value): runs (distinct), first_seen, last_seen, status.

    sightings: kind, value, run_key, source, seen; decisions: kind, value, status (confirmed, revoked), decided.  The last
    decision by time stands whatever is seen later; without one an item is observed.
    """
    seen = sightings.groupBy("kind", "value").agg(F.countDistinct("run_key").alias("runs"), F.countDistinct(F.split_part("source", F.lit(":"), F.lit(1))).alias("servers"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))
    last = decisions.groupBy("kind", "value").agg(F.max(F.struct("decided", "status")).alias("d"))
    return seen.join(last, ["kind", "value"], "full").withColumn("status", F.coalesce("d.status", F.lit("observed"))).drop("d")


def live(items: DataFrame, now, days: int = TTL_DAYS) -> DataFrame:
    """Confirmed items, and observed ones seen within the last days; never revoked ones."""
    fresh = F.col("last_seen") >= now - F.make_interval(days=F.lit(days))
    return items.where((F.col("status") == "confirmed") | ((F.col("status") == "observed") & fresh))


def escalated(sightings: DataFrame, allowed: DataFrame, shared: DataFrame) -> DataFrame:
    """Hosts under which several indicators were seen in several runs at several servers; allowed and shared hosts never.

    sightings: host, value, run_key, source; allowed, shared: host.
    """
    server = F.split_part("source", F.lit(":"), F.lit(1))
    counted = sightings.groupBy("host").agg(F.countDistinct("value").alias("indicators"), F.countDistinct("run_key").alias("runs"), F.countDistinct(server).alias("servers"))
    many = counted.where((F.col("indicators") >= INDICATORS) & (F.col("runs") >= RUNS) & (F.col("servers") >= SERVERS))
    return many.join(allowed, "host", "left_anti").join(shared, "host", "left_anti")


def capped(items: DataFrame, cap: int = CAP, source_cap: int = SOURCE_CAP) -> DataFrame:
    """The newest observed items of each source, then the newest overall; decided items always stay.

    The global cut is a top-k (`cap` rows), not a window over all rows.
    """
    observed = items.where("status = 'observed'")
    per = Window.partitionBy("source").orderBy(F.desc("last_seen"), "value")
    kept = observed.withColumn("_n", F.row_number().over(per)).where(F.col("_n") <= source_cap).drop("_n")
    return items.where("status <> 'observed'").unionByName(kept.orderBy(F.desc("last_seen"), "value").limit(cap))


def server_of(source: Column) -> Column:
    """The server of `server:tool`; sources of the web, of files and of commands stand for themselves."""
    alone = source.rlike("^(?:web|read|shell):")
    return F.when(alone, source).otherwise(F.split_part(source, F.lit(":"), F.lit(1)))


def upserts(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """(key, status, runs, first_seen, last_seen) from ordered changes: sightings (decided is null) and operator decisions (confirmed, revoked).

    changes: key, run_key, at, decided, and the order's columns.  A sighting while the item is revoked is not counted; a run counts once.
    """
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    stated = changes.withColumn("_state", F.last("decided", ignorenulls=True).over(w))
    seen = F.col("decided").isNull() & ~F.col("_state").eqNullSafe("revoked")
    return stated.groupBy(*key).agg(
        F.coalesce(F.max_by("decided", F.when(F.col("decided").isNotNull(), F.struct(*order))), F.lit("observed")).alias("status"),
        F.countDistinct(F.when(seen, F.col("run_key"))).alias("runs"), F.min(F.when(seen, F.col("at"))).alias("first_seen"), F.max(F.when(seen, F.col("at"))).alias("last_seen"),
    )


def purged(items: DataFrame, sightings: DataFrame, now: Column, days: int = TTL_DAYS, key: str = "item") -> tuple[DataFrame, DataFrame]:
    """(items, sightings) without observed and rejected items last seen before `days` ago, and without sightings of these."""
    old = F.col("status").isin("observed", "rejected") & (F.col("last_seen") < now - F.make_interval(days=F.lit(days)))
    return items.where(~old), sightings.join(items.where(old).select(key), key, "left_anti")


def group_decided(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """items (value, group) with status: the last decision (status, decided_at, tie) on any value of the group, else observed."""
    last = decisions.groupBy("group").agg(F.max_by("status", F.struct("decided_at", "tie")).alias("status"))
    return items.join(last, "group", "left").withColumn("status", F.coalesce("status", F.lit("observed")))


def allow_covers(items: DataFrame, allowed: DataFrame) -> DataFrame:
    """items with revoked: whether their value is allowed, or its host lies on or under an allowed one; an equi join on the host's suffixes."""
    keys = F.array_distinct(F.concat(F.array("value"), F.coalesce(host_suffixes(domain_of(F.col("value"))), F.array().cast("array<string>"))))
    hit = items.select("value", F.explode(keys).alias("k")).join(allowed.select(F.col("value").alias("k")).distinct(), "k", "left_semi").select("value", F.lit(True).alias("revoked")).distinct()
    return items.join(hit, "value", "left").withColumn("revoked", F.coalesce("revoked", F.lit(False)))


def clear_source(rows: DataFrame, server: str) -> DataFrame:
    """rows without those of a server and of its tools."""
    return rows.where((F.col("source") != server) & ~F.col("source").startswith(f"{server}:"))


def heavy_sources(items: DataFrame, cap: int = SOURCE_CAP) -> DataFrame:
    """(server, n) of the servers with more than `cap` items; items: source."""
    return items.groupBy(server_of(F.col("source")).alias("server")).agg(F.count("*").alias("n")).where(F.col("n") > cap)


def recent_set(rows: DataFrame, key: list[str], value: str, at: str, most: int) -> DataFrame:
    """(key, value, incomplete): the `most` values of each key seen last (a value seen again is new), and whether any was dropped."""
    last = rows.groupBy(*key, value).agg(F.max(at).alias("_at"))
    w = Window.partitionBy(*key)
    ranked = last.withColumn("_n", F.row_number().over(w.orderBy(F.desc("_at")))).withColumn("_all", F.count("*").over(w))
    return ranked.where(F.col("_n") <= most).select(*key, value, (F.col("_all") > most).alias("incomplete"))


def reputation(seen: DataFrame, now: Column, allowed: DataFrame, days: int = 7, hostile_runs: int = 5) -> DataFrame:
    """(source, runs, hostile): distinct runs of the last days; allowed sources are never hostile.  seen: source, run_key, at."""
    recent = seen.where(F.col("at") >= now - F.make_interval(days=F.lit(days))).groupBy("source").agg(F.countDistinct("run_key").alias("runs"))
    ok = allowed.select("source", F.lit(True).alias("_ok")).distinct()
    return recent.join(ok, "source", "left").select("source", "runs", ((F.col("runs") >= hostile_runs) & F.col("_ok").isNull()).alias("hostile"))


def approvals(made: DataFrame, log: DataFrame) -> DataFrame:
    """(k, state, used): PENDING, APPROVED, REJECTED or CONSUMED.

    made: k, until; log: k, at, n (order of equal times), act (approve, reject, consume), same_call (the fingerprint is the approved one).  The first decision
    before expiry stands; the first use after it, before expiry and with the same fingerprint consumes an approval.
    """
    rows = log.join(made, "k").where(F.col("at") <= F.col("until"))
    first = rows.where(F.col("act") != "consume").groupBy("k").agg(F.min_by(F.struct("at", "act"), F.struct("at", "n", "act")).alias("d"))
    used = rows.where((F.col("act") == "consume") & F.col("same_call")).join(first, "k").where((F.col("d.act") == "approve") & (F.col("at") > F.col("d.at"))).groupBy("k").agg(F.min("at").alias("used"))
    state = F.when(F.col("used").isNotNull(), "CONSUMED").when(F.col("d.act") == "approve", "APPROVED").when(F.col("d.act") == "reject", "REJECTED").otherwise("PENDING")
    return made.join(first, "k", "left").join(used, "k", "left").select("k", state.alias("state"), "used")


def idempotency(log: DataFrame) -> DataFrame:
    """log (key, request_hash, act, at, tie, ...) with `answer`, each request answered by what stood under its key at that time.

    act: request, complete, doubt or release.  The first request reserves its key (RESERVED); until it ends, the same request is IN_PROGRESS and
    another CONFLICT.  Completed, the same request gets REPLAY; in doubt, IN_DOUBT, for good; released, the next request reserves anew.  Only the
    request that holds the reservation ends it: the answer of the other acts is DONE, or IGNORED where they come too late or from another request.
    Requests without a key are always RESERVED.
    """
    names = log.columns
    key, hash_, act = (names.index(c) for c in ("key", "request_hash", "act"))
    ended = {"complete": "COMPLETED", "doubt": "IN_DOUBT", "release": None}

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        held, status = state
        if row[act] == "request":
            if row[key] is None or status is None:
                return ((row[hash_], "RESERVED") if row[key] is not None else state), ("RESERVED",)
            if row[hash_] != held:
                return state, ("CONFLICT",)
            return state, ({"COMPLETED": "REPLAY", "IN_DOUBT": "IN_DOUBT", "RESERVED": "IN_PROGRESS"}[status],)
        if status != "RESERVED" or row[hash_] != held or row[act] not in ended:
            return state, ("IGNORED",)
        return (held, ended[row[act]]), ("DONE",)

    return folds.fold(log, "key", ["at", "tie"], (None, None), step, "answer string")
