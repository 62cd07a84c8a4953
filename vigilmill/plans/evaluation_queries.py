"""Evaluation of detectors and runs, windows over releases, set operations on ids: each with its SQL.

`labels` gives the truth and a detector's verdict, `documents.source` a release or arm, `events` the runs.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilmill.functions import stats
from vigilmill.operators import decisions as dec
from vigilmill.plans.registry import query


@query("""with j as (select lang, toxic = 1 as truth, quality = 0 as said from labels join documents using (doc_id)), c as (select lang, count(*) filter (truth and said) as tp, count(*) filter (not truth and said) as fp,
 count(*) filter (truth and not said) as fn, count(*) filter (not truth and not said) as tn from j group by 1)
 select lang, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1 from c""")
def label_agreement(t):
    """Confusion counts and rates by paradigm; a rate without a denominator is null."""
    j = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select("lang", (F.col("toxic") == 1).alias("truth"), (F.col("quality") == 0).alias("said"))
    y, s = F.col("truth"), F.col("said")
    c = j.groupBy("lang").agg(F.count_if(y & s).alias("tp"), F.count_if(~y & s).alias("fp"), F.count_if(y & ~s).alias("fn"), F.count_if(~y & ~s).alias("tn"))
    rate = lambda k, n: F.round(F.try_divide(F.expr(k), F.expr(n)), 6)
    return c.select("lang", "tp", "fp", "fn", "tn", rate("tp + tn", "tp + fp + fn + tn").alias("accuracy"), rate("tp", "tp + fp").alias("precision"), rate("tp", "tp + fn").alias("recall"), rate("2 * tp", "2 * tp + fp + fn").alias("f1"))


@query("""select coalesce(source, 'all') as category, count(*) filter (toxic = 1) as attacks, count(*) filter (toxic = 1 and quality = 1) as succeeded, count(*) filter (toxic = 0) as benign, count(*) filter (toxic = 0 and quality = 0) as blocked_benign
 from labels join documents using (doc_id) group by grouping sets ((source), ())""")
def evaluation_score(t):
    """Attack success and benign blocks, overall and by category, in one aggregation."""
    j = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return j.rollup("source").agg(
        F.grouping("source").alias("g"), F.count_if(F.expr("toxic = 1")).alias("attacks"), F.count_if(F.expr("toxic = 1 and quality = 1")).alias("succeeded"), F.count_if(F.expr("toxic = 0")).alias("benign"), F.count_if(F.expr("toxic = 0 and quality = 0")).alias("blocked_benign"),
    ).select(F.coalesce("source", F.lit("all")).alias("category"), "attacks", "succeeded", "benign", "blocked_benign")


@query("""select user_id, case when count(distinct event_type) = 1 then min(event_type) else 'MIXED' end as outcome, count(*) as runs from events where user_id % 3 = 0 or event_type <> 'view' group by 1
 union all select -1, 'UNMEASURED', 0""")
def unanimous_else_mixed(t):
    """A cell's outcome if all of its runs agree; a cell of the grid without runs is unmeasured."""
    ran = t.events.where("user_id % 3 = 0 or event_type <> 'view'").groupBy("user_id").agg(F.min("event_type").alias("a"), F.max("event_type").alias("b"), F.count("*").alias("runs"))
    grid = ran.select("user_id").unionByName(t.spark.createDataFrame([(-1,)], "user_id bigint"))
    return grid.join(ran, "user_id", "left").select("user_id", F.when(F.col("a").isNull(), "UNMEASURED").when(F.col("a") == F.col("b"), F.col("a")).otherwise("MIXED").alias("outcome"), F.coalesce("runs", F.lit(0)).alias("runs"))


@query("""select event_type, count(distinct user_id) as versions, count(distinct user_id) >= 3 as replicated from events where value > 90 group by 1""")
def replication_criterion(t):
    """A deviation counts as replicated in three versions or more."""
    n = F.countDistinct("user_id")
    return t.events.where("value > 90").groupBy("event_type").agg(n.alias("versions"), (n >= 3).alias("replicated"))


@query("""select user_id % 10 as cell, count(*) as k, array_to_string(list_sort(list_distinct(list(event_type))), '/') as names from events group by 1""")
def outcome_sets(t):
    """Runs of a cell and the union of its outcome names."""
    return t.events.groupBy((F.col("user_id") % 10).alias("cell")).agg(F.count("*").alias("k"), F.array_join(F.array_sort(F.collect_set("event_type")), "/").alias("names"))


@query("""select source as cluster, count(*) as items, count(*) filter (toxic = 1 and quality = 1) as only_a, count(*) filter (toxic = 0 and quality = 0) as only_b from labels join documents using (doc_id) group by 1
 having count(*) filter ((toxic = 1) = (quality = 1)) > 0""")
def discordant_clusters(t):
    """Items of each cluster with a pair on which two guards differ, and which guard alone flags."""
    c = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy(F.col("source").alias("cluster")).agg(
        F.count("*").alias("items"), F.count_if(F.expr("toxic = 1 and quality = 1")).alias("only_a"), F.count_if(F.expr("toxic = 0 and quality = 0")).alias("only_b"))
    return c.where("only_a + only_b > 0")


@query("""with f as (select user_id, min(ts) filter (event_type = 'signup') as exposed from events group by 1)
 select event_type, count(*) filter (exposed is not null) as exposed, count(*) filter (exposed is null) as unexposed, count(*) filter (ts >= exposed) as after from events join f using (user_id) group by 1""")
def exposure_counts(t):
    """Runs of exposed and unexposed sessions, and those at or after the first exposure."""
    e = t.events.withColumn("exposed", F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).over(Window.partitionBy("user_id")))
    return e.groupBy("event_type").agg(F.count_if(F.col("exposed").isNotNull()).alias("exposed"), F.count_if(F.col("exposed").isNull()).alias("unexposed"), F.count_if(F.col("ts") >= F.col("exposed")).alias("after"))


@query("""with s as (select unnest([20, 50, 80, 95]) as k), v as (select event_type = 'error' as bad, value from events), r as (select k, count(*) filter (bad and value >= k) as hit, count(*) filter (not bad and value >= k) as wrong, count(*) filter (bad) as n from v, s group by 1)
 select k::bigint as k, hit, wrong, round(hit / n, 6) as recall from r order by recall desc, wrong, k limit 1""")
def tuned_choice(t):
    """The choice of greatest recall, then of fewest false flags: all choices counted in one scan."""
    v = t.events.select((F.col("event_type") == "error").alias("bad"), "value")
    r = v.select("*", F.explode(F.array(*[F.lit(k).cast("bigint") for k in (20, 50, 80, 95)])).alias("k")).groupBy("k").agg(
        F.count_if(F.col("bad") & (F.col("value") >= F.col("k"))).alias("hit"), F.count_if(~F.col("bad") & (F.col("value") >= F.col("k"))).alias("wrong"), F.count_if("bad").alias("n"))
    return r.select("k", "hit", "wrong", F.round(F.col("hit") / F.col("n"), 6).alias("recall")).orderBy(F.desc("recall"), "wrong", "k").limit(1)


@query("""with o as (select user_id, ts, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as p from events),
 s as (select *, sum(case when event_type = p then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from o), g as (select user_id, run, event_type, min(ts) as lo, max(ts) as hi from s group by 1, 2, 3)
 select user_id, run::bigint as run, event_type, lo, hi, coalesce(lead(lo) over (partition by user_id order by run)::date - hi::date, -1)::bigint as gap from g""")
def range_derivation(t):
    """Runs of equal outcomes in release order with the days to the next one (-1: open-ended)."""
    w, g = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id").orderBy("run")
    o = t.events.withColumn("new", F.when(F.col("event_type") == F.lag("event_type").over(w), 0).otherwise(1))
    s = o.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = s.groupBy("user_id", "run", "event_type").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return runs.withColumn("gap", F.coalesce(F.datediff(F.lead("lo").over(g), "hi"), F.lit(-1)).cast("bigint"))


@query("""select user_id, event_id, case when row_number() over (partition by user_id order by ts, event_id) % 2 = 1 then 'fit' else 'held_out' end as part from events""")
def alternating_split(t):
    """Every other release is held out."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("user_id", "event_id", F.when(n % 2 == 1, "fit").otherwise("held_out").alias("part"))


@query("""with h as (select source, ('0x' || left(sha256(source), 15))::bigint % 10 as b from documents where source is not null)
 select source, case when b < 3 then 'test' when b = 3 then 'validation' else 'train' end as split, count(*) as rows from h group by 1, 2""")
def group_isolated_split(t):
    """All rows of a group fall on the same side, by a hash of its name."""
    b = F.conv(F.left(F.sha2("source", 256), F.lit(15)), 16, 10).cast("bigint") % 10
    h = t.documents.where("source is not null").groupBy("source").agg(F.count("*").alias("rows"))
    return h.select("source", F.when(b < 3, "test").when(b == 3, "validation").otherwise("train").alias("split"), "rows")


@query("""select user_id, event_type, min(ts) as first_seen, max(ts) as last_seen, count(*) as seen from events group by 1, 2""")
def longitudinal_span(t):
    return t.events.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("seen"))


@query("""with n as (select user_id, event_type, max((ts, event_id)) as m from events group by 1, 2), r as (select user_id, event_type, row_number() over (partition by user_id order by m desc) as k, count(*) over (partition by user_id) as held from n)
 select user_id, event_type, held > 3 as incomplete from r where k <= 3""")
def newest_bounded_set(t):
    """The three values seen last in each session; dropping any marks the session incomplete."""
    n = t.events.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    w = Window.partitionBy("user_id")
    r = n.withColumn("k", F.row_number().over(w.orderBy(F.desc("m")))).withColumn("held", F.count("*").over(w))
    return r.where("k <= 3").select("user_id", "event_type", (F.col("held") > 3).alias("incomplete"))


@query("""with a as (select user_id, value, row_number() over (partition by user_id order by value, event_id) as n from events where event_type = 'view'), b as (select user_id, value, row_number() over (partition by user_id order by value, event_id) as n from events where event_type = 'click')
 select user_id, n, a.value as off_value, b.value as on_value, b.value < a.value as reduced from a join b using (user_id, n)""")
def paired_by_rank(t):
    """The runs of two arms in order, paired by rank."""
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    arm = lambda kind, name: t.events.where(F.col("event_type") == kind).select("user_id", F.row_number().over(w).cast("bigint").alias("n"), F.col("value").alias(name))
    return arm("view", "off_value").join(arm("click", "on_value"), ["user_id", "n"]).withColumn("reduced", F.col("on_value") < F.col("off_value"))


@query("""select user_id from events group by 1 having count(distinct event_type) = (select count(distinct event_type) from events)""")
def common_ids(t):
    """Ids scored in every arm: one grouping instead of a chain of joins."""
    arms = t.events.agg(F.countDistinct("event_type").alias("arms"))
    return t.events.groupBy("user_id").agg(F.countDistinct("event_type").alias("n")).join(F.broadcast(arms), F.col("n") == F.col("arms")).select("user_id")


@query("""select distinct user_id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events where event_type = 'error' except select user_id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) from events where event_type = 'purchase'""")
def tainted_minus_user(t):
    """Values of outputs that the user did not name."""
    e = t.events.select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_type")
    return e.where("event_type = 'error'").select("user_id", "k").distinct().join(e.where("event_type = 'purchase'").select("user_id", "k"), ["user_id", "k"], "left_anti")


@query("""select doc_id, toxic from labels where doc_id not in (select doc_id from documents where source in ('src0', 'src1') and doc_id is not null)""")
def orphans_removed(t):
    """Rows whose parent is gone are deleted."""
    return t.labels.join(t.documents.where("source in ('src0', 'src1')").select("doc_id"), "doc_id", "left_anti").select("doc_id", "toxic")


@query("""select o_orderkey, case when o_orderdate is null then 'NONE' when o_custkey % 7 = 0 then 'MISMATCH' when o_orderdate < timestamp '1995-01-01' then 'EXPIRED' when o_orderstatus = 'F' then 'REJECTED' when o_orderpriority like '5%' then 'CONSUMED' when o_orderstatus <> 'O' then 'NOT_APPROVED' else 'VERIFIED' end as state from orders""")
def approval_state_check(t):
    """The first obstacle to an approval, in fixed order."""
    c = F.col
    state = dec.ladder(
        (c("o_orderdate").isNull(), "NONE"), (c("o_custkey") % 7 == 0, "MISMATCH"), (c("o_orderdate") < F.lit("1995-01-01").cast("timestamp"), "EXPIRED"), (c("o_orderstatus") == "F", "REJECTED"),
        (c("o_orderpriority").startswith("5"), "CONSUMED"), (c("o_orderstatus") != "O", "NOT_APPROVED"), otherwise="VERIFIED",
    )
    return t.orders.select("o_orderkey", state.alias("state"))


@query("""with d as (select user_id, min((ts, event_id, event_type)) filter (event_type in ('purchase', 'error')) as f, bool_or(event_type = 'signup') as used from events group by 1)
 select user_id, case when f is null then 'PENDING' when f[3] = 'error' then 'REJECTED' when used then 'CONSUMED' else 'APPROVED' end as status from d""")
def approval_fold(t):
    """Latest state of each approval: the first decision stands, a use consumes an approved one."""
    first = F.min(F.when(F.col("event_type").isin("purchase", "error"), F.struct("ts", "event_id", "event_type")))
    d = t.events.groupBy("user_id").agg(first.alias("f"), F.bool_or(F.col("event_type") == "signup").alias("used"))
    return d.select("user_id", F.when(F.col("f").isNull(), "PENDING").when(F.col("f.event_type") == "error", "REJECTED").when(F.col("used"), "CONSUMED").otherwise("APPROVED").alias("status"))


@query("""select user_id, count(distinct date_trunc('day', ts)) as runs, min(ts) as first_seen, max(ts) as last_seen from events where event_type = 'error' group by 1""")
def sightings_once_a_run(t):
    return t.events.where("event_type = 'error'").groupBy("user_id").agg(F.countDistinct(F.date_trunc("day", "ts")).alias("runs"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("""select doc_id, case when bool_or(v = 'deny') then 'deny' when bool_or(v = 'ask') then 'ask' when bool_or(v = 'error') then 'error' else 'allow' end as verdict from
 (select doc_id, case when toxic = 1 then 'deny' else 'allow' end as v from labels union all select doc_id, case when quality = 0 then 'ask' else 'allow' end from labels union all select doc_id, case when doc_id % 11 = 0 then 'error' else 'allow' end from labels) group by 1""")
def guards_combined(t):
    """Any denial; else any question; else any error; else allowed."""
    return t.labels.groupBy("doc_id").agg(F.bool_or(F.col("toxic") == 1).alias("d"), F.bool_or(F.col("quality") == 0).alias("q")).select(
        "doc_id", dec.ladder((F.col("d"), "deny"), (F.col("q"), "ask"), (F.col("doc_id") % 11 == 0, "error"), otherwise="allow").alias("verdict"))


@query("""with m as (select user_id, row_number() over (partition by user_id order by ts, event_id) as n, event_type from events)
 select user_id, count(*) filter (event_type in ('purchase', 'signup')) as mutations, count(*) filter (event_type = 'error') as harmful, min(n) filter (event_type = 'error') as first_harmful from m group by 1""")
def trace_guard_floor(t):
    """What holding every mutation would have stopped, and where harm begins."""
    m = t.events.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint"))
    bad = F.col("event_type") == "error"
    return m.groupBy("user_id").agg(F.count_if(F.col("event_type").isin("purchase", "signup")).alias("mutations"), F.count_if(bad).alias("harmful"), F.min(F.when(bad, F.col("n"))).alias("first_harmful"))


@query("""select lang, count(*) filter (source = 'src0') as src0, count(*) filter (source = 'src1') as src1, count(*) filter (source = 'src2') as src2 from documents group by 1""")
def by_version_pivot(t):
    """A column for each version, the versions named in the plan."""
    return t.documents.groupBy("lang").pivot("source", ["src0", "src1", "src2"]).count().na.fill(0, ["src0", "src1", "src2"])


@query("""with s as (select source, count(distinct doc_id) as runs from documents where source is not null group by 1) select source, runs, runs >= 5 as hostile from s order by runs desc, source limit 20""")
def memory_top_sources(t):
    """The twenty sources of most runs."""
    s = t.documents.where("source is not null").groupBy("source").agg(F.countDistinct("doc_id").alias("runs"))
    return s.withColumn("hostile", F.col("runs") >= 5).orderBy(F.desc("runs"), "source").limit(20)


@query("""with c as (select source, n_chars, percent_rank() over (partition by source order by n_chars) as pr from documents) select source, count(*) as over_p90 from c where pr >= 0.9 group by 1""")
def heavy_hitters(t):
    """Rows of each source in its own top tenth by size."""
    c = t.documents.select("source", F.percent_rank().over(Window.partitionBy("source").orderBy("n_chars")).alias("pr"))
    return c.where("pr >= 0.9").groupBy("source").agg(F.count("*").alias("over_p90"))


@query("""with k as (select lang, count(*) as n, count(*) filter (toxic = 1) as k from labels join documents using (doc_id) group by 1), p as (select *, k / n as p, 1.959964 * 1.959964 as z2 from k)
 select lang, n, k, round((p + z2 / (2 * n) - 1.959964 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 6) as lower, round((p + z2 / (2 * n) + 1.959964 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 6) as upper from p""")
def rate_with_interval(t):
    """k of n with its Wilson interval."""
    c = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.expr("toxic = 1")).alias("k"))
    lower, upper = stats.wilson(F.col("k"), F.col("n"))
    return c.select("lang", "n", "k", F.round(lower, 6).alias("lower"), F.round(upper, 6).alias("upper"))
