"""Sessions, audit, memory, decisions, catalogs and evaluation over the fixture tables.

`events` is the audit stream (user = session, type = kind, props.k = tool), `documents.source` a server, `labels` the truth.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilmill.functions import stats
from vigilmill.operators import decisions as dec
from vigilmill.plans.registry import query

_TOOL = "element_at(array('read', 'search', 'send', 'write', 'list'), cast(get_json_object(props, '$.k') as int) % 5 + 1)"


@query("select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as sequence from events")
def event_sequence(t):
    """Gapless sequence of each session's events."""
    return t.events.select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("sequence"))


@query("select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) <= 4 as allowed from events where event_type = 'purchase'")
def call_budget(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.where("event_type = 'purchase'").select("event_id", "user_id", (F.row_number().over(w) <= dec.CALL_BUDGET).alias("allowed"))


@query("""with p as (select *, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from events)
 select event_id, (sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id, island order by ts, event_id rows unbounded preceding))::bigint as strikes from p""")
def strikes_since_prompt(t):
    """Errors of a session since its last signup."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    p = t.events.withColumn("island", F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(w))
    u = Window.partitionBy("user_id", "island").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return p.select("event_id", F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(u).alias("strikes"))


@query("""with g as (select *, case when epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts, event_id)) <= 86400 then 0 else 1 end as fresh from events),
 s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from g)
 select user_id, session::bigint as session, count(*) as events, min(ts) as first_ts, max(ts) as last_ts, bool_or(event_type = 'error') as flagged from s group by 1, 2""")
def session_idle_expiry(t):
    """Sessions end after a day without an event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    g = t.events.withColumn("fresh", F.when(gap <= 86_400_000_000, 0).otherwise(1))
    s = g.withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.bool_or(F.col("event_type") == "error").alias("flagged"))


@query("""select event_id, count(*) over (partition by user_id order by epoch_us(ts)::bigint range between 3600000000 preceding and current row) <= 2 as allowed from events""")
def rate_limit_window(t):
    """At most two events an hour in a session."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return t.events.select("event_id", (F.count("*").over(w) <= 2).alias("allowed"))


@query("""select o_orderstatus as status, count(*) as runs, count(*) filter (o_orderpriority like '1%') as pending, count(distinct o_custkey) as owners from orders group by 1
 union all select 'NONE', 0, 0, 0""")
def audit_metrics(t):
    """Runs by status in one pass, a status without runs filled with zeros."""
    seen = t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("runs"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("pending"), F.countDistinct("o_custkey").alias("owners"))
    wanted = seen.select("status").unionByName(t.spark.createDataFrame([("NONE",)], "status string")).distinct()
    return wanted.join(seen, "status", "left").select("status", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("runs", "pending", "owners")])


@query("select o_orderkey, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey where o_orderstatus = 'P' order by o_orderdate desc, o_orderkey limit 100")
def approvals_with_request(t):
    """The 100 newest pending approvals with what asked for them."""
    j = t.orders.where("o_orderstatus = 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "c_name", "c_mktsegment")


@query("""with x as (select user_id, event_type, ts, event_id, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) select user_id, event_type, event_id, ts from x where n = 1""")
def latest_row_wins(t):
    latest = t.events.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return latest.select("user_id", "event_type", F.col("m.event_id").alias("event_id"), F.col("m.ts").alias("ts"))


@query("""with x as (select user_id, event_type, event_id, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events where event_type <> 'error') select user_id, event_type, event_id from x where n = 1""")
def first_valid_attempt(t):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t.events.where("event_type <> 'error'").withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_type", "event_id")


@query("""with x as (select *, bool_or(event_type = 'error') over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as before from events) select user_id, count(*) as prefix from x where not coalesce(before, false) group by 1""")
def prefix_until_divergence(t):
    """Events of a session up to its first error, that one included."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    x = t.events.withColumn("before", F.bool_or(F.col("event_type") == "error").over(w))
    return x.where(~F.coalesce("before", F.lit(False))).groupBy("user_id").agg(F.count("*").alias("prefix"))


@query("""with x as (select user_id, ts, event_id, event_type, case when event_type = lag(event_type) over (partition by user_id order by ts, event_id) then 0 else 1 end as new from events),
 y as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from x)
 select user_id, island::bigint as island, event_type, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from y group by 1, 2, 3""")
def version_segments(t):
    """Gaps and islands: runs of equal outcomes in order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = t.events.withColumn("new", F.when(F.col("event_type") == F.lag("event_type").over(w), 0).otherwise(1))
    y = x.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return y.groupBy("user_id", "island", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""with spans(lo, hi, class) as (values (1, 10, 'small'), (11, 30, 'middle'), (40, null, 'large')) select p_partkey, coalesce(class, 'unmeasured') as class from part left join spans on p_size >= lo and (hi is null or p_size <= hi)""")
def range_lookup(t):
    """Interval join: the span that holds a value, open above, else unmeasured."""
    spans = t.spark.createDataFrame([(1, 10, "small"), (11, 30, "middle"), (40, None, "large")], "lo int, hi int, class string")
    hit = (F.col("p_size") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("p_size") <= F.col("hi")))
    return t.part.join(F.broadcast(spans), hit, "left").select("p_partkey", F.coalesce("class", F.lit("unmeasured")).alias("class"))


@query("select l_orderkey from lineitem group by 1 having count(distinct l_returnflag) = 3")
def paired_arms(t):
    """Ids that were scored in every arm."""
    return t.lineitem.groupBy("l_orderkey").agg(F.countDistinct("l_returnflag").alias("arms")).where("arms = 3").select("l_orderkey")


@query("select o_orderkey, f as arm from orders cross join (values ('A'), ('N'), ('R')) x(f) where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = f)")
def missing_per_arm(t):
    """Ids that an arm lacks: each id with the fixed arms, less what there is."""
    grid = t.orders.select("o_orderkey", F.explode(F.array(*map(F.lit, "ANR"))).alias("arm"))
    return grid.join(t.lineitem, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("arm") == F.col("l_returnflag")), "left_anti")


@query("""with c as (select d.lang, d.source, count(*) as n, count(*) filter (toxic = 1) as k from labels l join documents d using (doc_id) group by grouping sets ((d.lang), (d.source), ()))
 select coalesce(lang, 'all') as lang, coalesce(source, 'all') as source, n, k, round(greatest(0, (k * 1.0::double / n + 1.920729440648 / n) / (1 + 3.841458881296 / n) - 1.959964 * sqrt(k * 1.0::double / n * (1 - k * 1.0::double / n) / n + 0.960364720324 / (n * n)) / (1 + 3.841458881296 / n)), 6) as low from c""")
def rule_tally_wilson(t):
    """Flagged share by language, by source and overall, with the lower end of Wilson's interval."""
    j = t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id")
    c = j.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("k"))
    low, _ = stats.wilson(F.col("k"), F.col("n"))
    return c.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "n", "k", F.round(low, 6).alias("low"))


@query("select coalesce(source, 'all') as source, coalesce(lang, 'all') as lang, count(*) as n, sum(toxic)::bigint as toxic, sum(quality)::bigint as quality from labels join documents using (doc_id) group by cube (source, lang)")
def toxicity_by_source_cube(t):
    j = t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id")
    c = j.cube("source", "lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.sum("quality").alias("quality"))
    return c.select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("lang", F.lit("all")).alias("lang"), "n", "toxic", "quality")


@query("""with x as (select event_type, date_trunc('day', ts) as day, user_id % 7 as cell, count(*) as n from events group by 1, 2, 3),
 m as (select day, cell, sum(n)::bigint as total, max(n) as top, max_by(event_type, n * 100 - ascii(event_type)) as mode, count(*) as kinds from x group by 1, 2)
 select day, cell, total, case when kinds = 1 then 'unanimous' when top >= 0.8 * total then 'modal' else 'mixed' end as status from m""")
def modal_outcome(t):
    """Per cell: one outcome, one of four fifths or more, or mixed."""
    x = t.events.groupBy("event_type", F.date_trunc("day", "ts").alias("day"), (F.col("user_id") % 7).alias("cell")).agg(F.count("*").alias("n"))
    m = x.groupBy("day", "cell").agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.count("*").alias("kinds"))
    return m.select("day", "cell", "total", F.when(F.col("kinds") == 1, "unanimous").when(F.col("top") >= 0.8 * F.col("total"), "modal").otherwise("mixed").alias("status"))


@query("""with c as (select source, count(*) filter (toxic = 1 and quality = 0) as a, count(*) filter (toxic = 0 and quality = 1) as b from labels join documents using (doc_id) group by 1),
 s as (select count(*) filter (a > b) as wins, count(*) filter (a < b) as losses from c)
 select wins, losses, round(case when wins + losses = 0 then 1.0 else least(1.0, 2 * (select sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1)) * pow(0.5, wins + losses)) from range(0, 1 + least(wins, losses)::bigint) r(i))) end, 6) as p from s""")
def discordant_sign_test(t):
    """Clusters in which one detector alone fires more often than the other, and the exact sign test."""
    j = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    c = j.groupBy("source").agg(F.count_if((F.col("toxic") == 1) & (F.col("quality") == 0)).alias("a"), F.count_if((F.col("toxic") == 0) & (F.col("quality") == 1)).alias("b"))
    s = c.agg(F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") < F.col("b")).alias("losses"))
    return s.select("wins", "losses", F.round(stats.sign_test(F.col("wins"), F.col("losses")), 6).alias("p"))


@query("""with c as (select source, row_number() over (order by source) - 1 as i, count(*) as n, sum(toxic)::bigint as k from labels join documents using (doc_id) group by source),
 m as (select count(*) as c from c), d as (select r, j, ('0x' || substr(md5(r || ':' || j), 1, 8))::bigint % c as i from range(200) a(r) cross join m cross join lateral (select unnest(range(c)) as j) x),
 b as (select r, sum(k) * 1.0::double / sum(n) as rate from d join c using (i) group by r), o as (select rate, row_number() over (order by rate) - 1 as pos from b)
 select round(min(rate) filter (pos = 4), 6) as low, round(min(rate) filter (pos = 194), 6) as high from o""")
def cluster_bootstrap_ci(t):
    """Percentile interval of the toxic share over 200 draws of sources with replacement (draws from a hash)."""
    per = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    c = per.withColumn("i", F.row_number().over(Window.orderBy("source")) - 1)  # one row per source
    size = c.agg(F.count("*").alias("c"))
    d = t.spark.range(200).withColumnRenamed("id", "r").join(F.broadcast(size)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c") - 1)))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("r").cast("string"), F.col("j").cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint") % F.col("c")
    b = d.withColumn("i", draw).join(c, "i").groupBy("r").agg((F.sum("k") / F.sum("n")).alias("rate"))
    o = b.withColumn("pos", F.row_number().over(Window.orderBy("rate")) - 1)
    return o.agg(F.round(F.min(F.when(F.col("pos") == 4, F.col("rate"))), 6).alias("low"), F.round(F.min(F.when(F.col("pos") == 194, F.col("rate"))), 6).alias("high"))


@query("""with x as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null)
 select event_type, round(max(value) filter (i = least(n - 1, floor(0.95 * n)::bigint)), 6) as p95, round(median(value), 6) as p50, count(*) as n from x group by 1""")
def latency_nearest_rank(t):
    """Median and nearest-rank 95th percentile of each kind."""
    n = F.col("n")
    p = stats.order_statistics(t.events, "value", ["event_type"], {"p95": F.least(n - 1, F.floor(F.lit(0.95) * n)), "a": F.floor((n - 1) / 2), "b": F.ceil((n - 1) / 2)})
    return p.select("event_type", F.round("p95", 6).alias("p95"), F.round((F.col("a") + F.col("b")) / 2, 6).alias("p50"), "n")


@query("""with d as (select source, doc_id, n_chars, row_number() over (partition by source order by n_chars desc, doc_id) as n from documents) select source, doc_id from d where n <= 20""")
def source_quota_keep(t):
    """The 20 strongest items of each source stay."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return t.documents.withColumn("n", F.row_number().over(w)).where("n <= 20").select("source", "doc_id")


@query("""select event_type as source, count(distinct user_id) as runs, count(distinct user_id) >= 5 as hostile from events where ts >= (select max(ts) from events) - interval 7 days group by 1""")
def source_reputation_7d(t):
    last = t.events.agg(F.max("ts").alias("now"))
    recent = t.events.join(F.broadcast(last)).where(F.col("ts") >= F.col("now") - F.expr("interval 7 days"))
    return recent.groupBy(F.col("event_type").alias("source")).agg(F.countDistinct("user_id").alias("runs")).withColumn("hostile", F.col("runs") >= 5)


@query(r"""with h as (select regexp_extract(lower(url), '^https?://([^/?#:]+)', 1) as host, page_id, url from pages) select host, count(distinct url) as indicators, count(distinct page_id % 5) as runs, count(distinct page_id % 7) as servers from h group by 1 having count(distinct url) >= 2 and count(distinct page_id % 5) >= 2 and count(distinct page_id % 7) >= 3""")
def domain_escalation(t):
    """Hosts with two indicators, two runs and three servers or more."""
    h = t.pages.withColumn("host", F.regexp_extract(F.lower("url"), "^https?://([^/?#:]+)", 1))
    g = h.groupBy("host").agg(F.countDistinct("url").alias("indicators"), F.countDistinct(F.col("page_id") % 5).alias("runs"), F.countDistinct(F.col("page_id") % 7).alias("servers"))
    return g.where("indicators >= 2 and runs >= 2 and servers >= 3")


@query("""select user_id, event_type, min(ts) as first_seen, max(ts) as last_seen, count(distinct date_trunc('day', ts)) as runs, bool_or(event_type = 'purchase') or max(ts) >= (select max(ts) from events) - interval 5 days as live from events group by 1, 2""")
def indicator_fold(t):
    """Upsert as a fold: sightings of an indicator, and whether it is still live."""
    now = t.events.agg(F.max("ts").alias("now"))
    f = t.events.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.countDistinct(F.date_trunc("day", "ts")).alias("runs"))
    live = (F.col("event_type") == "purchase") | (F.col("last_seen") >= F.col("now") - F.expr("interval 5 days"))
    return f.join(F.broadcast(now)).withColumn("live", live).drop("now")


_EV = """e as (select event_id, case event_type when 'click' then 'srv:listItems' when 'view' then 'srv:get_page' when 'purchase' then 'pay:sendMoney' when 'signup' then 'srv:create_user' else 'srv:unknown' end as tool,
 row_number() over (partition by user_id order by ts, event_id) as call_index, case when event_type = 'error' then 0.9 else 0.02 end::double as injection, case when event_id % 11 = 0 then 0.3 else 0.95 end::double as alignment from events)"""


def _calls(t):
    tool = F.when(F.col("event_type") == "click", "srv:listItems").when(F.col("event_type") == "view", "srv:get_page").when(F.col("event_type") == "purchase", "pay:sendMoney").when(F.col("event_type") == "signup", "srv:create_user").otherwise("srv:unknown")
    return t.events.select("event_id", tool.alias("tool"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("call_index"),
                           F.when(F.col("event_type") == "error", 0.9).otherwise(0.02).alias("injection"), F.when(F.col("event_id") % 11 == 0, 0.3).otherwise(0.95).alias("alignment"))


@query(f"with {_EV} select event_id, tool, tool not in ('srv:listItems', 'srv:get_page') as mutation from e")
def mutation_calls(t):
    return _calls(t).select("event_id", "tool", dec.is_mutation(F.col("tool")).alias("mutation"))


@query(f"with {_EV} select event_id, case when tool = 'srv:unknown' and event_id % 2 = 0 then 'BLOCK:UNREGISTERED' when event_id % 97 = 0 then 'BLOCK:PROHIBITED' when call_index > 4 then 'BLOCK:BUDGET' when injection >= 0.75 then 'BLOCK:INJECTION' when alignment < 0.6 then 'BLOCK:ALIGNMENT' when tool not in ('srv:listItems', 'srv:get_page') then 'REVIEW:MUTATION' else 'ALLOW' end as decision from e")
def policy_ladder(t):
    c = _calls(t)
    known = ~((F.col("tool") == "srv:unknown") & (F.col("event_id") % 2 == 0))
    return c.select("event_id", dec.policy(F.col("call_index"), F.col("injection"), F.col("alignment"), dec.is_mutation(F.col("tool")), known, F.col("event_id") % 97 == 0).alias("decision"))


@query(f"with {_EV}, r as (select event_id, greatest(injection, 1 - alignment, case when tool not in ('srv:listItems', 'srv:get_page') then 0.35 else 0 end) as risk from e) select event_id, round(risk, 6) as risk, case when risk >= 0.75 then 'BLOCK' when risk >= 0.35 then 'REVIEW' else 'CLEAR' end as verdict from r")
def evidence_fusion(t):
    r = _calls(t).withColumn("risk", dec.fused_risk(F.col("injection"), F.col("alignment"), dec.is_mutation(F.col("tool"))))
    return r.select("event_id", F.round("risk", 6).alias("risk"), F.when(F.col("risk") >= 0.75, "BLOCK").when(F.col("risk") >= 0.35, "REVIEW").otherwise("CLEAR").alias("verdict"))


@query("select doc_id, case when toxic = 1 then 'BLOCK' when quality = 0 then 'REVIEW' else 'ALLOW' end as verdict from labels")
def stricter_of(t):
    a = F.when(F.col("toxic") == 1, "BLOCK").otherwise("ALLOW")
    b = F.when(F.col("quality") == 0, "REVIEW").otherwise("ALLOW")
    return t.labels.select("doc_id", dec.stricter(a, b).alias("verdict"))


@query("select p_name as name, count(distinct p_brand) as servers from part group by 1 having count(distinct p_brand) >= 2")
def name_clash(t):
    """Names that two servers or more offer."""
    return t.part.groupBy(F.col("p_name").alias("name")).agg(F.countDistinct("p_brand").alias("servers")).where("servers >= 2")


@query("""with a as (select c_custkey as k, c_mktsegment as v from customer where c_custkey % 3 <> 0), b as (select c_custkey as k, case when c_custkey % 10 = 0 then 'CHANGED' else c_mktsegment end as v from customer where c_custkey % 5 <> 0)
 select coalesce(a.k, b.k) as k, case when a.k is null then 'added' when b.k is null then 'removed' else 'changed' end as drift from a full join b on a.k = b.k where a.v is distinct from b.v""")
def catalog_drift(t):
    """Full outer compare of two states of a catalog."""
    a = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    b = t.customer.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k2"), F.when(F.col("c_custkey") % 10 == 0, "CHANGED").otherwise(F.col("c_mktsegment")).alias("w"))
    j = a.join(b, F.col("k") == F.col("k2"), "full").where(~F.col("v").eqNullSafe(F.col("w")))
    return j.select(F.coalesce("k", "k2").alias("k"), F.when(F.col("k").isNull(), "added").when(F.col("k2").isNull(), "removed").otherwise("changed").alias("drift"))


@query("select user_id from events group by 1 having bool_or(event_type = 'view') and bool_or(event_type = 'signup') and bool_or(event_type = 'purchase')")
def toxic_flow(t):
    """Clients that have an untrusted source, private data and a sink."""
    roles = t.events.where(F.col("event_type").isin("view", "signup", "purchase")).groupBy("user_id").agg(F.countDistinct("event_type").alias("roles"))
    return roles.where("roles = 3").select("user_id")


@query("select doc_id, case when toxic = 1 then true when quality is null then null else quality = 0 end as any_of from labels")
def detector_any_of(t):
    """Three-valued or of two detectors; null leaves both."""
    return t.labels.select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("any_of"))


@query("""select coalesce(l_returnflag, 'all') as kind, count(*) as n, count(l_discount) filter (l_discount > 0.05) as high, round(avg(l_quantity), 6) as mean from lineitem group by grouping sets ((l_returnflag), ())""")
def metric_grouping_sets(t):
    g = t.lineitem.groupingSets([["l_returnflag"], []], "l_returnflag")
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("high"), F.round(F.avg("l_quantity"), 6).alias("mean")).select(F.coalesce("l_returnflag", F.lit("all")).alias("kind"), "n", "high", "mean")


@query("select o_custkey as key, max(case when o_orderstatus = 'F' then 3 when o_orderstatus = 'O' then 2 else 1 end)::int as state, count(*) as tries, min(o_orderkey) as first_key from orders group by 1")
def idempotency_answers(t):
    """State of each idempotency key: the furthest of its attempts, and the first."""
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    return t.orders.groupBy(F.col("o_custkey").alias("key")).agg(F.max(rank).alias("state"), F.count("*").alias("tries"), F.min("o_orderkey").alias("first_key"))


@query("""with x as (select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1), y as (select n_name, count(*) as n from supplier join nation on s_nationkey = n_nationkey group by 1)
 select coalesce(x.n_name, y.n_name) as name, coalesce(x.n, 0) as before, coalesce(y.n, 0) as after, coalesce(y.n, 0) > coalesce(x.n, 0) * 0.05 as regressed from x full join y on x.n_name = y.n_name""")
def baseline_with_slack(t):
    """Baseline against current with slack, either side missing."""
    n = t.nation.select("n_nationkey", "n_name")
    x = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("before"))
    y = t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("after"))
    j = x.join(y, "n_name", "full").select(F.col("n_name").alias("name"), F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return j.withColumn("regressed", F.col("after") > F.col("before") * 0.05)


@query("""with b as (select vec_id, round(list_dot_product(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) as s, label from embeddings), x as (select s, row_number() over (order by s desc, vec_id) - 1 as i, count(*) over () as n from b where label <> 0)
 select s as threshold from x where i = floor(0.05 * n)""")
def threshold_at_fpr(t):
    """The score that five in a hundred of the negatives exceed."""
    from vigilmill.operators.similarity import dot

    first = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    b = t.embeddings.where("label <> 0").join(F.broadcast(first)).select("vec_id", F.round(dot(F.col("embedding"), F.col("q")), 6).alias("s"))
    n = F.col("n")
    # The value at place floor(0.05 n) of the descending order.
    found = stats.order_statistics(b.withColumn("one", F.lit(1)), "s", ["one"], {"threshold": n - 1 - F.floor(F.lit(0.05) * n)})
    return found.select("threshold")
