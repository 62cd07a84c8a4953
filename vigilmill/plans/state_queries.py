"""State folded from logs: sessions, rate limits, approvals, idempotency, threat memory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilmill.operators import fold, memory
from vigilmill.plans.guard_queries import _HOST, _addresses
from vigilmill.plans.registry import query


@query("""with recursive e as (select event_id, user_id, epoch_us(ts) / 1e6 as s, row_number() over (partition by user_id order by ts, event_id) as n from events),
 r as (select event_id, user_id, n, s, 1.0::double as tokens, true as allowed from e where n = 1
  union all select e.event_id, e.user_id, e.n, e.s, t - case when t >= 1.0 then 1.0 else 0.0 end, t >= 1.0 from r join e on e.user_id = r.user_id and e.n = r.n + 1 cross join lateral (select least(2.0::double, r.tokens + greatest(0.0, e.s - r.s) * 0.00003) as t) x)
 select event_id, allowed from r""")
def rate_limited(t):
    """A token bucket for each session: two tokens, one back in about nine hours."""
    e = t.events.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    return fold.token_bucket(e, "user_id", "s", 0.00003, 2.0, ["s", "event_id"]).select("event_id", "allowed")


@query("""with recursive e as (select event_id, user_id, epoch_us(ts) / 1e6 as s, event_type = 'error' as bad, row_number() over (partition by user_id order by ts, event_id) as n from events),
 r as (select event_id, user_id, n, s, 1::bigint as life, bad as held from e where n = 1
  union all select e.event_id, e.user_id, e.n, e.s, r.life + x.over::bigint, (r.held and not x.over) or e.bad from r join e on e.user_id = r.user_id and e.n = r.n + 1 cross join lateral (select e.s - r.s > case when r.held then 259200 else 43200 end as over) x)
 select event_id, life, held from r""")
def session_lives(t):
    """Sessions end after twelve idle hours, flagged ones after three days."""
    e = t.events.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"), (F.col("event_type") == "error").alias("bad"))
    return fold.session_lives(e, "user_id", "s", "bad", 43_200, 259_200, ["s", "event_id"]).select("event_id", "life", "held")


@query("""with a as (select l_orderkey as k, l_shipdate as tm, l_linenumber as n, l_returnflag as act, l_partkey % 2 = 0 as same, o_orderdate + interval 60 days as until from lineitem join orders on l_orderkey = o_orderkey),
 d as (select k, min_by({'tm': tm, 'act': act}, (tm, n, act)) as d from a where act in ('A', 'R') and tm <= until group by 1),
 c as (select a.k, min(a.tm) as used from a join d on a.k = d.k where a.act = 'N' and a.same and d.d.act = 'A' and a.tm > d.d.tm and a.tm <= a.until group by 1)
 select o_orderkey as k, case when c.used is not null then 'CONSUMED' when d.d.act = 'A' then 'APPROVED' when d.d.act = 'R' then 'REJECTED' else 'PENDING' end as state, c.used from orders left join d on d.k = o_orderkey left join c on c.k = o_orderkey""")
def approval_states(t):
    """Approvals from their log: the first decision in time stands, and the first use of an approved one with the same fingerprint consumes it."""
    log = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("at"), F.col("l_linenumber").alias("n"), F.when(F.col("l_returnflag") == "A", "approve").when(F.col("l_returnflag") == "R", "reject").otherwise("consume").alias("act"), (F.col("l_partkey") % 2 == 0).alias("same_call"))
    made = t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_orderdate") + F.expr("interval 60 days")).alias("until"))
    return memory.approvals(made, log).select("k", "state", "used")


@query("""with recursive l as (select event_id, user_id as key, 'h' || (event_id % 2) as h, case event_type when 'signup' then 'complete' when 'error' then case when event_id % 3 = 0 then 'doubt' else 'release' end else 'request' end as act, row_number() over (partition by user_id order by ts, event_id) as n from events),
 f as (select event_id, key, n, case when act = 'request' then h end as held, case when act = 'request' then 'RESERVED' end as status, case when act = 'request' then 'RESERVED' else 'IGNORED' end as answer from l where n = 1
  union all select l.event_id, l.key, l.n, case when l.act = 'request' and f.status is null then l.h when l.act = 'release' and f.status = 'RESERVED' and l.h = f.held then null else f.held end,
   case when l.act = 'request' then coalesce(f.status, 'RESERVED') when f.status = 'RESERVED' and l.h = f.held then case l.act when 'complete' then 'COMPLETED' when 'doubt' then 'IN_DOUBT' end else f.status end,
   case when l.act = 'request' then case when f.status is null then 'RESERVED' when l.h <> f.held then 'CONFLICT' when f.status = 'COMPLETED' then 'REPLAY' when f.status = 'IN_DOUBT' then 'IN_DOUBT' else 'IN_PROGRESS' end when f.status = 'RESERVED' and l.h = f.held then 'DONE' else 'IGNORED' end
  from f join l on l.key = f.key and l.n = f.n + 1)
 select event_id, answer from f""")
def idempotency_replies(t):
    """The answer to every request and ending under an idempotency key, by what stood at its time."""
    e = F.col("event_type")
    act = F.when(e == "signup", "complete").when(e == "error", F.when(F.col("event_id") % 3 == 0, "doubt").otherwise("release")).otherwise("request")
    log = t.events.select("event_id", F.col("user_id").alias("key"), F.concat(F.lit("h"), F.col("event_id") % 2).alias("request_hash"), act.alias("act"), F.col("ts").alias("at"), F.col("event_id").alias("tie"))
    return memory.idempotency(log).select("event_id", "answer")


_SEEN = f"e as (select event_id, {_HOST} as value, user_id as run, 'srv' || (event_id % 5) || ':t' || (event_id % 3) as source, ts, case event_type when 'purchase' then 'confirmed' when 'error' then 'revoked' end as decided from events)"


def _changes(t):
    return t.events.select("event_id", F.expr(_HOST).alias("value"), F.col("user_id").alias("run_key"), F.concat(F.lit("srv"), (F.col("event_id") % 5).cast("string"), F.lit(":t"), (F.col("event_id") % 3).cast("string")).alias("source"),
                           F.col("ts").alias("at"), F.when(F.col("event_type") == "purchase", "confirmed").when(F.col("event_type") == "error", "revoked").alias("decided"))


@query(f"""with {_SEEN}, s as (select *, last_value(decided ignore nulls) over (partition by value order by ts, event_id rows unbounded preceding) as state from e),
 l as (select value, count(distinct run) as runs, min(ts) as first_seen, max(ts) as last_seen from s where decided is null and state is distinct from 'revoked' group by 1), d as (select value, arg_max(decided, (ts, event_id)) filter (decided is not null) as last from s group by 1)
 select d.value, coalesce(last, 'observed') as status, coalesce(runs, 0) as runs, first_seen, last_seen from d left join l on l.value = d.value""")
def memory_upserts(t):
    """Indicators from ordered changes: a sighting of a revoked one counts nothing, the last operator decision stands."""
    return memory.upserts(_changes(t), ["value"], ["at", "event_id"]).select("value", "status", "runs", "first_seen", "last_seen")


@query(f"""with {_SEEN}, c as (select regexp_replace(value, '^mail[.]', '') as host, count(distinct value) as indicators, count(distinct run) as runs, count(distinct split_part(source, ':', 1)) as servers from e group by 1)
 select host, indicators, runs, servers from c where indicators >= 2 and runs >= 2 and servers >= 3 and host not in ('h1.example.com', 'h2.example.com')""")
def memory_escalations(t):
    """Hosts under which several indicators were seen in several runs at several servers; allowed and shared ones never."""
    s = _changes(t).select(F.regexp_replace("value", "^mail[.]", "").alias("host"), "value", "run_key", "source")
    one = lambda h: t.spark.createDataFrame([(h,)], "host string")
    return memory.escalated(s, one("h1.example.com"), one("h2.example.com"))


@query(f"""with {_SEEN}, i as (select value, max(ts) as last_seen, case when bool_or(decided = 'confirmed') then 'confirmed' else 'observed' end as status from e group by 1), dead as (select value from i where status = 'observed' and last_seen < (select max(ts) from e) - interval 2 days)
 select event_id from e where value not in (select value from dead)""")
def sightings_after_purge(t):
    """Sightings that stay once observed items not seen for two days are purged."""
    c = _changes(t)
    items = c.groupBy("value").agg(F.max("at").alias("last_seen"), F.when(F.bool_or(F.col("decided") == "confirmed"), "confirmed").otherwise("observed").alias("status"))
    now = c.agg(F.max("at").alias("now"))
    kept, sightings = memory.purged(items.crossJoin(F.broadcast(now)), c, F.col("now"), days=2, key="value")
    return sightings.select("event_id")


@query(f"""with {_SEEN}, i as (select value, regexp_replace(value, '^mail[.]', '') as grp, arg_max(decided, (ts, event_id)) filter (decided is not null) as last, max(ts) filter (decided is not null) as tm, max(event_id) filter (decided is not null) as tie from e group by 1),
 g as (select grp, arg_max(last, (tm, tie)) as status from i where last is not null group by 1) select value, coalesce(g.status, 'observed') as status from i left join g using (grp)""")
def group_decisions(t):
    """An operator's last decision on one key of a group stands for all of its keys."""
    c = _changes(t).withColumn("group", F.regexp_replace("value", "^mail[.]", ""))
    last = c.where("decided is not null").groupBy("value", "group").agg(F.max_by("decided", F.struct("at", "event_id")).alias("status"), F.max("at").alias("decided_at"), F.max("event_id").alias("tie"))
    return memory.group_decided(c.select("value", "group").distinct(), last).select("value", "status")


@query(f"""with {_SEEN}, i as (select distinct value from e) select value, value in ('h3.example.com', 'h5.example.com') or ends_with(value, '.h3.example.com') or ends_with(value, '.h5.example.com') as revoked from i""")
def allow_revokes(t):
    """Indicators that allowing two hosts revokes: the hosts and what lies under them."""
    allowed = t.spark.createDataFrame([("h3.example.com",), ("h5.example.com",)], "value string")
    return memory.allow_covers(_changes(t).select("value").distinct(), allowed)


@query(f"with {_SEEN} select event_id, source from e where source not in ('srv2') and not starts_with(source, 'srv2:')")
def cleared_source(t):
    """Sightings after a server and its tools are cleared."""
    return memory.clear_source(_changes(t), "srv2").select("event_id", "source")


@query(f"""with {_SEEN}, i as (select value || '/' || event_id as item, split_part(source, ':', 1) as server, ts, event_id from e where decided is null), n as (select server, count(*) as n from i group by 1)
 select server, n from n where n > 100""")
def heavy_servers(t):
    """Servers with more observed items than their quota."""
    i = _changes(t).where("decided is null").select(F.concat_ws("/", "value", "event_id").alias("item"), "source")
    return memory.heavy_sources(i, 100)


@query(f"""with {_SEEN}, i as (select event_id, split_part(source, ':', 1) as server, ts from e where decided is null), q as (select *, row_number() over (partition by server order by ts desc, event_id desc) as a from i),
 g as (select *, row_number() over (order by ts desc, event_id desc) as b from q where a <= 90) select event_id from g where b <= 300""")
def capped_items(t):
    """The newest 90 items of each server, and of these the newest 300."""
    i = _changes(t).where("decided is null").select("event_id", memory.server_of(F.col("source")).alias("server"), "at")
    w = Window.partitionBy("server").orderBy(F.desc("at"), F.desc("event_id"))
    kept = i.withColumn("n", F.row_number().over(w)).where("n <= 90")
    return kept.orderBy(F.desc("at"), F.desc("event_id")).limit(300).select("event_id")


@query("""with w as (select user_id, event_id, event_type || '/' || (event_id % 50) as v, ts from events), l as (select user_id, v, max((ts, event_id)) as last, count(*) as times from w group by 1, 2), r as (select *, row_number() over (partition by user_id order by last desc) as n, count(*) over (partition by user_id) as all_n from l)
 select user_id, v, all_n > 20 as incomplete from r where n <= 20""")
def recent_sets(t):
    """The 20 values of each session seen last, and whether any was dropped."""
    w = t.events.select("user_id", F.concat_ws("/", "event_type", (F.col("event_id") % 50).cast("string")).alias("v"), F.struct("ts", "event_id").alias("at"))
    return memory.recent_set(w, ["user_id"], "v", "at", 20)


@query(f"""with {_SEEN}, now as (select max(ts) as now from e), s as (select source, split_part(source, ':', 1) as server, run, ts from e) ,
 r as (select k as source, count(distinct run) as runs from (select source as k, run, ts from s union all select server, run, ts from s) where ts >= (select now from now) - interval 7 days group by 1) select source, runs, runs >= 5 and source <> 'srv1' as hostile from r""")
def reputations(t):
    """Distinct runs of each source and server in seven days; five or more are hostile, allowed ones never."""
    c = _changes(t)
    both = c.select(F.explode(F.array("source", memory.server_of(F.col("source")))).alias("source"), "run_key", "at")
    now = c.agg(F.max("at").alias("now"))
    return memory.reputation(both.crossJoin(F.broadcast(now)), F.col("now"), t.spark.createDataFrame([("srv1",)], "source string"))


@query("""with e as (select user_id, event_id, ts, case event_type when 'signup' then 'prompt' when 'purchase' then 'call' else 'result' end as kind, event_type = 'error' as bad from events),
 i as (select *, sum((kind = 'prompt')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from e),
 x as (select *, sum((kind = 'call' and event_id % 3 = 0)::int) over (partition by user_id, island order by ts, event_id rows between unbounded preceding and 1 preceding) as refused from i)
 select event_id, kind = 'call' and coalesce(refused, 0) >= 3 as stops from x""")
def turn_stops(t):
    """Whether a call comes after three refusals since the user's last prompt, so that the turn is ended."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = t.events.withColumn("island", F.sum((F.col("event_type") == "signup").cast("int")).over(w))
    call = F.col("event_type") == "purchase"
    before = Window.partitionBy("user_id", "island").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    refused = F.coalesce(F.sum((call & (F.col("event_id") % 3 == 0)).cast("int")).over(before), F.lit(0))
    return e.select("event_id", (call & (refused >= 3)).alias("stops"))
