"""Provenance of calls and their verdicts, over sessions read from `events`.

A user is a session: signups are what the user typed, views and clicks are tool results, errors are results that tried to instruct, purchases are calls.
Each event carries one address, made from its id: a URL, a site, a bare host or a mailbox.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilmill.operators import decisions as dec
from vigilmill.operators import provenance as pv
from vigilmill.plans.registry import query

_HOST = "case when event_id % 3 = 0 then 'mail.' else '' end || 'h' || (event_id % 23) || '.example.com'"
_PATH = "'/p' || (event_id % 5) || case when event_id % 2 = 0 then '/q' || (event_id % 3) else '' end"
_KIND = "case event_id % 7 % 4 when 0 then 'url' when 1 then 'site' when 2 then 'host' else 'email' end"
_A = f"""a0 as (select *, {_HOST} as host, {_KIND} as form from events),
 a as (select event_id, user_id, ts, event_type, form, host, case when form in ('url', 'site') then 'url' else form end as kind, case when form = 'url' then {_PATH} else '' end as path,
  case form when 'url' then 'https://' || host || {_PATH} when 'site' then 'https://' || host when 'host' then host else 'u' || (event_id % 7) || '@' || host end as key from a0),
 u as (select distinct user_id, key, kind, host, path from a where event_type = 'signup'),
 c0 as (select * from a where event_type = 'purchase'), s as (select * from a where event_type in ('view', 'click')), b as (select * from a where event_type = 'error')"""


def _addresses(t):
    host, path = F.expr(_HOST), F.expr(_PATH)
    form = F.expr(_KIND)
    key = F.when(form == "url", F.concat(F.lit("https://"), host, path)).when(form == "site", F.concat(F.lit("https://"), host)).when(form == "host", host).otherwise(F.concat(F.lit("u"), (F.col("event_id") % 7).cast("string"), F.lit("@"), host))
    return t.events.select("event_id", "event_type", F.col("user_id").alias("scope"), F.col("ts").alias("at"), key.alias("key"))


def _parts(t):
    """calls, results, hostile results, what users typed."""
    a = _addresses(t)
    return a.where("event_type = 'purchase'"), a.where("event_type in ('view', 'click')"), a.where("event_type = 'error'"), a.where("event_type = 'signup'")


def _with_ids(found, calls):
    return calls.select("event_id", "scope", "at", "key").join(found, ["scope", "at", "key"])


_OWN = "not exists (select 1 from u where u.user_id = x.user_id and (u.key = x.key or (length(u.path) - length(replace(u.path, '/', '')) >= 2 and starts_with(x.key, u.key || '/'))))"
_SUB = "(x.host = y.host or ends_with(x.host, '.' || y.host))"
_SOURCED = f"""x as (select * from c0 x where {_OWN}),
 so as (select distinct x.event_id from x join s y on y.user_id = x.user_id and y.ts < x.ts where y.key = x.key
  or (x.kind = 'url' and y.kind = 'url' and x.host = y.host and (y.path = '' or (x.path <> '' and (x.path = y.path or starts_with(x.path, y.path || '/') or starts_with(y.path, x.path || '/')))))
  or (y.kind in ('host', 'email') and {_SUB}) or (x.kind = 'host' and y.kind = 'url' and x.host = y.host))"""
_SITES = "v as (select distinct user_id, host from u where kind in ('url', 'host'))"
_TRACED = f"""y0 as (select * from b x where {_OWN}), y as (select * from y0 where not ((kind = 'host' or (kind = 'url' and path = '')) and exists (select 1 from v where v.user_id = y0.user_id and v.host = y0.host))),
 tr as (select x.event_id, case when bool_or(y.path <> '' and x.host = y.host) then 'path' else 'host' end as traced from c0 x join y on y.user_id = x.user_id and y.ts < x.ts and x.kind = 'url' and y.kind in ('url', 'host')
  where (y.path <> '' and x.host = y.host and (x.path = y.path or starts_with(x.path, y.path || '/'))) or (y.path = '' and {_SUB}) group by 1)"""


@query(f"with {_A}, {_SOURCED} select event_id from so")
def call_sourced_from(t):
    """Calls with a value that came from an earlier result of the session and not from the user."""
    calls, results, _, user = _parts(t)
    return _with_ids(pv.sourced_from(calls, results, user), calls).select("event_id")


@query(f"with {_A}, {_SITES}, {_TRACED} select event_id, traced from tr")
def call_traced_urls(t):
    """Calls to URLs built on an address of an earlier hostile result."""
    calls, _, hostile, user = _parts(t)
    return _with_ids(pv.traced_urls(calls, hostile, user), calls).select("event_id", "traced")


@query(f"""with {_A}, {_SITES}, p as (select * from a x where kind in ('url', 'host') and not exists (select 1 from v where v.user_id = x.user_id and v.host = x.host))
 select distinct x.event_id from p x join p y on y.user_id = x.user_id and y.ts < x.ts and y.event_type = 'error' where x.event_type = 'purchase' and ({_SUB} or ends_with(y.host, '.' || x.host))""")
def calls_on_tainted_hosts(t):
    """Calls to the host of an earlier hostile result, a subdomain or a parent of it."""
    calls, _, hostile, user = _parts(t)
    return _with_ids(pv.on_tainted_hosts(calls, hostile, user), calls).select("event_id")


_KNOWN = """i as (select 'exact' as kind, 'https://h' || n || '.example.com/p' || (n % 5) as value, case when n % 2 = 0 then 'confirmed' else 'observed' end as status from range(23) r(n)
  union all select 'domain', 'h' || n || '.example.com', case when n % 3 = 0 then 'confirmed' else 'observed' end from range(0, 23, 4) r(n)),
 k as (select x.event_id, i.kind, i.value, case when i.status = 'confirmed' then 'block' else 'review' end as level from c0 x join i on (i.kind = 'exact' and i.value in (x.key, x.host))
   or (i.kind = 'domain' and (x.host = i.value or ends_with(x.host, '.' || i.value)) and not exists (select 1 from u where u.user_id = x.user_id and (x.host = u.host or ends_with(x.host, '.' || u.host))))
  where not (x.host = 'h8.example.com' or ends_with(x.host, '.h8.example.com'))),
 kb as (select event_id, max_by({'value': value, 'kind': kind, 'level': level}, (case when level = 'block' then 2 else 0 end) + (case when kind = 'exact' then 1 else 0 end)) as m from k group by 1)"""


def _matches(t):
    calls, _, _, user = _parts(t)
    spark = t.spark
    n = spark.range(23)
    exact = n.select(F.lit("exact").alias("kind"), F.expr("'https://h' || id || '.example.com/p' || (id % 5)").alias("value"), F.expr("case when id % 2 = 0 then 'confirmed' else 'observed' end").alias("status"))
    domains = spark.range(0, 23, 4).select(F.lit("domain").alias("kind"), F.expr("'h' || id || '.example.com'").alias("value"), F.expr("case when id % 3 = 0 then 'confirmed' else 'observed' end").alias("status"))
    from vigilmill.functions.values import domain_of

    hosts = user.select("scope", domain_of(F.col("key")).alias("host")).where("host is not null")
    allowed = spark.createDataFrame([("h8.example.com",)], "value string")
    return pv.indicator_matches(calls.withColumnRenamed("event_id", "call_id"), exact.unionByName(domains), allowed, hosts).withColumnRenamed("call_id", "event_id")


@query(f"with {_A}, {_KNOWN} select event_id, m.kind as kind, m.level as level from kb")
def call_known_threats(t):
    """The strongest indicator that a call's address hits, by exact form or by a parent domain; allowed hosts and the user's never."""
    return _matches(t).select("event_id", "kind", "level")


_TOOL = "element_at(array('srv:getItems', 'srv:sendMail', 'srv:search_and_download', 'srv:list', 'pay:transfer'), cast(event_id % 5 + 1 as int))"
_VERDICT = f"""bt as (select x.event_id, bool_or(y.event_id is not null) as tainted_before, bool_or(y.key = x.key) as same from c0 x left join b y on y.user_id = x.user_id and y.ts < x.ts group by 1),
 e as (select x.event_id, x.event_id % 13 = 0 as injected, x.event_id % 11 = 0 as credential, x.event_id % 17 = 0 as cut, x.event_id % 5 in (1, 2, 4) as mutation,
   (coalesce(bt.same, false) and {_OWN}) or coalesce(tr.traced = 'path', false) as untrusted, bt.tainted_before, kb.m.level as known, so.event_id is not null or coalesce(tr.traced = 'host', false) as sourced
  from c0 x left join bt using (event_id) left join tr using (event_id) left join so using (event_id) left join kb using (event_id))
 select event_id, case when injected or untrusted then 'deny' when credential then case when tainted_before then 'deny' else 'ask' end when known = 'block' then 'deny' when known = 'review' then 'ask'
   when sourced and mutation then 'ask' when mutation and tainted_before then 'ask' when cut then 'ask' else 'allow' end as decision,
  case when injected then 'injected_arguments' when untrusted then 'tainted_value' when credential then case when tainted_before then 'credential_after_injection' else 'credential' end when known = 'block' then 'known_attack' when known = 'review' then 'earlier_attack'
   when sourced and mutation then 'sourced_value' when mutation and tainted_before then 'flagged_session' when cut then 'cut_input' else '' end as reason from e"""


def _evidence(t):
    calls, results, hostile, user = _parts(t)
    first = hostile.groupBy("scope").agg(F.min("at").alias("bad_at"))
    values = calls.select("event_id", "scope", "at", "key")
    seen = hostile.groupBy("scope", "key").agg(F.min("at").alias("seen"))
    same = pv.without_users_own(values, user).join(seen, ["scope", "key"]).where("seen < at").select("event_id", F.lit(True).alias("same"))
    traced = _with_ids(pv.traced_urls(calls, hostile, user), calls).select("event_id", "traced")
    sourced = _with_ids(pv.sourced_from(calls, results, user), calls).select("event_id", F.lit(True).alias("sourced"))
    known = _matches(t).select("event_id", F.col("level").alias("known"))
    e = values.join(first, "scope", "left")
    for part in (same, traced, sourced, known):
        e = e.join(part, "event_id", "left")
    no = F.lit(False)
    return e.select(
        "event_id", F.col("event_id") % 13 == 0, F.col("event_id") % 11 == 0, F.col("event_id") % 17 == 0, dec.is_mutation(F.expr(_TOOL)), F.coalesce("same", no) | F.coalesce(F.col("traced") == "path", no),
        F.coalesce(F.col("bad_at") < F.col("at"), no), "known", F.coalesce("sourced", no) | F.coalesce(F.col("traced") == "host", no), "traced",
    ).toDF("event_id", "injected", "credential", "cut", "mutation", "untrusted", "tainted_before", "known", "sourced", "traced")


@query(f"with {_A}, {_SITES}, {_SOURCED}, {_TRACED}, {_KNOWN}, {_VERDICT}")
def call_verdicts(t):
    """The verdict on every call from what its session has seen before it."""
    e, c = _evidence(t), F.col
    v = dec.call_verdict(c("injected"), c("untrusted"), c("credential"), c("tainted_before"), c("known"), c("sourced"), c("mutation"), c("tainted_before"), c("cut"))
    return e.select("event_id", v.alias("v")).select("event_id", "v.decision", "v.reason")


_PRECALL = _VERDICT.split("\n select event_id, case when injected")[0]


@query(f"""with {_A}, {_SITES}, {_SOURCED}, {_TRACED}, {_KNOWN}, {_PRECALL}
 select e.event_id, case when e.event_id % 19 = 0 then 'BLOCK_TOOL_QUARANTINED' when e.event_id % 29 = 0 then 'REVIEW_UNTRUSTED_ARGUMENT_SOURCE' when credential and tainted_before then 'BLOCK_CREDENTIAL_EGRESS' when credential then 'REVIEW_CREDENTIAL_EGRESS'
  when untrusted or e.event_id % 31 = 0 then 'BLOCK_UNTRUSTED_ARGUMENT_SOURCE' when known = 'block' then 'BLOCK_KNOWN_THREAT' when known = 'review' then 'REVIEW_KNOWN_THREAT' when e.event_id % 23 = 0 then 'REVIEW_UNTRUSTED_ARGUMENT_SOURCE'
  when sourced and mutation then 'REVIEW_UNTRUSTED_ARGUMENT_SOURCE' end as code from e""")
def gateway_codes(t):
    """The gateway's code before every call: quarantine, intent, credentials, taint, known threats, other tools' values, sources."""
    e, c = _evidence(t), F.col
    every = lambda n: c("event_id") % n == 0
    code = dec.precall_code(every(19), every(29), c("credential"), c("tainted_before"), c("untrusted"), every(31), F.lit(True), c("traced"), every(23), c("known"), c("sourced"), c("mutation"))
    return e.select("event_id", code.alias("code"))


@query("""with r as (select doc_id, doc_id % 7 = 0 as rules, doc_id % 11 = 0 as pack, doc_id % 2 = 0 as local, doc_id % 3 = 0 as collapsed, doc_id % 5 = 0 as memory, doc_id % 13 = 0 as hostile, doc_id % 17 = 0 as judged, doc_id % 19 = 0 as classified from documents),
 v as (select *, case when rules and not local then 'rules' when pack and not local then 'pack' when rules or pack then 'local' when collapsed then 'collapsed' when memory then 'memory' when hostile then 'hostile_source' when judged then 'judge' when classified then 'classifier' else 'none' end as evidence from r)
 select doc_id, evidence, case when evidence in ('rules', 'pack') then 'deny' else 'allow' end as decision, evidence in ('rules', 'pack') as taints, evidence not in ('rules', 'pack', 'none') as observes, evidence = 'judge' as soft from v""")
def result_verdicts(t):
    """What a tool result does to its session, by the strongest evidence against it."""
    every = lambda n: F.col("doc_id") % n == 0
    v = dec.result_verdict(every(7), every(11), every(2), every(3), every(5), every(13), every(17), every(19), block_outputs=True)
    return t.documents.select("doc_id", v.alias("v")).select("doc_id", "v.evidence", "v.decision", "v.taints", "v.observes", "v.soft")


@query("""with x as (select event_id, ['allow', 'ask', 'deny'][event_id % 3 + 1] as first, ['allow', 'ask', 'deny'][event_id // 3 % 3 + 1] as second, event_id % 5 = 0 as lim, event_id % 2 = 0 as never from events),
 y as (select event_id, first, case when never and second = 'ask' then case when lim then 'deny' else 'allow' end else second end as second from x)
 select event_id, case when 'deny' in (first, second) then 'deny' when 'ask' in (first, second) then 'ask' else 'allow' end as decision from y""")
def merged_verdicts(t):
    """The stricter of two verdicts; without review an ask falls away, or denies where a limit raised it."""
    pick = lambda n: F.element_at(F.array(*map(F.lit, ("allow", "ask", "deny"))), (n % 3 + 1).cast("int"))
    e = F.col("event_id")
    return t.events.select("event_id", dec.stricter_verdict(pick(e), pick(F.floor(e / 3)), e % 5 == 0, e % 2 == 0).alias("decision"))


@query("""with h as (select l_orderkey, l_linenumber as n, case l_returnflag when 'R' then 'deny' when 'A' then 'ask' else 'allow' end as d, l_linestatus = 'O' as named, l_partkey as part from lineitem),
 g as (select l_orderkey, min_by(part, (n, part)) filter (d = 'deny' and not named) as a, min_by(part, (n, part)) filter (d = 'deny') as b, min_by(part, (n, part)) filter (d = 'ask' and not named) as c from h group by 1)
 select l_orderkey, case when a is not null then 'deny' when b is not null or c is not null then 'ask' else 'allow' end as decision, coalesce(a, b, c)::varchar as reason from g where coalesce(a, b, c) is not null""")
def worst_hits(t):
    """Of a command's hits in order: a deny that the user did not name, else a named one softened to an ask, else an ask."""
    d = F.when(F.col("l_returnflag") == "R", "deny").when(F.col("l_returnflag") == "A", "ask").otherwise("allow")
    hit = F.struct("l_linenumber", "l_partkey", d.alias("decision"), F.col("l_partkey").cast("string").alias("reason"), (F.col("l_linestatus") == "O").alias("named"))
    g = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(hit)).alias("hits"))  # a command has few hits
    v = dec.worst_hit(F.transform("hits", lambda h: F.struct(h["decision"].alias("decision"), h["reason"].alias("reason"), h["named"].alias("named"))))
    return g.select("l_orderkey", v.alias("v")).select("l_orderkey", "v.decision", "v.reason").where("decision <> 'allow'")


@query("""with x as (select *, case when event_id % 10 = 0 then 0.0 when event_id % 4 = 0 then 0.3 else 0.95 end::double as alignment, row_number() over (partition by user_id order by ts, event_id) as n, event_id % 5 in (1, 2, 4) as mutation,
  case when event_id % 6 = 0 then 'BLOCK' when event_id % 5 in (1, 2, 4) then 'REVIEW' else 'CLEAR' end as disposition from events)
 select event_id, case when event_id % 41 = 0 then 'BLOCK_TOOL_NOT_REGISTERED' when event_id % 37 = 0 then 'BLOCK_TOOL_PROHIBITED' when event_id % 31 = 0 then 'BLOCK_TOOL_NOT_ALLOWED' when event_id % 29 = 0 then 'BLOCK_SCHEMA_DRIFT' when n > 4 then 'BLOCK_CALL_BUDGET_EXCEEDED'
  when event_type = 'error' then 'BLOCK_INJECTION_DETECTED' when event_id % 23 = 0 then 'BLOCK_RESOURCE_OUT_OF_SCOPE' when event_id % 19 = 0 then 'BLOCK_DESTINATION_OUT_OF_SCOPE' when event_id % 17 = 0 then 'BLOCK_INVALID_ARGUMENTS' when event_id % 13 = 0 then 'BLOCK_RESOURCE_OUT_OF_SCOPE'
  when event_id % 11 = 0 then 'BLOCK_DESTINATION_OUT_OF_SCOPE' when alignment < 0.6 and (mutation or event_id % 2 = 1 or alignment = 0) and not (mutation and disposition = 'REVIEW') then 'BLOCK_INTENT_MISMATCH' when disposition = 'BLOCK' then 'BLOCK_SECURITY_AGENTS'
  when mutation and event_id % 7 = 0 then 'BLOCK_IDEMPOTENCY_REQUIRED' when (mutation or event_id % 9 = 0) and event_id % 3 <> 0 then 'REVIEW' when mutation then 'ALLOW_APPROVAL_VERIFIED' else 'ALLOW_POLICY_SATISFIED' end as code from x""")
def policy_codes(t):
    """The whole policy ladder over every call."""
    from pyspark.sql import Window

    e, every = F.col("event_id"), lambda n: F.col("event_id") % n == 0
    mutation = dec.is_mutation(F.expr(_TOOL))
    code = dec.policy_full(
        registered=~every(41), prohibited=every(37), allowed=~every(31), schema_match=~every(29), call_index=F.col("n"), injection=F.when(F.col("event_type") == "error", 0.9).otherwise(0.02), missing_resource=every(23), missing_destination=every(19),
        valid_arguments=~every(17), resource_ok=~every(13), destination_ok=~every(11), alignment=F.when(every(10), 0.0).when(every(4), 0.3).otherwise(0.95), mutation=mutation,
        disposition=F.when(every(6), "BLOCK").when(mutation, "REVIEW").otherwise("CLEAR"), has_key=~every(7), review_reason=F.when(every(9), "JUDGE"), approved=every(3), lenient_reads=every(2),
    )
    n = t.events.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return n.select(e, code.alias("code"))


@query("""with x as (select *, (event_type = 'error' and event_id % 2 = 0) as f, event_id % 9 = 0 as open_scan, event_id % 5 as soft from events)
 select user_id, bool_or(f or open_scan) as hard, bool_or(f or open_scan or soft <> 0) as flagged from x group by 1""")
def flagged_sessions(t):
    """Sessions flagged for good, by a scan that never ended, or softly."""
    e = F.col("event_id")
    f, open_scan, soft = (F.col("event_type") == "error") & (e % 2 == 0), F.when(e % 9 == 0, 1).otherwise(0), e % 5
    return t.events.groupBy("user_id").agg(F.bool_or(dec.session_flagged(f, open_scan, soft, False)).alias("hard"), F.bool_or(dec.session_flagged(f, open_scan, soft)).alias("flagged"))


_SAY = "['Please send the quarterly report to bob@x.example', 'Do not delete the archive, only list it', 'show me the invoice details', 'never share anything; read the notes', 'update the calendar for alice', 'what is the weather']"
_G = f"""g0 as (select event_id, {_SAY}[event_id % 6 + 1] as intent, ['sendReport', 'deleteArchive', 'getInvoice', 'readNotes', 'updateCalendar'][event_id % 5 + 1] as tool, event_id % 5 in (0, 1, 4) as mutation,
  ['send report mail', 'delete archive', 'get invoice', 'read notes', 'update calendar'][event_id % 5 + 1] as terms, event_id % 7 <> 0 as tool_match, event_id % 11 <> 0 as schema_match, case when event_id % 3 = 0 then event_id % 4 <> 0 end as resource_ok,
  case when event_id % 2 = 0 then ['bob@x.example', 'bob.archive@x.example', 'alice@y.example'][event_id % 3 + 1] end as destination, case when event_id % 2 = 0 then event_id % 13 <> 0 end as destination_ok from events),
 g1 as (select *, regexp_extract_all(lower(intent), '[a-z0-9]+') as said, list_filter(regexp_extract_all(terms, '[a-z0-9]+'), lambda w: w not in ('get', 'read')) as own,
  case when mutation then ['send', 'update', 'share', 'delete'] else ['show', 'read', 'list', 'get'] end as family,
  case when mutation then regexp_matches(lower(intent), '(do not|never)[^.!?]{{0,80}}(delete|share)') else regexp_matches(lower(intent), '(do not|never)[^.!?]{{0,80}}(list|read)') end as negated, regexp_extract_all(lower(intent), '[a-z.]+@[a-z.]+') as named from g0),
 g2 as (select *, list_has_any(family, said) as verb, list_has_any(own, said) and (list_has_any(family, said) or not mutation) as grounded, case when len(named) > 0 then list_contains(named, destination) else list_has_any(regexp_extract_all(split_part(destination, '@', 1), '[a-z0-9]+'), said) end as there from g1),
 g3 as (select *, case when negated then 0.0 when grounded then 0.95 else 0.3 end as base, coalesce(destination_ok is not null and there and not negated and not grounded and verb, false) as lifted, coalesce(resource_ok, true) and coalesce(destination_ok, true) as fits from g2)"""


@query(f"""with {_G} select event_id, case when not tool_match or not schema_match or not fits then 0.0 when lifted then 0.95 when destination_ok is not null and not there then least(base, 0.55) else base end::double as alignment, case when fits then 1.0 else 0.0 end::double as scope,
 array_to_string(list_filter([case when tool_match then 'TOOL_METADATA_MATCH' else 'TOOL_METADATA_MISMATCH' end, case when schema_match then 'SCHEMA_HASH_MATCH' else 'SCHEMA_HASH_MISMATCH' end, case when negated then 'ACTION_EXPLICITLY_NEGATED' when grounded or lifted then 'ACTION_GROUNDED' else 'ACTION_NOT_GROUNDED' end,
  case when resource_ok then 'RESOURCE_IN_SCOPE' when not resource_ok then 'RESOURCE_OUT_OF_SCOPE' end, case when not destination_ok then 'DESTINATION_OUT_OF_SCOPE' when destination_ok and there then 'DESTINATION_GROUNDED' when destination_ok then 'DESTINATION_NOT_GROUNDED' end], lambda r: r is not null), ',') as reasons from g3""")
def call_grounding(t):
    """How far the request of a session grounds each call: verb and subject named, negation, scope and address."""
    e = F.col("event_id")
    pick = lambda n, xs: F.element_at(F.array(*map(F.lit, xs)), (e % n + 1).cast("int"))
    says = [x.strip("'") for x in _SAY[1:-1].split("', '")]
    g = dec.grounding(
        pick(6, says), pick(5, ("send report mail", "delete archive", "get invoice", "read notes", "update calendar")), (e % 5).isin(0, 1, 4), e % 7 != 0, e % 11 != 0, F.when(e % 3 == 0, e % 4 != 0),
        F.when(e % 2 == 0, pick(3, ("bob@x.example", "bob.archive@x.example", "alice@y.example"))), F.when(e % 2 == 0, e % 13 != 0),
    )
    return t.events.select("event_id", g.alias("g")).select("event_id", "g.alignment", "g.scope", F.array_join("g.reasons", ",").alias("reasons"))
