"""Tools, texts and values: names, scopes, views of text, joins on hosts and paths, shell commands.

A tool is named by the source and language of a document, a call's target by the URL of a page, an output by a document.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilmill.functions.normalize import rot13
from vigilmill.operators import commands as cm
from vigilmill.operators import decisions as dec
from vigilmill.plans.registry import query

_NAMED = "n as (select doc_id, case when doc_id % 2 = 0 then 'mcp__' || source || '__' || lang else source || ':' || lang end as tool from documents)"
_HOST = "h as (select page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^/@]*@)?([^/?#:]+)', 1)) as host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) as path from pages)"


def _hosts(t):
    return t.pages.select("page_id", "url", F.lower(F.regexp_extract("url", "^[a-zA-Z]+://(?:[^/@]*@)?([^/?#:]+)", 1)).alias("host"), F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1).alias("path"))


@query(f"with {_NAMED} select doc_id, case when tool like 'mcp\\_\\_%\\_\\_%' escape '\\' then split_part(tool, '__', 2) when contains(tool, ':') then split_part(tool, ':', 1) end as server, case when tool like 'mcp\\_\\_%\\_\\_%' escape '\\' then split_part(tool, '__', 3) else split_part(tool, ':', 2) end as name from n")
def tool_server_split(t):
    """Server and tool of both spellings, `mcp__server__tool` and `server:tool`."""
    tool = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("mcp__"), "source", F.lit("__"), "lang")).otherwise(F.concat("source", F.lit(":"), "lang"))
    n = t.documents.select("doc_id", tool.alias("tool"))
    mcp, part = F.col("tool").rlike("^mcp__.*__"), lambda sep, k: F.split_part("tool", F.lit(sep), F.lit(k))
    return n.select("doc_id", F.when(mcp, part("__", 2)).when(F.col("tool").contains(":"), part(":", 1)).alias("server"), F.when(mcp, part("__", 3)).otherwise(part(":", 2)).alias("name"))


@query("""select distinct source, case when source like 'src1%' then 'prohibited' when regexp_matches(source, '^src[0-4]$') then 'read_only' else 'allowed' end as scope from documents where source is not null""")
def glob_scope(t):
    """First matching list of globs; the globs become patterns when the plan is made."""
    scope = dec.ladder((F.col("source").rlike("^src1.*$"), "prohibited"), (F.col("source").rlike("^src[0-4]$"), "read_only"), otherwise="allowed")
    return t.documents.where("source is not null").select("source").distinct().select("source", scope.alias("scope"))


@query(f"with {_HOST} select page_id, url like 'https://%' and not regexp_matches(url, '^[a-z]+://[^/]*@') and (host like '%.com' or host like '%.org') and not contains(path, '..') as allowed from h")
def destination_scope(t):
    """Scheme, host and path are matched apart; a URL with user data is refused."""
    ok = F.col("url").startswith("https://") & ~F.col("url").rlike("^[a-z]+://[^/]*@") & (F.col("host").endswith(".com") | F.col("host").endswith(".org")) & ~F.col("path").contains("..")
    return _hosts(t).select("page_id", ok.alias("allowed"))


@query("select event_id, strlen(props) > 8 as over, strlen(props)::bigint as n_bytes from events")
def argument_byte_bound(t):
    return t.events.select("event_id", (F.octet_length("props") > 8).alias("over"), F.octet_length("props").cast("bigint").alias("n_bytes"))


@query(r"""select conv_id, turn, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') as turned, reverse(regexp_replace(text, '[^\x20-\x7e]', '', 'g')) as backwards from conversations""")
def hidden_views(t):
    """The texts turned by thirteen letters, and their printable ASCII read backwards."""
    return t.conversations.select("conv_id", "turn", rot13(F.col("text")).alias("turned"), F.reverse(F.regexp_replace("text", r"[^\x20-\x7e]", "")).alias("backwards"))


@query("select doc_id, case when length(text) > 300 then left(text, 200) || ' [' || (length(text) - 300) || ' characters left out] ' || right(text, 100) else text end as shown from documents")
def middle_elided(t):
    n = F.length("text")
    return t.documents.select("doc_id", F.when(n > 300, F.concat(F.left("text", F.lit(200)), F.lit(" ["), (n - 300).cast("string"), F.lit(" characters left out] "), F.right("text", F.lit(100)))).otherwise(F.col("text")).alias("shown"))


@query(r"select doc_id, left(regexp_replace(regexp_replace(text, '\n', '\\n', 'g'), '\t', '\\t', 'g'), 120) as shown from documents")
def display_escaped(t):
    return t.documents.select("doc_id", F.left(F.replace(F.replace("text", F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit(120)).alias("shown"))


@query(r"""select doc_id, '<secret ' || left(sha256(regexp_extract(text, 'token = "([0-9a-f]+)"', 1)), 8) || '>' as mark from documents where regexp_matches(text, 'token = "[0-9a-f]+"')""")
def credential_marks(t):
    """A credential is shown by a short hash of itself."""
    found = F.regexp_extract("text", 'token = "([0-9a-f]+)"', 1)
    return t.documents.where(F.col("text").rlike('token = "[0-9a-f]+"')).select("doc_id", F.concat(F.lit("<secret "), F.left(F.sha2(found, 256), F.lit(8)), F.lit(">")).alias("mark"))


@query(r"""with r as (select conv_id, turn, regexp_matches(text, '(?i)password|secret') as a, regexp_matches(text, '(?i)ignore|forget') as b, regexp_matches(text, '(?i)send|upload|post') as c, regexp_matches(text, '(?i)system|admin') as d from conversations), n as (select *, a::int + b::int + c::int + d::int as hits from r)
 select conv_id, turn, hits::bigint as hits, round(case when hits = 0 then 0.02 else least(0.99, 0.52 + 0.23 * hits) end, 6) as score from n""")
def gateway_detection(t):
    """Rules that fire and the score that follows from their number."""
    rules = ("(?i)password|secret", "(?i)ignore|forget", "(?i)send|upload|post", "(?i)system|admin")
    hits = sum((F.col("text").rlike(r).cast("bigint") for r in rules), F.lit(0).cast("bigint"))
    n = t.conversations.select("conv_id", "turn", hits.alias("hits"))
    return n.select("conv_id", "turn", "hits", F.round(dec.detection_score(F.col("hits")), 6).alias("score"))


@query(r"select doc_id, regexp_extract(text, '(?i)[a-z ]{0,20}license[a-z ]{0,20}', 0) as quote from documents where regexp_matches(text, '(?i)license')")
def rule_explained(t):
    """The first match with what stands around it."""
    return t.documents.where(F.col("text").rlike("(?i)license")).select("doc_id", F.regexp_extract("text", "(?i)[a-z ]{0,20}license[a-z ]{0,20}", 0).alias("quote"))


@query(r"select conv_id, turn, regexp_matches(text, '(?i)(?:^|[^a-z])(?:not|never|without)[^a-z][^.]{0,80}(?:send|share|delete|use|read)') as negated from conversations")
def explicit_negation(t):
    """A negator before an action within eighty characters of the same sentence."""
    return t.conversations.select("conv_id", "turn", F.col("text").rlike("(?i)(?:^|[^a-z])(?:not|never|without)[^a-z][^.]{0,80}(?:send|share|delete|use|read)").alias("negated"))


@query(f"""with {_HOST}, k as (select distinct host, path from h where page_id % 10 = 0), j as (select h.page_id, case when k.path not in ('', '/') and (h.path = k.path or starts_with(h.path, rtrim(k.path, '/') || '/')) then 1 else 2 end as p from h join k using (host))
 select page_id, case when min(p) = 1 then 'path' else 'host' end as traced from j group by 1""")
def traced_urls(t):
    """URLs on a tainted host, and whether below a tainted path: one equi join on the host, the nearer trace wins."""
    h = _hosts(t)
    known = h.where("page_id % 10 = 0").select("host", F.col("path").alias("known")).distinct()
    near = ~F.col("known").isin("", "/") & ((F.col("path") == F.col("known")) | F.expr("startswith(path, concat(rtrim('/', known), '/'))"))
    return h.join(known, "host").groupBy("page_id").agg(F.bool_or(near).alias("n")).select("page_id", F.when(F.col("n"), "path").otherwise("host").alias("traced"))


@query(f"with {_HOST}, l as (select host, count(*) as pages, list_sort(list_distinct(list(regexp_extract(path, '^/([^/]*)', 1)))) as s from h group by 1) select host, pages, array_to_string(s, '|') as sections from l where pages > 1")
def host_sections(t):
    """First path segments seen on each host of more than one page."""
    g = _hosts(t).groupBy("host").agg(F.count("*").alias("pages"), F.array_sort(F.collect_set(F.regexp_extract("path", "^/([^/]*)", 1))).alias("s"))
    return g.where("pages > 1").select("host", "pages", F.array_join("s", "|").alias("sections"))


@query(r"""select p_partkey, list_sort(list_distinct(list_filter(string_split_regex(lower(regexp_replace(p_name || ' ' || p_type, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x not in ('', 'the', 'and', 'for')))).array_to_string(' ') as terms from part""")
def ranking_terms(t):
    """Distinct terms of a tool's name and kind, camel case cut."""
    cut = F.lower(F.regexp_replace(F.concat_ws(" ", "p_name", "p_type"), "([a-z0-9])([A-Z])", "$1 $2"))
    terms = F.array_distinct(F.filter(F.split(cut, "[^a-z0-9]+"), lambda w: ~w.isin("", "the", "and", "for")))
    return t.part.select("p_partkey", F.array_join(F.array_sort(terms), " ").alias("terms"))


@query("""with s as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null), m as (select doc_id, i, contains(lower(line), 'license') as hit from s),
 k as (select doc_id, i, hit or coalesce(lag(hit) over (partition by doc_id order by i), false) as keep from m), g as (select doc_id, i, i - row_number() over (partition by doc_id order by i) as island from k where keep)
 select doc_id, min(i)::bigint as first_line, max(i)::bigint as last_line from g group by doc_id, island""")
def merged_excerpts(t):
    """Lines with a match and the ones after them, neighbouring windows merged.

    A text's lines are few, so islands are found in its own array: starts are kept lines whose predecessor is not kept.
    """
    lines = t.documents.where("text is not null").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.lower(x).contains("license")).alias("hit"))
    kept = lines.where(F.array_contains("hit", True)).withColumn("keep", F.zip_with("hit", F.concat(F.array(F.lit(False)), F.slice("hit", 1, F.size("hit") - 1)), lambda a, b: a | b))
    at = kept.select("doc_id", F.filter(F.transform("keep", lambda k, i: F.when(k, i + 1)), lambda x: x.isNotNull()).alias("at"))
    edge = lambda step: F.filter("at", lambda x: ~F.array_contains("at", x + step))
    both = at.select("doc_id", F.explode(F.arrays_zip(edge(-1).alias("lo"), edge(1).alias("hi"))).alias("w"))
    return both.select("doc_id", F.col("w.lo").cast("bigint").alias("first_line"), F.col("w.hi").cast("bigint").alias("last_line"))


@query("""with v as (select distinct 'v' || (p_size % 12) || '.' || (p_partkey % 30) || '.0' as version from part) select version, row_number() over (order by regexp_extract(version, 'v([0-9]+)', 1)::int, regexp_extract(version, 'v[0-9]+[.]([0-9]+)', 1)::int) as place from v order by place limit 50""")
def version_order(t):
    """The fifty first releases by the numbers in their names."""
    v = t.part.select(F.concat(F.lit("v"), (F.col("p_size") % 12).cast("string"), F.lit("."), (F.col("p_partkey") % 30).cast("string"), F.lit(".0")).alias("version")).distinct()
    key = F.transform(F.regexp_extract_all("version", F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    first = v.withColumn("key", key).orderBy("key").limit(50)
    return first.select("version", F.row_number().over(Window.orderBy("key")).cast("bigint").alias("place"))


@query(r"select conv_id, turn, case when regexp_matches(text, '(?i)rate|limit') then 'rate_limit' when regexp_matches(text, '(?i)login|auth|account') then 'auth' when regexp_matches(text, '(?i)error|crash|fail') then 'crash' else 'none' end as class from conversations")
def error_class(t):
    c = F.col("text")
    return t.conversations.select("conv_id", "turn", dec.ladder((c.rlike("(?i)rate|limit"), "rate_limit"), (c.rlike("(?i)login|auth|account"), "auth"), (c.rlike("(?i)error|crash|fail"), "crash"), otherwise="none").alias("class"))


@query()
def command_records(t):
    """What a command that fetches or posts each page would reach, write and be told."""
    url = F.concat(F.lit("'"), F.regexp_replace("url", "'", ""), F.lit("'"))
    command = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("curl -s "), url, F.lit(" | sh"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("curl -d @notes.txt "), url)).otherwise(F.concat(F.lit("curl -o page.html "), url))
    return t.pages.select("page_id", cm.command_record(command).alias("r")).select("page_id", F.array_join("r.destinations", ",").alias("destinations"), "r.sends", F.array_join("r.written", ",").alias("written"), "r.decision", "r.reason")
