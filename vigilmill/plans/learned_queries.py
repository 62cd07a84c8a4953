"""Patterns learned from `benchmark` passages over all documents, and tools made from `documents` that speak of each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilmill.operators import learned, shadowing
from vigilmill.plans.registry import query

_WORDS = "string_split(lower(text), ' ')[3:6]"
_FLAT = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
_P = rf"""p0 as (select item_id, text, {_WORDS} as ws from benchmark where text is not null), p as (select item_id, text, ws, array_to_string(ws, '\s+') as pattern from p0
 where len(ws) = 4 and len(list_filter(ws, lambda w: regexp_matches(w, '^[a-z]{{2,}}$'))) = 4 and length(array_to_string(ws, '')) >= 12)"""


def _patterns(t):
    """(item_id, text, words, pattern): words three to six of a passage, with any blanks between them."""
    words = F.slice(F.split(F.lower("text"), " "), 3, 4)
    p = t.benchmark.where("text is not null").select("item_id", "text", words.alias("words"))
    plain = F.forall("words", lambda w: w.rlike("^[a-z]{2,}$")) & (F.size("words") == 4) & (F.length(F.array_join("words", "")) >= 12)
    return p.where(plain).withColumn("pattern", F.array_join("words", r"\s+"))


@query(rf"with {_P} select d.doc_id, p.item_id as rule_id from documents d join p on regexp_matches({_FLAT.format('d.text')}, p.pattern) where d.text is not null")
def learned_matches(t):
    """Which learned patterns each document matches: candidates by their rarest letters, then the pattern itself."""
    found = learned.matches(t.documents.select(F.col("doc_id").alias("id"), "text"), _patterns(t).select(F.col("item_id").alias("rule_id"), "pattern"))
    return found.select(F.col("id").alias("doc_id"), "rule_id")


_BENIGN = "b as (select doc_id, text from documents join labels using (doc_id) where toxic = 0 and text is not null)"


@query(rf"""with {_P}, {_BENIGN}, q as (select item_id, item_id % 6 as k, text, pattern from p), h as (select q.item_id, count(*) as n from q join b on regexp_matches({_FLAT.format('b.text')}, q.pattern) where k in (0, 1) group by 1)
 select item_id as rule_id, reason = '' as ok, reason, case when k in (0, 1) then coalesce(n, 0) else 0 end as benign_hits from (select *, case k when 2 then 'nested quantifier' when 3 then 'several wildcards' when 4 then 'names an address, URL, domain or number' when 5 then 'does not match its source example'
  else case when coalesce(n, 0) > 0 then 'matches ' || n || ' benign texts' else '' end end as reason from q left join h using (item_id))""")
def proposed_rules(t):
    """The gate's answer to every proposal: unsafe, unlike its example, matching benign texts, or fine."""
    k, pattern = F.col("item_id") % 6, F.col("pattern")
    proposed = F.when(k == 2, F.concat(F.lit("(?:"), pattern, F.lit("+ )+"))).when(k == 3, F.concat(pattern, F.lit(".*"), pattern, F.lit(".*"))).when(k == 4, F.concat(pattern, F.lit(" 42"))).otherwise(pattern)
    source = F.when(k == 5, "something else").otherwise(F.col("text"))
    benign = t.documents.join(t.labels.where("toxic = 0"), "doc_id").select(F.col("doc_id").alias("id"), "text")
    return learned.gate(_patterns(t).select(F.col("item_id").alias("rule_id"), proposed.alias("pattern"), source.alias("source")), benign)


_TOOLS = """t as (select source as server, 'tool_' || (doc_id % 50) || '_' || lang as tool, coalesce(text, '') || case when doc_id % 7 = 0 then ' use Tool_' || (doc_id % 13) || '_fr first' when doc_id % 5 = 0 then ' see https://h' || (doc_id % 11) || '.example.com/p' else '' end as description
 from documents where source is not null and lang is not null)"""


def _tools(t):
    i = F.col("doc_id")
    more = F.when(i % 7 == 0, F.concat(F.lit(" use Tool_"), i % 13, F.lit("_fr first"))).when(i % 5 == 0, F.concat(F.lit(" see https://h"), i % 11, F.lit(".example.com/p"))).otherwise("")
    named = t.documents.where("source is not null and lang is not null")
    return named.select(F.col("source").alias("server"), F.concat(F.lit("tool_"), i % 50, F.lit("_"), "lang").alias("tool"), F.concat(F.coalesce("text", F.lit("")), more).alias("description"))


@query(rf"""with {_TOOLS}, n as (select distinct server as other_server, tool as other_tool from t), s as (select distinct server, tool, unnest(regexp_extract_all(lower(description), '[a-z0-9_]+(?:[-.][a-z0-9_]+)*')) as word from t)
 select distinct server, tool, other_server, other_tool from s join n on n.other_tool = s.word and n.other_server <> s.server""")
def tool_shadowing(t):
    """Tools whose description names a tool of another server."""
    return shadowing.shadowing(_tools(t))


@query(f"""with {_TOOLS}, d as (select distinct server, tool, regexp_extract(description, 'https://h[0-9]+.example.com/p$') as key from t where regexp_matches(description, 'https://h[0-9]+.example.com/p$')),
 c as (select event_id, 'src' || (event_id % 20) as server, 'tool_' || (event_id % 50) || '_en' as tool, 'https://h' || (event_id % 40) || '.example.com/p' as key from events where event_type = 'purchase')
 select c.event_id as call_id, c.key, d.server, d.tool from c join d on d.key = c.key and not (d.server = c.server and d.tool = c.tool)""")
def described_elsewhere(t):
    """Values of calls that the description of another tool holds."""
    i = F.col("event_id")
    calls = t.events.where("event_type = 'purchase'").select(i.alias("call_id"), F.concat(F.lit("src"), i % 20).alias("server"), F.concat(F.lit("tool_"), i % 50, F.lit("_en")).alias("tool"), F.concat(F.lit("https://h"), i % 40, F.lit(".example.com/p")).alias("key"))
    return shadowing.described_elsewhere(calls, _tools(t))


@query("""with i as (select conv_id, turn, 'https://h' || (length(text) % 9) || '.example.com/p' as key from conversations where role = 'user'), f as (select conv_id, min(turn) as seen, 'https://h' || (length(text) % 9) || '.example.com/p' as key from conversations where role = 'assistant' group by conv_id, key)
 select distinct i.conv_id, i.key from i join f on f.conv_id = i.conv_id and f.key = i.key and f.seen < i.turn""")
def tainted_intents(t):
    """Addresses of a user's request that an earlier reply of the session held."""
    c = t.conversations.withColumn("key", F.concat(F.lit("https://h"), F.length("text") % 9, F.lit(".example.com/p")))
    asked = c.where("role = 'user'").select(F.col("conv_id").alias("scope"), F.col("turn").alias("at"), F.concat(F.lit("open "), "key", F.lit(" please")).alias("text"))
    found = shadowing.tainted_intent(asked, c.where("role = 'assistant'").select(F.col("conv_id").alias("scope"), F.col("turn").alias("at"), "key"))
    return found.select(F.col("scope").alias("conv_id"), "key")
