"""Nested JSON made from the fixture tables: a call for every turn of a conversation, a tool's schema for every part."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilmill.functions import nested
from vigilmill.operators import schemas
from vigilmill.plans.registry import query


def _calls(t):
    """(conv_id, turn, call): the text in an argument, once more deep inside, and line by line as text blocks."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.lit("text").alias("type"), x.alias("text")))
    deep = F.struct(F.struct(F.array("text").alias("y")).alias("x"))
    arguments = F.struct("text", "turn", F.array(F.lit("a"), F.col("role")).alias("tags"), deep.alias("deep"))
    return t.conversations.select("conv_id", "turn", "role", "text", F.to_json(F.struct(F.col("role").alias("tool"), arguments.alias("arguments"), lines.alias("content"))).alias("call"))


@query("""select conv_id, turn, 'tool' || chr(10) || role || chr(10) || 'arguments' || chr(10) || 'text' || chr(10) || text || chr(10) || 'turn' || chr(10) || turn || chr(10) || 'tags' || chr(10) || 'a' || chr(10) || role || chr(10)
 || 'deep' || chr(10) || 'x' || chr(10) || 'y' || chr(10) || text || chr(10) || 'content' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x: 'type' || chr(10) || 'text' || chr(10) || 'text' || chr(10) || x), chr(10)) as leaf_text from conversations""")
def call_leaf_text(t):
    """Keys, strings and numbers of every call in document order."""
    return _calls(t).select("conv_id", "turn", nested.leaf_text(F.col("call")).alias("leaf_text"))


@query("""select conv_id, turn, translate(role || ' ' || text || '  a' || chr(10) || role || ' ' || text || ' ' || array_to_string(list_transform(string_split(text, chr(10)), lambda x: 'text ' || x), chr(10)), '|,;', '   ') as said from conversations""")
def call_values_text(t):
    """The strings of every call without keys: an instruction split over fields reads as one."""
    return _calls(t).select("conv_id", "turn", nested.values_text(F.col("call")).alias("said"))


@query("""select conv_id, turn, 'arguments.tags' as path, 'a ' || role as spaced, 'a' || role as glued from conversations
 union all select conv_id, turn, 'content', replace(text, chr(10), ' '), replace(text, chr(10), '') from conversations where contains(text, chr(10))""")
def call_blocks(t):
    """Neighbouring text blocks of every list put together."""
    return nested.joined_blocks(_calls(t), "call", "conv_id", "turn")


@query(r"""with e as (select *, array_to_string(list_transform(string_split(to_json(text)::varchar, ''), lambda c: case when ord(c) < 128 then c else printf('\u%04x', ord(c)) end), '') as js,
  array_to_string(list_transform(string_split(text, chr(10)), lambda x: '{"text":' || array_to_string(list_transform(string_split(to_json(x)::varchar, ''), lambda c: case when ord(c) < 128 then c else printf('\u%04x', ord(c)) end), '') || ',"type":"text"}'), ',') as ls from conversations)
 select conv_id, turn, sha256('{"arguments":{"deep":{"x":{"y":[' || js || ']}},"tags":["a","' || role || '"],"text":' || js || ',"turn":' || turn || '},"content":[' || ls || '],"tool":"' || role || '"}') as hash, true as same from e""")
def call_hashes(t):
    """The stable hash of every call, and whether the call written with its keys in another order and blanks between has the same."""
    again = F.concat(F.lit("{ "), F.regexp_replace(F.to_json(F.struct(F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("text"), F.lit("text").alias("type"))).alias("content"))), r"\A\{|\}\z", ""), F.lit(' ,\n "arguments" : '), F.regexp_extract("call", r'"arguments":(.*),"content":', 1), F.lit(' , "tool":"'), F.col("role"), F.lit('"}'))
    return _calls(t).select("conv_id", "turn", nested.stable_hash(F.col("call")).alias("hash"), (nested.stable_hash(F.col("call")) == nested.stable_hash(again)).alias("same"))


@query("""select conv_id, turn, 'Tool = ' || role || chr(10) || 'deep.[0] = ' || conv_id || chr(10) || 'deep.[1].note = two words' || chr(10) || 'n = ' || turn as surface from conversations""")
def call_surface(t):
    """The arguments of every call as sorted lines of keys and values, as rules read them."""
    deep = F.concat(F.lit('{"n":'), "turn", F.lit(',"deep":['), "conv_id", F.lit(',{"note":"two \\n  words"}],"Tool":"'), "role", F.lit('"}'))
    return nested.argument_surface(t.conversations.select("conv_id", "turn", deep.alias("call")), "call", "conv_id", "turn")


@query("select conv_id, turn, turn * 20 + 1 as levels, turn * 20 + 1 > 64 as too_deep from conversations")
def schema_levels(t):
    """How deep a document nests, whatever its strings hold."""
    text = F.to_json(F.struct(F.array("text").alias("t")))
    inner = F.regexp_replace(text, r'\A\{"t":|\}\z', "")
    deep = F.concat(F.repeat(F.lit('{"a":['), F.col("turn").cast("int") * 10), inner, F.repeat(F.lit("]}"), F.col("turn").cast("int") * 10))
    return t.conversations.select("conv_id", "turn", nested.levels(deep).cast("bigint").alias("levels"), nested.too_deep(deep).alias("too_deep"))


def _schemas(t):
    """(p_partkey, schema): titles, free text in unknown keywords and formats, parameters that ask about the agent."""
    k = F.col("p_partkey")
    text = lambda **f: F.struct(*[v.alias(n) for n, v in f.items()])
    properties = F.struct(
        text(type=F.lit("integer"), description=F.col("p_type"), minimum=F.col("p_size")).alias("size"),
        text(type=F.lit("string"), format=F.when(k % 2 == 0, "email").otherwise(F.col("p_name"))).alias("mail"),
        F.when(k % 5 == 0, text(type=F.lit("string"), enum=F.array("p_name"))).alias("llm_name"),
        text(type=F.lit("array"), items=text(description=F.when(k % 3 == 0, "the conversation so far").otherwise(F.col("p_name")), pattern=F.lit("^(a+)+$"))).alias("history"),
    )
    whole = F.struct(F.lit("object").alias("type"), F.col("p_name").alias("title"), F.col("p_type").alias("x-note"), properties.alias("properties"), F.array(F.lit("size"), F.lit("mail"), F.lit("llm_name")).alias("required"))
    return nested.leaves(t.part.select("p_partkey", F.to_json(whole).alias("schema")), "schema", "p_partkey")


_ENUM = "case when p_partkey % 5 = 0 then '\"llm_name\":{\"enum\":[' || to_json(p_name) || '],\"type\":\"string\"},' else '' end"


@query(f"""select p_partkey, '{{"properties":{{"history":{{"items":{{"pattern":"^(a+)+$"}},"type":"array"}},' || {_ENUM} || '"mail":{{' || case when p_partkey % 2 = 0 then '"format":"email",' else '' end || '"type":"string"}},"size":{{"minimum":' || p_size
 || ',"type":"integer"}}}},"required":["size","mail","llm_name"],"type":"object"}}' as json from part""")
def public_schemas(t):
    """Every schema as an agent may read it: validation alone."""
    return nested.rebuilt(schemas.public(_schemas(t), "p_partkey"), "p_partkey")


@query("""select p_partkey, '{"properties":{"history":{"items":{},"type":"array"},' || case when p_partkey % 5 = 0 then '"llm_name":{"type":"string"},' else '' end || '"mail":{"type":"string"},"size":{"type":"integer"}},"required":["size","mail"'
 || case when p_partkey % 5 = 0 then ',"llm_name"' else '' end || '],"type":"object"}' as json from part""")
def skeleton_schemas(t):
    """Every schema while its description is unread: types and names alone, required names of properties that stay."""
    return nested.rebuilt(schemas.skeleton(schemas.public(_schemas(t), "p_partkey"), "p_partkey"), "p_partkey")


@query("""select p_partkey, p from (select p_partkey, unnest([case when p_partkey % 5 = 0 then 'llm_name' end, case when p_partkey % 3 = 0 then 'history' end]) as p from part) where p is not null""")
def disclosure_parameters(t):
    """Parameters of every schema that ask about the agent, by name or by a description inside them."""
    return schemas.disclosure_parameters(_schemas(t), "p_partkey").select("p_partkey", F.col("parameter").alias("p"))


@query("""select p_partkey, '{"properties":{"history":{"items":{"description":' || to_json(case when p_partkey % 3 = 0 then 'the conversation so far' else p_name end) || '},"type":"array"},' || case when p_partkey % 5 = 0 then '"llm_name":{"enum":[' || to_json(p_name) || '],"type":"string"},' else '' end
 || '"mail":{"format":' || to_json(case when p_partkey % 2 = 0 then 'email' else p_name end) || ',"type":"string"},"size":{"description":' || to_json(p_type) || ',"minimum":' || p_size || ',"type":"integer"}},"required":["size","mail","llm_name"],"title":' || to_json(p_name) || ',"type":"object","x-note":' || to_json(p_type) || '}' as json from part""")
def schemas_without_patterns(t):
    """Every schema without the regular expressions its author wrote."""
    return nested.rebuilt(schemas.without_patterns(_schemas(t), "p_partkey"), "p_partkey")


@query("""select conv_id, turn, '{"args":{"list":[{"llm_name":""},{"n":' || turn || '}],"systemPrompt":"","who":"' || role || '"}}' as json, case when text = '' then '' else 'args.systemPrompt' end || case when turn % 2 = 0 then '' else case when text = '' then '' else ' ' end || 'args.list.0.llm_name' end as hidden from conversations""")
def redacted_arguments(t):
    """Arguments with what asks about the agent blanked at any depth, and where something was said."""
    args = F.struct(F.struct(F.col("role").alias("who"), F.col("text").alias("systemPrompt"), F.array(F.struct(F.when(F.col("turn") % 2 == 0, "").otherwise("a model").alias("llm_name"), F.lit(None).cast("bigint").alias("n")), F.struct(F.lit(None).cast("string").alias("llm_name"), F.col("turn").alias("n"))).alias("list")).alias("args"))
    calls = t.conversations.select("conv_id", "turn", F.to_json(args).alias("call"))
    return schemas.redacted(calls, "call", "conv_id", "turn").select("conv_id", "turn", "json", F.array_join(F.reverse("hidden"), " ").alias("hidden"))
