"""Tool schemas as tables of leaves: what of them an agent may read, which parameters ask about the agent, and redacted arguments.

A schema is unfolded once (`nested.leaves`); every leaf's path is read as JSON Schema by one fold over its steps, which says whether the
leaf stands under validation keywords alone, under the name of a property, or in data.  A document is trimmed by dropping leaves or
cutting them to the last step that stays, and written again from what is left, so nothing walks a document outside Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilmill.functions import nested
from vigilmill.functions.normalize import LOOKALIKES

# Keywords of JSON Schema that carry validation, those that annotate, and forms of their values.
KEYWORDS = (
    "type", "enum", "const", "properties", "patternProperties", "additionalProperties", "required", "items", "prefixItems", "additionalItems", "contains", "minContains", "maxContains",
    "minItems", "maxItems", "uniqueItems", "minLength", "maxLength", "pattern", "format", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minProperties",
    "maxProperties", "dependentRequired", "dependentSchemas", "dependencies", "propertyNames", "allOf", "anyOf", "oneOf", "not", "if", "then", "else", "$ref", "$defs", "definitions",
    "$anchor", "$dynamicRef", "$dynamicAnchor", "unevaluatedItems", "unevaluatedProperties", "contentEncoding", "contentMediaType", "contentSchema", "nullable",
)
ANNOTATIONS = ("title", "description", "examples", "default", "deprecated", "readOnly", "writeOnly")
MAPS = ("properties", "patternProperties", "$defs", "definitions", "dependentSchemas")
LISTS = ("allOf", "anyOf", "oneOf", "prefixItems", "items")
DATA = ("enum", "const")
TOKENS = ("$ref", "$anchor", "$dynamicRef", "$dynamicAnchor", "contentEncoding", "contentMediaType")
FORMATS = (
    "date-time", "date", "time", "duration", "email", "idn-email", "hostname", "idn-hostname", "ipv4", "ipv6", "uri", "uri-reference", "iri", "iri-reference", "uri-template", "uuid",
    "json-pointer", "relative-json-pointer", "regex", "int32", "int64", "float", "double", "byte", "binary", "password",
)
TYPES = ("object", "array", "string", "number", "integer", "boolean", "null")
TOKEN = r"\A[\w$#./:~%+;=@!*,-]{1,200}\z"
PARAMETER_NAME = r"\A[A-Za-z_][A-Za-z0-9_.-]{0,23}\z"
MOST_PATTERN, MOST_SEPARATORS = 512, 2
# Names and descriptions of parameters that ask an agent for its model, prompt or conversation.
SELF_NAME = (
    r"(?i)\A(?:(?:llm|lm)_?(?:model_?)?(?:name|id|version|type|provider)?|(?:ai|agent|assistant|caller)_?model(?:_?(?:name|id|version))?|"
    r"system_?(?:prompt|message|instructions?)|full_?conversation|conversation_?(?:history|context)|chat_?(?:history|log)|"
    r"previous_?messages|prior_?messages|transcript|initial_?prompt|agent_?instructions|calling_?model)\z"
)
SELF_TEXT = (
    r"(?i)\b(?:llm|model|ai|assistant|agent)\b[^.\n]{0,40}?\b(?:that|which|who)\s+(?:is\s+)?(?:calls?|calling|invok\w+|uses?|using)\s+this\s+tool\b|"
    r"\byour\s+(?:own\s+)?(?:model(?:\s+name)?|system\s+prompt|instructions|conversation(?:\s+history)?|chat\s+history|previous\s+messages)\b|"
    r"\b(?:system\s+prompt|instructions)\s+(?:you\s+(?:were|are|have\s+been)\s+(?:given|using|following)|given\s+to\s+you)\b|\b(?:conversation|chat|discussion)\s+so\s+far\b|"
    r"\beverything\s+the\s+user\s+(?:has\s+)?(?:said|written|told\s+you)\b|\b(?:what|which)\s+(?:model|llm)\s+(?:are\s+you|is\s+this)\b|"
    r"\b(?:the\s+)?(?:assistant|agent|ai)(?:'s|’s)\s+(?:own\s+)?(?:system\s+prompt|instructions)\b|\b(?:history|log|transcript)\s+of\s+(?:the|this|our|your)\s+(?:chat|conversation)\b"
)
PROMPT_OWNERS, PROMPT_KINDS = ("system", "sys", "developer"), ("prompt", "prompts", "instruction", "instructions", "message", "messages", "msg")
CHAT, CHAT_KINDS = ("conversation", "chat", "dialogue", "dialog"), ("history", "log", "logs", "transcript", "context", "summary")
CHAT_ELDERS, NAME_FILLERS = ("previous", "prior", "earlier", "full", "entire", "whole", "complete"), ("text", "content", "body", "string", "str", "value")

LEAF = ("path", "kind", "text", "json")
# What a step of a path stands in.
SCHEMA, NAMES, LISTED, OTHER, FREE, VALUE, OUT = "schema", "names", "listed", "other", "data", "value", "out"


def _read(path: Column, annotations: bool) -> Column:
    """A struct (state, word, good): the state at the path's end, the keyword of a `value`, and how many steps are allowed."""
    zero = F.struct(F.lit(SCHEMA).alias("state"), F.lit(None).cast("string").alias("word"), F.lit(0).alias("good"))

    def step(s: Column, x: Column) -> Column:
        state, key = s["state"], x["key"]
        keyword = (
            F.when(key.isin(*ANNOTATIONS), F.lit(FREE if annotations else OUT)).when(~key.isin(*KEYWORDS), OUT).when(key.isin(*MAPS), NAMES).when(key.isin(*LISTS), LISTED)
            .when(key.isin(*DATA), FREE).when(key.isin("format", "pattern", *TOKENS), VALUE).otherwise(OTHER)
        )
        after = (
            F.when(state.isin(OUT, VALUE), OUT).when(state == FREE, FREE).when((state == NAMES) & key.isNotNull(), SCHEMA).when(state == NAMES, FREE)
            .when(key.isNotNull(), keyword).when(state == LISTED, SCHEMA).otherwise(FREE)
        )
        return F.struct(after.alias("state"), F.when(after == VALUE, key).otherwise(s["word"]).alias("word"), (s["good"] + (after != OUT).cast("int")).alias("good"))

    return F.aggregate(path, zero, step)


def public(leaves: DataFrame, *by: str, annotations: bool = False) -> DataFrame:
    """Leaves under validation keywords; a schema of which nothing stays becomes an empty object.  `annotations` keeps titles, descriptions and the like.

    format, pattern and reference keywords stay only with a value of their own kind.
    """
    read = nested.held(leaves, [*by, *LEAF], _r=_read(F.col("path"), annotations))
    word, said = F.col("_r.word"), (F.col("kind") == "string")
    fits = F.when(word == "format", said & F.col("text").isin(*FORMATS)).when(word == "pattern", said & (F.length("text") <= MOST_PATTERN)).otherwise(said & F.col("text").rlike(TOKEN))
    good = (F.col("_r.state") != OUT) & ((F.col("_r.state") != VALUE) | F.coalesce(fits, F.lit(False)))
    upto = F.when(F.col("_r.state") == VALUE, F.size("path") - 1).otherwise(F.col("_r.good"))
    return _cut(read, good, upto, *by)


def _cut(leaves: DataFrame, good: Column, upto: Column, *by: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Good leaves as they are, others as an empty container at the first `upto` steps of their path."""
    judged = nested.held(leaves, [*by, *keep, *LEAF], _good=good, _upto=upto)
    object_ = F.get("path", F.col("_upto"))["key"].isNotNull()
    put = lambda c, other: F.when(F.col("_good"), F.col(c)).otherwise(other)
    container = F.when(object_, "{}").otherwise("[]")
    return nested.held(
        judged, [*by, *keep], path=put("path", F.slice("path", F.lit(1), F.col("_upto"))), kind=put("kind", F.when(object_, "object").otherwise("array")), text=put("text", container), json=put("json", container)
    )


def skeleton(leaves: DataFrame, *by: str) -> DataFrame:
    """Types and parameter names alone, of the leaves of public schemas: no enum, constant, format or reference, no name that could be a sentence.

    Required names stay where the property does.
    """
    zero = F.struct(F.lit(SCHEMA).alias("state"), F.lit(0).alias("good"))
    fine = lambda name: name.rlike(PARAMETER_NAME) & (F.length(F.regexp_replace(name, "[^_.-]", "")) <= MOST_SEPARATORS)

    def step(s: Column, x: Column) -> Column:
        state, key = s["state"], x["key"]
        keyword = F.when(key == "properties", NAMES).when(key.isin("anyOf", "oneOf", "allOf"), LISTED).when(key == "items", "one").when(key.isin("type", "required"), key).otherwise(OUT)
        after = (
            F.when((state == NAMES) & fine(key), SCHEMA).when((state == LISTED) & key.isNull(), SCHEMA).when(state.isin("type", "required") & key.isNull(), F.concat(state, F.lit("s")))
            .when((state == SCHEMA) & key.isNotNull() | (state == "one") & key.isNotNull(), keyword).otherwise(OUT)
        )
        return F.struct(after.alias("state"), (s["good"] + (after != OUT).cast("int")).alias("good"))

    read = nested.held(leaves, [*by, *LEAF], _r=F.aggregate("path", zero, step))
    state, said = F.col("_r.state"), F.col("kind") == "string"
    known = said & F.col("text").isin(*TYPES)
    # Empty containers stay where a container may stand; children of lists that are no schemas go.
    good = (
        F.when(state.isin("type", "types"), known).when(state == "requireds", said).when(state == "required", F.col("kind") == "array")
        .when(state.isin(NAMES, SCHEMA, "one"), F.col("kind") == "object").when(state == LISTED, F.col("kind") == "array").otherwise(F.lit(False))
    )
    # A property that is no object counts as one without content; any other bad leaf takes its keyword with it.
    named = (state == SCHEMA) & F.coalesce(F.get("path", F.size("path") - 2)["key"] == "properties", F.lit(False))
    upto = F.when(state == OUT, F.col("_r.good")).when(named, F.size("path")).otherwise(F.size("path") - 1)
    before = F.coalesce(F.get("path", F.col("_r.good") - 1)["key"], F.lit(""))
    takes = (before == "type") | ((before == "items") & F.get("path", F.col("_r.good"))["key"].isNull())
    upto = F.when((state == OUT) & takes, F.greatest(F.lit(0), F.col("_r.good") - 1)).otherwise(upto)
    trimmed = _cut(read, F.coalesce(good, F.lit(False)), upto, *by)
    trimmed = trimmed.withColumn("json", F.when(F.size("path") == 0, "{}").otherwise(F.col("json")))
    # Required names without their property go; the list stays when all of its names do.  Each leaf is put beside the names of properties that its path
    # has, so one sort of a document's rows tells which names are there.
    asks = (F.size("path") > 1) & F.coalesce(F.get("path", F.size("path") - 2)["key"] == "required", F.lit(False)) & (F.col("kind") == "string")
    marked = nested.held(trimmed, [*by, *LEAF], _asks=asks)
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size("path"), F.lit(1))), lambda i: F.coalesce(F.get("path", i - 1)["key"] == "properties", F.lit(False)) & F.get("path", i)["key"].isNotNull())
    of = "array<struct<key:string,pos:int>>"
    row = lambda part, leaf, of_, name: F.struct(F.lit(part).alias("_part"), leaf.alias("_leaf"), of_.cast(of).alias("_of"), name.cast("string").alias("_name"))
    leaf, none = F.struct(*LEAF), F.lit(None)
    empty = F.struct(F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), F.lit("array").alias("kind"), F.lit("[]").alias("text"), F.lit("[]").alias("json"))
    mine = F.when(F.col("_asks"), F.array(row("asks", leaf, F.slice("path", F.lit(1), F.size("path") - 2), F.col("text")), row("leaf", empty, none, none))).otherwise(F.array(row("leaf", leaf, none, none)))
    names = F.transform(at, lambda i: row("name", F.when(F.lit(False), leaf), F.slice("path", F.lit(1), i - 1), F.get("path", i)["key"]))
    rows = marked.select(*by, F.inline(F.concat(mine, names)))
    there = rows.withColumn("_there", F.bool_or(F.col("_part") == "name").over(Window.partitionBy(*by, "_of", "_name")))
    return there.where("_part = 'leaf' or _part = 'asks' and _there").select(*by, "_leaf.*")


def without_patterns(leaves: DataFrame, *by: str) -> DataFrame:
    """Leaves without the regular expressions of a schema, at any depth: `pattern` strings and `patternProperties`, and with the latter what it decides.

    Names of properties are no keywords.  Values of enum and const are left alone, unless the document has a reference, which could lead into
    them, and one of them has such a key.
    """
    maps = (*MAPS, "dependencies")
    zero = F.struct(F.lit(False).alias("names"), F.lit(False).alias("data"), F.lit(-1).alias("bad"), F.lit(0).alias("n"), F.lit(False).alias("inner"))

    def step(s: Column, x: Column) -> Column:
        word = F.when(~s["names"], x["key"])
        hit = F.coalesce(word == "patternProperties", F.lit(False)) | (F.coalesce(word == "pattern", F.lit(False)) & (s["n"] == F.size("path") - 1) & (F.col("kind") == "string"))
        return F.struct(
            F.coalesce(word.isin(*maps), F.lit(False)).alias("names"), (s["data"] | F.coalesce(word.isin(*DATA), F.lit(False))).alias("data"),
            F.when((s["bad"] < 0) & hit, s["n"]).otherwise(s["bad"]).alias("bad"), (s["n"] + 1).alias("n"), (s["inner"] | (s["data"] & hit)).alias("inner"),
        )

    read = nested.held(leaves, [*by, *LEAF], _r=F.aggregate("path", zero, step))
    refers = F.exists("path", lambda x: F.coalesce(x["key"].isin("$ref", "$dynamicRef"), F.lit(False)))
    whole = Window.partitionBy(*by)
    read = read.withColumn("_strip", F.bool_or(refers).over(whole) & F.bool_or("_r.inner").over(whole))
    bad = (F.col("_r.bad") >= 0) & (~F.col("_r.data") | F.col("_strip"))
    # The schema whose patternProperties go loses what depends on them: each leaf is put beside the schemas that hold such keywords of its own path, and
    # those that lose theirs say so in rows of the same kind.
    lost = F.when(bad & (F.get("path", F.col("_r.bad"))["key"] == "patternProperties"), F.slice("path", F.lit(1), F.col("_r.bad")))
    read = nested.held(read, [*by, *LEAF], _bad=bad, _at=F.when(bad, F.col("_r.bad")).otherwise(F.size("path")), _lost=lost)
    cut = _cut(read, ~F.col("_bad"), F.col("_at"), *by, keep=("_lost",))
    steps = F.filter(F.sequence(F.lit(0), F.greatest(F.size("path") - 1, F.lit(0))), lambda i: F.coalesce(F.get("path", i)["key"].isin("additionalProperties", "unevaluatedProperties"), F.lit(False)))
    row = lambda part, leaf, of: F.struct(F.lit(part).alias("_part"), leaf.alias("_leaf"), of.alias("_of"))
    leaf, path = F.struct(*LEAF), F.struct("path", *[F.lit(None).cast("string").alias(c) for c in LEAF[1:]])
    depends = F.transform(steps, lambda i: row("depends", path, F.slice("path", F.lit(1), i)))
    losers = F.when(F.col("_lost").isNotNull(), F.array(row("lost", path, F.col("_lost")))).otherwise(F.slice(depends, 1, 0))
    rows = cut.select(*by, F.inline(F.concat(F.array(row("leaf", leaf, F.when(F.lit(False), F.col("path")))), depends, losers)))
    rows = rows.withColumn("_gone", F.bool_or(F.col("_part") == "lost").over(Window.partitionBy(*by, "_of"))).where("_part <> 'lost'")
    least = F.min(F.when((F.col("_part") == "depends") & F.col("_gone"), F.size("_of"))).over(Window.partitionBy(*by, "_leaf.path"))
    joined = rows.withColumn("_least", least).where("_part = 'leaf'").select(*by, "_leaf.*", "_least")
    return _cut(joined, F.col("_least").isNull(), F.coalesce("_least", F.size("path")), *by)


def asks_by_name(name: Column) -> Column:
    """Whether a parameter's name asks an agent about itself: its model, prompt or conversation, in any spelling of the words."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    plain = F.regexp_replace(F.translate(name, wide + "".join(LOOKALIKES), "".join(map(chr, range(0x21, 0x7F))) + "".join(LOOKALIKES.values())), "[\u00ad\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff]", "")
    snake = F.regexp_replace(F.trim(F.regexp_replace(plain, "([a-z])([A-Z])", "$1_$2")), r"[\s.\-]+", "_")
    snake = F.regexp_replace(snake, r"(?i)(?<![a-z])(sys|system)(prompt|msg|message)(?![a-z])", "$1_$2")
    words = F.filter(F.split(F.lower(snake), "_"), lambda w: w != "")
    # Fillers at the end ask nothing, but one word stays.
    asked = F.regexp_replace(F.array_join(words, "_"), rf"(?:_(?:{'|'.join(NAME_FILLERS)}))+\z", "")
    parts = F.split(asked, "_")
    last = F.element_at(parts, -1)
    has = lambda *ws: F.arrays_overlap(parts, F.array(*map(F.lit, ws)))
    by_words = (
        has(*PROMPT_OWNERS) & last.isin(*PROMPT_KINDS) | has("agent") & last.isin("prompt", "instruction", "instructions")
        | has(*CHAT) & last.isin(*CHAT, *CHAT_KINDS) & has(*CHAT_KINDS, *CHAT_ELDERS) | has("previous", "prior", "earlier") & last.isin("messages", "conversation")
        | has("your") & last.isin("instructions", "prompt") & (F.size(parts) == 2)
    )
    return F.coalesce(snake.rlike(SELF_NAME) | by_words, F.lit(False))


def disclosure_parameters(leaves: DataFrame, *by: str, hops: int = 4) -> DataFrame:
    """(*by, parameter): top-level parameters that ask an agent about itself by name or description, or hold such a parameter at any depth.

    Local references are followed, `hops` of them one after the other; a circle ends there.
    """
    head = F.get("path", F.lit(0))["key"]
    top = F.when((head == "properties") & (F.size("path") > 1), F.get("path", F.lit(1))["key"])
    # Where a name of a property stands: behind a `properties` that is a keyword itself.
    zero = F.struct(F.lit(False).alias("names"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        found = F.when(s["names"] & x["key"].isNotNull(), F.concat(s["found"], F.array(x["key"]))).otherwise(s["found"])
        return F.struct((~s["names"] & F.coalesce(x["key"] == "properties", F.lit(False))).alias("names"), found.alias("found"))

    named = F.exists(F.aggregate("path", zero, step, lambda s: s["found"]), asks_by_name)
    last = F.try_element_at("path", F.lit(-1))["key"]
    told = F.coalesce(last.isin("title", "description"), F.lit(False)) & (F.col("kind") == "string") & F.col("text").rlike(SELF_TEXT)
    asks = nested.held(leaves, [*by, *LEAF], _asks=named | told, _top=top, _ref=(last == "$ref") & (F.col("kind") == "string") & F.col("text").startswith("#/"))
    # Places that ask, by every prefix of their path, for references that lead there.
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size("path"), F.lit(1))), lambda i: F.array_join(F.transform(F.slice("path", F.lit(1), i), lambda s: F.coalesce(F.replace(s["key"], F.lit("/"), F.lit("\x03")), s["pos"].cast("string"))), "/"))
    place = lambda c: F.replace(F.replace(F.url_decode(F.regexp_replace(F.substring(c, 3, 1 << 20), r"\+", "%2B")), F.lit("~1"), F.lit("\x03")), F.lit("~0"), F.lit("~"))
    # A document's leaves that ask or refer are taken together once, and references are followed within them.
    some = asks.where("_asks or _ref").select(*by, "_asks", "_top", prefixes.alias("_inside"), F.when(F.col("_ref"), place(F.col("text"))).alias("_to"))
    whole = some.groupBy(*by).agg(
        F.collect_set(F.when(F.col("_asks"), F.col("_top"))).alias("_found"), F.collect_list(F.when(F.col("_asks"), F.col("_inside"))).alias("_hot"),
        F.collect_list(F.when(F.col("_to").isNotNull(), F.struct("_top", "_inside", "_to"))).alias("_refs"),
    )
    whole = whole.withColumn("_hot", F.when(F.size("_refs") > 0, F.array_distinct(F.flatten("_hot"))).otherwise(F.array().cast("array<string>")))
    for _ in range(hops):
        led = nested.held(whole, [*by, "_found", "_refs"], _led=F.array_intersect(F.transform("_refs", lambda r: r["_to"]), F.col("_hot")))
        reached = nested.held(led, [*by, "_found", "_refs"], _reached=F.filter("_refs", lambda r: F.array_contains("_led", r["_to"])))
        tops = F.array_compact(F.transform("_reached", lambda r: r["_top"]))
        whole = nested.held(reached, [*by, "_refs"], _found=F.array_union("_found", tops), _hot=F.array_distinct(F.flatten(F.transform("_reached", lambda r: r["_inside"]))))
    return whole.select(*by, F.explode("_found").alias("parameter"))


def redacted(docs: DataFrame, json: str, *by: str, depth: int = nested.DEPTH) -> DataFrame:
    """(*by, json, hidden): arguments with parameters that ask about the agent blanked at any depth, and the sorted paths of those that said something."""
    found = nested.leaves(docs, json, *by, depth=depth)
    at = F.array_position(F.transform("path", lambda s: F.coalesce(s["key"].isNotNull() & asks_by_name(s["key"]), F.lit(False))), True).cast("int")
    found = nested.held(found, [*by, *LEAF], _at=at)
    blank = found.select(
        *by, F.when(F.col("_at") > 0, F.slice("path", F.lit(1), F.col("_at"))).otherwise(F.col("path")).alias("path"), F.when(F.col("_at") > 0, '""').otherwise(F.col("json")).alias("json"),
    )
    empty = (F.size("path") == F.col("_at")) & F.col("json").isin('""', "null")
    said = F.when((F.col("_at") > 0) & ~empty, nested.path_text(F.slice("path", F.lit(1), F.col("_at"))))
    hidden = found.groupBy(*by).agg(F.array_sort(F.collect_set(said)).alias("hidden"))
    return nested.rebuilt(blank, *by).join(hidden, list(by))
