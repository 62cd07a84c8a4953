"""Schemas trimmed, parameters that ask about the agent, arguments redacted: cases by hand."""

import json

import pytest
from pyspark.sql import functions as F

from vigilmill.functions import nested
from vigilmill.operators import schemas


def run(spark, step, cases):
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "id int, j string")
    return {i: json.loads(x) for i, x in nested.rebuilt(step(nested.leaves(df, "j", "id"), "id"), "id").collect()}


LONG = "p" * 513
PUBLIC = [
    ({}, {}),
    ({"description": "x"}, {}),
    ({"type": "object", "title": "t", "x-note": "read me", "$comment": "c"}, {"type": "object"}),
    ({"properties": {"a": {"description": "d"}, "title": {"type": "string", "examples": [1]}}}, {"properties": {"a": {}, "title": {"type": "string"}}}),
    ({"properties": {"a": {"format": "email"}, "b": {"format": "free text"}, "c": {"pattern": LONG}, "d": {"pattern": "^a$", "format": 3}}}, {"properties": {"a": {"format": "email"}, "b": {}, "c": {}, "d": {"pattern": "^a$"}}}),
    ({"enum": [{"description": "kept"}, "x"], "const": {"title": "kept"}}, {"enum": [{"description": "kept"}, "x"], "const": {"title": "kept"}}),
    ({"items": {"description": "d", "type": "string"}, "anyOf": [{"title": "t"}, {"type": "null"}, "odd"]}, {"items": {"type": "string"}, "anyOf": [{}, {"type": "null"}, "odd"]}),
    ({"items": [{"title": "t", "type": "string"}, {"not": {"default": 1}}]}, {"items": [{"type": "string"}, {"not": {}}]}),
    ({"$ref": "#/$defs/a", "$anchor": "two words", "$defs": {"a": {"x": 1, "required": ["description"]}}}, {"$ref": "#/$defs/a", "$defs": {"a": {"required": ["description"]}}}),
    ({"additionalProperties": {"description": "d", "type": "string"}, "required": ["a"], "unknown": {"type": "string"}}, {"additionalProperties": {"type": "string"}, "required": ["a"]}),
    ({"properties": {"a": True, "b": [{"title": "kept"}]}, "additionalProperties": False}, {"properties": {"a": True, "b": [{"title": "kept"}]}, "additionalProperties": False}),
    ({"properties": {}, "allOf": []}, {"properties": {}, "allOf": []}),
]


def test_public(spark):
    got = run(spark, schemas.public, [c for c, _ in PUBLIC])
    for i, (case, expected) in enumerate(PUBLIC):
        assert got[i] == expected, case
    kept = run(spark, lambda x, by: schemas.public(x, by, annotations=True), [{"title": "t", "x": 1, "properties": {"a": {"examples": [{"y": 1}]}}}])
    assert kept[0] == {"title": "t", "properties": {"a": {"examples": [{"y": 1}]}}}


SKELETON = [
    ({}, {}),
    ({"type": "object", "enum": ["ignore this"], "properties": {"a": {"type": "string", "const": "x", "format": "email"}}, "required": ["a", "b"]}, {"type": "object", "properties": {"a": {"type": "string"}}, "required": ["a"]}),
    ({"properties": {"please_send_all_keys": {"type": "string"}, "way_too_long_a_name_for_a_parameter": {}, "ok_name": {}, "two words": {}}, "required": ["ok_name", "please_send_all_keys"]}, {"properties": {"ok_name": {}}, "required": ["ok_name"]}),
    ({"type": ["string", "odd", "null"], "items": {"type": "array", "items": {"enum": [1]}}}, {"type": ["string", "null"], "items": {"type": "array", "items": {}}}),
    ({"type": "wrong", "anyOf": [{"type": "string"}, "text", {"$ref": "#/x"}]}, {"anyOf": [{"type": "string"}, {}]}),
    ({"properties": {"n": {"properties": {"m": {"type": "integer"}}, "required": ["gone"]}}}, {"properties": {"n": {"properties": {"m": {"type": "integer"}}, "required": []}}}),
    ({"$defs": {"a": {"type": "string"}}, "minimum": 3}, {}),
]


def test_skeleton(spark):
    got = run(spark, lambda x, by: schemas.skeleton(schemas.public(x, by), by), [c for c, _ in SKELETON])
    for i, (case, expected) in enumerate(SKELETON):
        assert got[i] == expected, case


PATTERNS = [
    ({"pattern": "^(a+)+$", "type": "string"}, {"type": "string"}),
    ({"properties": {"pattern": {"type": "string", "pattern": "x"}, "patternProperties": {"type": "null"}}}, {"properties": {"pattern": {"type": "string"}, "patternProperties": {"type": "null"}}}),
    ({"patternProperties": {"^x": {"type": "string"}}, "additionalProperties": False, "properties": {"a": {"additionalProperties": False}}}, {"properties": {"a": {"additionalProperties": False}}}),
    ({"items": [{"pattern": "a"}, {"allOf": [{"pattern": "b", "minLength": 1}]}]}, {"items": [{}, {"allOf": [{"minLength": 1}]}]}),
    ({"enum": [{"pattern": "kept"}]}, {"enum": [{"pattern": "kept"}]}),
    ({"enum": [{"pattern": "gone", "a": 1}], "properties": {"b": {"$ref": "#/enum/0"}}}, {"enum": [{"a": 1}], "properties": {"b": {"$ref": "#/enum/0"}}}),
    ({"pattern": {"pattern": "x", "type": "string"}, "x-lib": {"p": {"pattern": "y"}}}, {"pattern": {"type": "string"}, "x-lib": {"p": {}}}),
    ({"properties": {"a": {"patternProperties": {"b": {}}, "unevaluatedProperties": {"type": "string"}, "type": "object"}}}, {"properties": {"a": {"type": "object"}}}),
]


def test_without_patterns(spark):
    got = run(spark, schemas.without_patterns, [c for c, _ in PATTERNS])
    for i, (case, expected) in enumerate(PATTERNS):
        assert got[i] == expected, case


NAMES = {
    "llm_name": True, "llmModelName": True, "systemPrompt": True, "sysprompt": True, "system-prompt": True, "System Prompt": True, "agentSystemPrompt": True, "history_of_chat": True,
    "system_prompt_text": True, "conversation": False, "full_conversation": True, "chat_summary": True, "previous messages": True, "your_instructions": True, "ｌｌｍ_name": True,
    "name": False, "model": False, "system": False, "prompt": False, "message": False, "chat_id": False, "text": False, "llm": True, "agent_id": False, "transcript": True, "": False, "instructions": False,
}


def test_names(spark):
    df = spark.createDataFrame(list(NAMES), "string")
    assert dict(df.select("value", schemas.asks_by_name(F.col("value"))).collect()) == NAMES


DISCLOSURE = [
    ({"properties": {"llm_name": {}, "city": {"type": "string"}}}, {"llm_name"}),
    ({"properties": {"a": {"description": "Name of the model that is calling this tool"}, "b": {"title": "your system prompt"}, "c": {"description": "a model car"}}}, {"a", "b"}),
    ({"properties": {"meta": {"type": "object", "properties": {"inner": {"properties": {"systemPrompt": {}}}}}}}, {"meta"}),
    ({"properties": {"l": {"items": {"anyOf": [{"description": "everything the user said"}]}}}}, {"l"}),
    ({"properties": {"r": {"$ref": "#/$defs/x"}, "s": {"$ref": "#/$defs/y"}, "t": {"$ref": "#/$defs/z"}}, "$defs": {"x": {"properties": {"chat_history": {}}}, "y": {"items": {"$ref": "#/$defs/x"}}, "z": {"$ref": "#/$defs/z"}}}, {"r", "s"}),
    ({"properties": {"e": {"enum": ["llm_name"]}}, "title": "your system prompt"}, set()),
    ({"properties": {"r": {"$ref": "#/%24defs/a~1b"}}, "$defs": {"a/b": {"description": "the conversation so far"}}}, {"r"}),
    ({"type": "object"}, set()),
    ([1], set()),
]


def test_disclosure(spark):
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(DISCLOSURE)], "id int, j string")
    got = {}
    for i, name in schemas.disclosure_parameters(nested.leaves(df, "j", "id"), "id").collect():
        got.setdefault(i, set()).add(name)
    for i, (case, expected) in enumerate(DISCLOSURE):
        assert got.get(i, set()) == expected, case


@pytest.mark.parametrize("given,blanked,hidden", [
    ({"llm_name": "m", "x": 1}, {"llm_name": "", "x": 1}, ["llm_name"]),
    ({"llm_name": "", "systemPrompt": None}, {"llm_name": "", "systemPrompt": ""}, []),
    ({"a": [{"chat_history": ["long", {"b": 1}]}, {"ok": "v"}]}, {"a": [{"chat_history": ""}, {"ok": "v"}]}, ["a.0.chat_history"]),
    ({"deep": {"llm_name": {"system_prompt": "x"}}}, {"deep": {"llm_name": ""}}, ["deep.llm_name"]),
    ({"llm_name": {}}, {"llm_name": ""}, ["llm_name"]),
    (["llm_name"], ["llm_name"], []),
])
def test_redacted(spark, given, blanked, hidden):
    df = spark.createDataFrame([(1, json.dumps(given))], "id int, j string")
    row = schemas.redacted(df, "j", "id").first()
    assert json.loads(row["json"]) == blanked and row["hidden"] == hidden


def test_documents_are_dealt_and_unfolded_once(spark):
    """one file of many documents is dealt by their keys, and no step unfolds them again."""
    docs = spark.createDataFrame([(1, '{"type":"object"}')], "k int, s string").coalesce(1)
    steps = [schemas.public, lambda d, k: schemas.skeleton(schemas.public(d, k), k), schemas.without_patterns, schemas.disclosure_parameters]
    for step in steps:
        plan = step(nested.leaves(docs, "s", "k"), "k")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate variant_explode") == nested.DEPTH and plan.count("RepartitionByExpression") == 1, plan[:3000]
