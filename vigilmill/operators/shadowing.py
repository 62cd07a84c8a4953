"""Tools that speak of other servers' tools, and calls that carry what other tools' descriptions say: joins on an inverted index.

A description becomes its distinct identifiers or values, each once; what it meets is a table of names or values, so a word that every
description has costs one row a description and is gone where no tool bears it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilmill.functions import values as v
from vigilmill.functions.nested import held

IDENTIFIER = r"[a-z0-9_]+(?:[-.][a-z0-9_]+)*"
LEAST_NAME = 6


def identifiers(text: Column) -> Column:
    """The whole identifiers of a text, each once, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(IDENTIFIER), F.lit(0)))


def distinctive(name: Column) -> Column:
    """Whether a tool's name in prose can only be the tool: long, and of several parts."""
    return (F.length(name) >= LEAST_NAME) & name.rlike(r"[_\-.]|[a-z][A-Z]")


def shadowing(tools: DataFrame) -> DataFrame:
    """Distinct (server, tool, other_server, other_tool): tools (server, tool, description) that name a distinctive tool of another server."""
    names = tools.where(distinctive(F.col("tool"))).select(F.col("server").alias("other_server"), F.col("tool").alias("other_tool"), F.lower("tool").alias("word")).distinct()
    said = tools.select("server", "tool", F.explode(identifiers(F.coalesce("description", F.lit("")))).alias("word"))
    return said.join(names, "word").where("server <> other_server").select("server", "tool", "other_server", "other_tool").distinct()


def described_elsewhere(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Distinct (call_id, key, server, tool): values (key) of calls (call_id, server, tool, key) that the description of another tool holds."""
    found = held(tools.where("description is not null"), ["server", "tool"], _v=v.values(F.col("description")))
    said = found.select(F.col("server").alias("by_server"), F.col("tool").alias("by_tool"), F.explode(v.keys_of(F.col("_v"))).alias("key")).distinct()
    met = calls.select("call_id", "server", "tool", "key").join(said, "key").where(~((F.col("server") == F.col("by_server")) & (F.col("tool") == F.col("by_tool"))))
    return met.select("call_id", "key", F.col("by_server").alias("server"), F.col("by_tool").alias("tool")).distinct()


def tainted_intent(intents: DataFrame, flagged: DataFrame) -> DataFrame:
    """Distinct (scope, key): values of a session's request (scope, at, text) that an earlier flagged or observed text of the session (scope, at, key) held."""
    asked = held(intents.where("text is not null"), ["scope", "at"], _v=v.values(F.col("text"))).select("scope", "at", F.explode(v.keys_of(F.col("_v"))).alias("key"))
    first = flagged.groupBy("scope", "key").agg(F.min("at").alias("seen"))
    return asked.join(first, ["scope", "key"]).where("seen < at").select("scope", "key").distinct()
