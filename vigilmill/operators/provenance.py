"""Where a call's values come from, as equi joins on derived tokens.

Calls, sources and users' values are tables (scope, key), with a time `at` for calls and sources; a call sees earlier sources of its
scope only.  Nesting of paths and hosts is turned into tokens that both sides derive from their own keys (the prefixes
of a path, the suffixes of a host), so that every relation is one hash join; a source's tokens are combined to
their first time before it, so a scope that names a host a million times is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilmill.functions import values as v
from vigilmill.functions.nested import held

_NONE = "array<string>"


def _tagged(tag: str, items: Column) -> Column:
    return F.transform(items, lambda x: F.concat(F.lit(f"{tag}:"), x))


def _paths(p: Column, least: int = 1) -> Column:
    """host/a, host/a/b, ... of a parsed URL, from `least` segments on."""
    n = F.size(p["segments"])
    return F.when(n >= least, F.transform(F.sequence(F.lit(least), F.greatest(n, F.lit(least))), lambda i: F.concat_ws("/", p["host"], F.array_join(F.slice(p["segments"], 1, i), "/")))).otherwise(F.array().cast(_NONE))


def _longest(p: Column) -> Column:
    """host/path of a parsed URL, null without a path."""
    return F.when(F.size(p["segments"]) > 0, F.concat_ws("/", p["host"], F.array_join(p["segments"], "/")))


def _when(condition: Column, *tokens: Column) -> Column:
    return F.when(condition, F.concat(*tokens)).otherwise(F.array().cast(_NONE))


def cut(rows: DataFrame) -> DataFrame:
    """rows with `_p`, the key's kind, host and segments, taken apart once a row and not again in each expression that uses it."""
    return rows if "_p" in rows.columns else held(rows, rows.columns, _p=v.parsed(F.col("key")))


def without_users_own(calls: DataFrame, user: DataFrame) -> DataFrame:
    """Calls' values that the user of the scope neither typed nor named a folder or site of two segments or more around (dot files in it excepted).

    calls: scope, key, ...; user: scope, key.
    """
    p, user = F.col("_p"), cut(user)
    inside = user.where((F.size(p["segments"]) >= 2) & (p["kind"] != "email")).select("scope", F.rtrim(F.col("key"), F.lit("/")).alias("around")).distinct()
    own = user.select("scope", "key").distinct()
    left = calls.join(own, ["scope", "key"], "left_anti")
    parts = F.split("key", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("around"), F.slice(parts, i + 1, F.size(parts)).alias("rest")))
    plain = F.filter(up, lambda u: (F.size(u["rest"]) > 0) & ~F.exists(u["rest"], lambda s: s.startswith(".")))
    covered = left.select("scope", "key", F.explode(plain).alias("u")).select("scope", "key", "u.around").join(inside, ["scope", "around"], "left_semi")
    return left.join(covered.select("scope", "key").distinct(), ["scope", "key"], "left_anti")


def _earlier(calls: DataFrame, call_tokens: Column, source: DataFrame, source_tokens: Column) -> DataFrame:
    """(scope, at, key, token) of calls that share a token with an earlier row of the source."""
    first = source.select("scope", "at", F.explode(source_tokens).alias("token")).groupBy("scope", "token").agg(F.min("at").alias("seen"))
    return calls.select("scope", "at", "key", F.explode(call_tokens).alias("token")).join(first, ["scope", "token"]).where("seen < at").select("scope", "at", "key", "token")


def sourced_from(calls: DataFrame, source: DataFrame, user: DataFrame) -> DataFrame:
    """Distinct (scope, at, key) of calls' values that an earlier source of the scope held and the user did not.

    A value is sourced if the source has it, or a URL around or inside it (a segment deep at least, or a URL without a
    path on its host), or names its host bare or as a mail domain, itself or a parent that one owner runs.  Hosts of shared sites
    count only with their path.
    """
    p = F.col("_p")
    url, mail, host = p["kind"] == "url", p["kind"] == "email", p["kind"] == "host"
    own_host = ~v.shared_host(p["host"]) & (p["host"] != "")
    full = F.filter(F.array(_longest(p)), lambda x: x.isNotNull())
    call_tokens = F.concat(
        F.array(F.concat(F.lit("key:"), "key")),
        _when(url & own_host, _tagged("prefix", full), _tagged("whole", _paths(p)), F.array(F.concat(F.lit("site:"), p["host"]))),
        _when((url | mail | host) & own_host, _tagged("named", v.owner_suffixes(p["host"]))),
        _when(host & own_host, F.array(F.concat(F.lit("any:"), p["host"]))),
    )
    source_tokens = F.concat(
        F.array(F.concat(F.lit("key:"), "key")),
        _when(url, _tagged("prefix", _paths(p)), _tagged("whole", full), F.array(F.concat(F.lit("any:"), p["host"]))),
        _when(url & (F.size(p["segments"]) == 0), F.array(F.concat(F.lit("site:"), p["host"]))),
        _when(mail | host, F.array(F.concat(F.lit("named:"), p["host"]))),
    )
    return _earlier(cut(without_users_own(calls, user)), call_tokens, cut(source), source_tokens).select("scope", "at", "key").distinct()


def traced_urls(calls: DataFrame, tainted: DataFrame, user: DataFrame) -> DataFrame:
    """(scope, at, key, traced): URLs built on an earlier tainted one; `path` below its path, `host` where it has none or is a bare host.

    Tainted values that the user named trace nothing, nor does a bare shared host.
    """
    p, user = F.col("_p"), cut(user)
    url = (p["kind"] == "url") & F.col("key").startswith("https://")
    bad = cut(without_users_own(tainted, user))
    sites = user.where(p["kind"].isin("url", "host")).select("scope", p["host"].alias("site")).distinct()
    whole = (p["kind"] == "host") | (url & (F.size(p["segments"]) == 0))
    spared = bad.where(whole).select("scope", "at", "key", p["host"].alias("site")).join(sites, ["scope", "site"], "left_semi").select("scope", "at", "key")
    bad = bad.join(spared, ["scope", "at", "key"], "left_anti")
    call_tokens = _when(url, _tagged("path", _paths(p)), F.array(F.concat(F.lit("host:"), p["host"])), _tagged("under", F.filter(v.owner_suffixes(p["host"]), lambda s: s != p["host"])))
    bad_tokens = F.concat(
        _when(url & (F.size(p["segments"]) > 0), _tagged("path", F.array(_longest(p)))),
        _when(url & (F.size(p["segments"]) == 0), F.array(F.concat(F.lit("host:"), p["host"])), F.array(F.concat(F.lit("under:"), p["host"]))),
        _when((p["kind"] == "host") & ~v.shared_host(p["host"]), F.array(F.concat(F.lit("host:"), p["host"])), F.array(F.concat(F.lit("under:"), p["host"]))),
    )
    hits = _earlier(cut(calls), call_tokens, bad, bad_tokens)
    return hits.groupBy("scope", "at", "key").agg(F.when(F.bool_or(F.col("token").startswith("path:")), "path").otherwise("host").alias("traced"))


def on_tainted_hosts(calls: DataFrame, tainted: DataFrame, user: DataFrame) -> DataFrame:
    """Distinct (scope, at, key): addresses on the host of an earlier tainted one, a subdomain of it or a parent of one owner; shared sites and the user's hosts never count."""
    p, calls, tainted, user = F.col("_p"), cut(calls), cut(tainted), cut(user)
    with_host = p["kind"].isin("url", "host") & (p["host"] != "") & ~v.shared_host(p["host"])
    sites = user.where(p["kind"].isin("url", "host")).select("scope", p["host"].alias("site")).distinct()
    named = lambda rows: rows.where(with_host).withColumn("site", p["host"]).join(sites, ["scope", "site"], "left_anti")
    up = F.filter(v.owner_suffixes(p["host"]), lambda s: s != p["host"])
    itself = F.array(F.concat(F.lit("same:"), p["host"]))
    call_tokens = F.concat(itself, _tagged("up", up), F.array(F.concat(F.lit("down:"), p["host"])))
    bad_tokens = F.concat(itself, F.array(F.concat(F.lit("up:"), p["host"])), _tagged("down", up))
    return _earlier(named(calls), call_tokens, named(tainted), bad_tokens).select("scope", "at", "key").distinct()


def indicator_matches(calls: DataFrame, indicators: DataFrame, allowed: DataFrame, trusted_hosts: DataFrame) -> DataFrame:
    """(call_id, key, value, kind, level): the strongest live indicator that each call's values hit.

    calls: call_id, scope, key; indicators: kind (exact, domain), value, status (observed, confirmed), live ones only; allowed: value
    (an exact value or a domain that covers what lies under it); trusted_hosts: scope, host.  Keys are derived on the
    calls' side: exact forms of a value, and the suffixes of its host, those not under a host the user named.
    """
    rows = held(calls, ["call_id", "scope", "key"], host=v.domain_of(F.col("key")))
    rows = held(rows, rows.columns, covers=F.concat(F.array("key"), F.coalesce(v.host_suffixes(F.col("host")), F.array().cast(_NONE))))
    free = _not_covered(rows, allowed)
    exact = free.select("call_id", "key", F.lit("exact").alias("kind"), F.explode(F.array_distinct(F.concat(v.exact_forms(F.col("key")), F.filter(F.array("host"), lambda h: h.isNotNull())))).alias("value"))
    names = free.where("host is not null").select("call_id", "scope", "key", F.explode(v.host_suffixes(F.col("host"))).alias("value"))
    ours = names.join(trusted_hosts.select("scope", F.col("host").alias("value")).distinct(), ["scope", "value"], "left_semi").select("call_id", "key").distinct()
    domains = names.join(ours, ["call_id", "key"], "left_anti").select("call_id", "key", F.lit("domain").alias("kind"), "value")
    found = exact.unionByName(domains).join(indicators, ["kind", "value"])
    level = F.when(F.col("status") == "confirmed", "block").otherwise("review")
    rank = F.struct((level == "block").alias("block"), (F.col("kind") == "exact").alias("exact"), F.col("value").alias("value"), F.col("key").alias("key"))
    best = found.groupBy("call_id").agg(F.max(rank).alias("m"))
    return best.select("call_id", "m.key", "m.value", F.when(F.col("m.exact"), "exact").otherwise("domain").alias("kind"), F.when(F.col("m.block"), "block").otherwise("review").alias("level"))


def _not_covered(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    covered = rows.select("call_id", "key", F.explode("covers").alias("value")).join(allowed.select("value").distinct(), "value", "left_semi").select("call_id", "key").distinct()
    return rows.join(covered, ["call_id", "key"], "left_anti")
