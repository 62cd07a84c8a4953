"""Values, their keys and their provenance on hand-written cases."""

from pyspark.sql import functions as F

from vigilmill.functions import values as v
from vigilmill.operators import provenance as pv

CASES = [
    ("Write to Bob.Smith+news@Mail.Example.com, please.", {("email", "bob.smith@mail.example.com")}),
    ("see HTTP://User:pw@Evil.Example:8080/a/../b%20c/?q=1#top now", {("url", "https://evil.example/b c?q=1")}),
    ("hxxps://evil[.]example/x and audit (at) canary [dot] example", {("url", "https://evil.example/x"), ("email", "audit@canary.example")}),
    ("pay DE89 3704 0044 0532 0130 00 today", {("iban", "de89370400440532013000")}),
    ("pay de89370400440532013000", {("iban", "de89370400440532013000")}),
    ("on 2026-10-01 we met, again 01/02/2026, id 20261001", set()),
    ("call 4111 1111 1111 1111 or 123456789", {("number", "4111111111111111"), ("number", "123456789")}),
    ("just 12345 apples and 3.14", set()),
    ("/Users/ann/proj/secrets/keys.json and $HOME/.ssh/id_rsa", {("path", "~/proj/secrets/keys.json"), ("path", "~/.ssh/id_rsa")}),
    ("C:\\Users\\Ann\\notes.txt", {("path", "~/notes.txt")}),
    ("open ../x/./y/z.txt", {("path", "../x/y/z.txt")}),
    ("visit evil-host.example.com. Not report.txt or build.sh", {("host", "evil-host.example.com")}),
    ("server 203.0.113.7:443", {("host", "203.0.113.7")}),
    ("http://0xcb007107/x", {("url", "https://203.0.113.7/x")}),
    ("order ABC-12345 shipped", {("id", "abc-12345")}),
    ("read/write/execute", set()),
    ("go to http://[2001:0db8:0:0::1]:8080/x?y=1, now", {("url", "https://[2001:db8::1]/x?y=1")}),
    ("at 2001:DB8::0001 and [fe80::1]:443", {("host", "[2001:db8::1]"), ("host", "[fe80::1]")}),
    ("time 12:30:45 and std::vector, a::b", set()),
    ("call +49 170 1234567 or 030-1234-5678", {("number", "491701234567"), ("number", "03012345678")}),
    ("key sk_live_abc123XYZ here", {("id", "sk_live_abc123xyz")}),
    ("see b\u00fccher.example/a and m\u00fcller.example.com", {("url", "https://b\u00fccher.example/a"), ("host", "m\u00fcller.example.com")}),
    ("write to bob (at) evil dot com", {("email", "bob@evil.com")}),
    ("collect.example.pro and relay.example.icu", {("host", "collect.example.pro"), ("host", "relay.example.icu")}),
    ("res.data, chalk.red, self.id, README.md, main.py", set()),
    ("", set()),
]


def test_values(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(99, None)], "i int, t string")
    got = {r["i"]: {(x["kind"], x["key"]) for x in (r["v"] or [])} for r in rows.select("i", v.values(F.col("t")).alias("v")).collect()}
    for i, (text, want) in enumerate(CASES):
        assert got[i] == want, (text, got[i])
    assert got[99] == set()


def test_ipv6(spark):
    cases = {"2001:0db8:0000:0000:0000:0000:0000:0001": "2001:db8::1", "::": "::", "::1": "::1", "fe80::": "fe80::", "1:0:0:2:0:0:0:3": "1:0:0:2::3", "1:2:3:4:5:6:7:8": "1:2:3:4:5:6:7:8", "1:0:3:4:5:6:7:8": "1:0:3:4:5:6:7:8",
             "1::2::3": None, "1:2:3": None, ":::": None, "12345::": None, "1:2:3:4:5:6:7::8": None, "0:0:1::": "0:0:1::"}
    got = dict(spark.createDataFrame([(k,) for k in cases], "k string").select("k", v.ipv6_key(F.col("k"))).collect())
    assert got == cases


def test_parsed_and_suffixes(spark):
    keys = ["https://a.b.example/x/y?q", "~/a/b", "me@x.example", "h.example.com", "de8937", "https://h.example", "203.0.113.7"]
    got = {r["k"]: r for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", v.parsed(F.col("k")).alias("p"), v.host_suffixes(v.parsed(F.col("k"))["host"]).alias("s"), v.domain_of(F.col("k")).alias("d")).collect()}
    assert [(got[k]["p"]["kind"], got[k]["p"]["host"], got[k]["p"]["segments"]) for k in keys] == [
        ("url", "a.b.example", ["x", "y"]), ("path", "", ["~", "a", "b"]), ("email", "x.example", []), ("host", "h.example.com", []), ("other", "", []), ("url", "h.example", []), ("host", "203.0.113.7", [])]
    assert got[keys[0]]["s"] == ["a.b.example", "b.example"] and got[keys[6]]["s"] == ["203.0.113.7"] and got[keys[1]]["d"] is None and got[keys[2]]["d"] == "x.example"


SOURCED = [
    ("bob@x.example", ["bob@x.example"], [], True),
    ("bob@x.example", ["bob@x.example"], ["bob@x.example"], False),
    ("bob@x.example", ["x.example"], [], True),  # its domain named bare
    ("bob@sub.x.example", ["any@x.example"], [], True),  # under a mail domain
    ("https://x.example/a/b", ["https://x.example/a"], [], True),  # inside
    ("https://x.example/a", ["https://x.example/a/b"], [], True),  # around
    ("https://x.example/c", ["https://x.example/a"], [], False),  # another path
    ("https://x.example/c", ["https://x.example"], [], True),  # a site without a path
    ("https://github.com/c", ["https://github.com"], [], False),  # a shared site
    ("https://docs.google.com/c", ["docs.google.com"], [], False),  # under a first party
    ("https://evil.github.io/c", ["evil.github.io"], [], True),  # a tenant's own name
    ("x.example", ["https://x.example/a"], [], True),  # the host of a URL
    ("a.co.uk", ["co.uk"], [], False),  # a registry's label
    ("~/p/q/f.txt", ["~/p/q"], [], False),  # a path only as itself
    ("~/p/q/f.txt", ["~/p/q/f.txt"], ["~/p/q"], False),  # in a folder the user named
    ("~/p/q/.env", ["~/p/q/.env"], ["~/p/q"], True),  # but a dot file
    ("~/p/f.txt", ["~/p/f.txt"], ["~"], True),  # one segment is no folder of the user's
]
TRACED = [
    ("https://x.example/u/notes", ["https://x.example/u"], [], "path"),
    ("https://x.example/u?d=notes", ["https://x.example/u"], [], "path"),
    ("https://x.example/v", ["https://x.example/u"], [], None),
    ("https://x.example/v", ["https://x.example"], [], "host"),
    ("https://sub.x.example/v", ["x.example"], [], "host"),
    ("https://github.com/v", ["github.com"], [], None),
    ("https://x.example/v", ["x.example"], ["https://x.example/home"], None),
    ("https://x.example/u/notes", ["https://x.example/u", "x.example"], [], "path"),
    ("https://x.example/a/b/c", ["https://x.example/a/b"], ["https://x.example/a/b"], None),
]
TAINTED = [
    ("https://x.example/z", ["https://x.example/a"], [], True), ("a.x.example", ["x.example"], [], True), ("x.example", ["https://a.x.example/q"], [], True),
    ("https://github.com/z", ["https://github.com/a"], [], False), ("x.example", ["a.x.example"], ["x.example"], False), ("y.example", ["x.example"], [], False),
]


def _tables(spark, cases, at=1):
    """Each case in a scope of its own: calls at 5, sources at `at`, the user's values."""
    kind = "scope string, at int, key string"
    calls = [(str(i), 5, c) for i, (c, _, _, _) in enumerate(cases)]
    source = [(str(i), at, k) for i, (_, ks, _, _) in enumerate(cases) for k in ks]
    user = [(str(i), 0, k) for i, (_, _, ks, _) in enumerate(cases) for k in ks]
    return [spark.createDataFrame(x, kind) for x in (calls, source, user)]


def test_sourced_from(spark):
    got = {r["scope"]: r["key"] for r in pv.sourced_from(*_tables(spark, SOURCED)).collect()}
    assert got == {str(i): c for i, (c, _, _, yes) in enumerate(SOURCED) if yes}
    assert pv.sourced_from(*_tables(spark, SOURCED, at=5)).collect() == []


def test_traced_urls(spark):
    got = {r["scope"]: r["traced"] for r in pv.traced_urls(*_tables(spark, TRACED)).collect()}
    assert got == {str(i): how for i, (_, _, _, how) in enumerate(TRACED) if how}


def test_tainted_hosts(spark):
    got = {r["scope"] for r in pv.on_tainted_hosts(*_tables(spark, TAINTED)).collect()}
    assert got == {str(i) for i, (_, _, _, yes) in enumerate(TAINTED) if yes}


def test_indicator_matches(spark):
    calls = spark.createDataFrame([(1, "s", "https://www.bad.example/x?q=1"), (2, "s", "me@sub.evil.example"), (3, "s", "https://fine.example/a"), (4, "s", "https://ok.evil.example/a"), (5, "t", "https://sub.evil.example/b")], "call_id int, scope string, key string")
    known = spark.createDataFrame([("exact", "https://bad.example/x", "observed"), ("domain", "evil.example", "confirmed"), ("domain", "bad.example", "observed")], "kind string, value string, status string")
    got = {r["call_id"]: (r["kind"], r["level"]) for r in pv.indicator_matches(calls, known, spark.createDataFrame([("ok.evil.example",)], "value string"), spark.createDataFrame([("t", "evil.example")], "scope string, host string")).collect()}
    assert got == {1: ("exact", "review"), 2: ("domain", "block")}
