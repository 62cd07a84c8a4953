"""Functions, sources, decisions and the session stream."""

import json

from pyspark.sql import functions as F

from vigilmill.functions import stats, text, values
from vigilmill.operators import decisions
from vigilmill.sources import events
from vigilmill.streaming import session


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_iban(spark):
    assert _one(spark, values.iban_valid(F.lit("gb82west12345698765432")))
    assert not _one(spark, values.iban_valid(F.lit("gb83west12345698765432")))


def test_url_key(spark):
    assert _one(spark, values.url_key(F.lit("HTTP://user@Example.com:80/A/b/#x"))) == "https://example.com/a/b"
    assert _one(spark, values.host_suffixes(F.lit("a.b.example.com"))) == ["a.b.example.com", "b.example.com", "example.com"]


def test_wilson_and_sign(spark):
    low, high = stats.wilson(F.lit(5), F.lit(10))
    assert round(_one(spark, low), 4) == 0.2366 and round(_one(spark, high), 4) == 0.7634
    assert _one(spark, stats.wilson(F.lit(0), F.lit(0))[1]) == 1.0
    assert round(_one(spark, stats.sign_test(F.lit(7), F.lit(24))), 4) == 0.0033
    assert round(_one(spark, stats.sign_test(F.lit(1500), F.lit(1600))), 3) == 0.075 and _one(spark, stats.sign_test(F.lit(5), F.lit(5))) == 1.0


def test_mutation(spark):
    names = {"srv:listItems": False, "srv:getOrCreate": True, "pay:sendMoney": True, "srv:frobnicate": True, "a:b:read_file": False, "s:get_and_exec": True, "s:search_and_download": True, "s:view_and_cancel": True, "s:get_pull_request": False, "s:pull_repo": True, "s:check_in": True, "s:check_status": False}
    df = spark.createDataFrame(list(names), "string")
    assert {r[0]: r[1] for r in df.select("value", decisions.is_mutation(F.col("value"))).collect()} == names


def test_tokens_and_chunks(spark):
    assert _one(spark, text.content_tokens(F.lit("The rivers are running to a Stone"))) == ["river", "runn", "stone"]
    assert _one(spark, text.content_tokens(F.lit("class glass buses, see https://a.example/x or me@b.example"))) == ["class", "glass", "buse", "see", "xurl", "xemail"]
    long = spark.range(1).select(F.repeat(F.lit("w "), F.lit(1_000_000)).alias("t"))
    assert long.select(F.size(text.word_chunks(F.col("t"), most=None)).alias("n")).first()["n"] > 31_000
    whole = "".join(chr(97 + i % 26) for i in range(5000))
    got = _one(spark, text.char_windows(F.lit(whole)))
    assert got == [whole[i : i + 1000] for i in range(0, 5000 - 16, 984)] and _one(spark, text.char_windows(F.lit(""))) == [""]
    assert len(_one(spark, text.word_chunks(F.lit("w " * 100)))) == 3


def test_lines_and_quarantine(spark, tmp_path):
    p = tmp_path / "e.jsonl"
    p.write_text(json.dumps({"hook_event_name": "Stop", "session_id": "s"}) + "\n\nnot json\n")
    good, bad = events.read_lines(spark, str(p))
    assert good.count() == 1 and bad.collect()[0]["line"] == "not json"
    assert events.optional(spark, str(tmp_path / "none")).count() == 0


def test_append_goes_on(spark, tmp_path):
    path = str(tmp_path / "log")
    for ts in ("2024-01-01", "2024-01-02"):
        events.append_events(spark.createDataFrame([(s, ts, f"t{i}") for s in "ab" for i in range(2)], "session_id string, ts string, tool_use_id string"), path)
    got = sorted((r["session_id"], r["sequence"]) for r in spark.read.parquet(path).collect())
    assert got == [(s, n) for s in "ab" for n in (1, 2, 3, 4)]


def test_manifest(spark, tmp_path):
    import hashlib

    for name, data in (("a/x.txt", b"one"), ("b/x.txt", b"two"), ("b/new.txt", b"three")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    listed = [("a/x.txt", hashlib.sha256(b"one").hexdigest()), ("b/x.txt", hashlib.sha256(b"other").hexdigest()), ("gone.txt", "00")]
    got = {r["path"]: r["state"] for r in events.manifest_check(spark, str(tmp_path), spark.createDataFrame(listed, "path string, sha256 string")).collect()}
    assert got == {"a/x.txt": "ok", "b/x.txt": "mismatch", "gone.txt": "missing", "b/new.txt": "unlisted"}


def test_feeds_reports_and_caches(spark, tmp_path):
    feed = '{"name": "f", "indicators": [{"value": " Bad.Example "}, {"value": "two words"}, {"value": ""}, {"value": "x.example", "kind": "domain", "status": "confirmed"}, {"value": "y", "kind": "odd"}]}'
    taken, skipped = events.import_feed(spark.createDataFrame([(feed,), ("no json",)], "value string"))
    assert {tuple(r) for r in taken.select("kind", "value", "status").collect()} == {("exact", "bad.example", "observed"), ("domain", "x.example", "confirmed")}
    assert sorted(r["reason"] for r in skipped.collect()) == ["blanks", "empty", "kind", "not a feed"]
    out = events.export_feed(taken.withColumn("group", F.lit(None).cast("string"))).first()["feed"]
    assert json.loads(out)["indicators"][0] == {"kind": "domain", "value": "x.example", "status": "confirmed"}
    found = spark.createDataFrame([("s", "r1", "error", 'say "x"', "f.json"), ("s", "r2", "note", "b", "a.json")], "source string, rule string, level string, message string, uri string")
    report = json.loads(events.sarif(found, "scan").first()["report"])
    assert report["version"] == "2.1.0" and [r["ruleId"] for r in report["runs"][0]["results"]] == ["r1", "r2"] and report["runs"][0]["results"][0]["message"]["text"] == 'say "x"'
    assert [r["line"] for r in events.markdown_rows(spark.createDataFrame([("a|b", None)], "x string, y int")).collect()] == ["| a\\|b | – |"]
    cache = str(tmp_path / "scores")
    for v in (0.1, 0.9):
        events.append_scores(spark.createDataFrame([("k", v), (f"k{v}", v)], "key string, score double"), cache)
    assert {r["key"]: r["score"] for r in spark.read.parquet(cache).collect()} == {"k": 0.1, "k0.1": 0.1, "k0.9": 0.9}
    vectors = str(tmp_path / "vectors")
    events.save_vectors(spark.createDataFrame([(1, [0.5])], "id int, v array<double>"), vectors, "one")
    assert events.load_vectors(spark, vectors, "one").columns == ["id", "v"]
    try:
        events.load_vectors(spark, vectors, "two")
        raise AssertionError
    except ValueError:
        pass
    (tmp_path / "cat").mkdir()
    (tmp_path / "cat" / "a.json").write_text('[{"name": "t", "description": "d"}]')
    (tmp_path / "cat" / "b.json").write_text("nothing")
    tools, bad = events.tool_catalogs(spark, str(tmp_path / "cat"))
    assert [r["name"] for r in tools.collect()] == ["t"] and bad.count() == 1
    nested = spark.createDataFrame([("s", [("i", [("d", {"m1": "x", "m2": "y"})])])], "server string, instances array<struct<name:string,datas:array<struct<id:string,responses:map<string,string>>>>>")
    assert sorted(tuple(r) for r in events.responses(nested).collect()) == [("s", "i", "d", "m1", "x"), ("s", "i", "d", "m2", "y")]


def test_session_step_in_any_split():
    rows = [("prompt", "a", False), ("result", "x", True), ("call", "x", False), ("call", "a", False), ("result", "a", True), ("call", "a", False), *[("call", "q", False)] * 3]
    whole = session.step(([], [], 0, 0, False), rows)
    for cut in range(len(rows)):
        state, first = session.step(([], [], 0, 0, False), rows[:cut])
        state, rest = session.step(state, rows[cut:])
        assert (state, first + rest) == whole
    assert whole[1][2] == "deny" and whole[1][5] == "allow" and whole[1][-1] == "ask"


def test_session_stream(spark, tmp_path):
    rows = [("s", f"2024-01-01T00:00:0{i}Z", k, v, h) for i, (k, v, h) in enumerate([("prompt", "a", False), ("result", "x", True), ("call", "x", False)])]
    src = tmp_path / "in"
    spark.createDataFrame(rows, "session_id string, ts string, kind string, value string, hostile boolean").coalesce(1).write.json(str(src))
    stream = spark.readStream.schema("session_id string, ts timestamp, kind string, value string, hostile boolean").json(str(src))
    q = session.decide(stream).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["decision"] for r in spark.sql("select decision from decided order by ts").collect()] == ["allow", "allow", "deny"]
