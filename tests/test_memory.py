import datetime as dt

from pyspark.sql import functions as F

from vigilmill.operators import memory

T0 = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)


def test_fold_sticky_and_live(spark):
    s = spark.createDataFrame(
        [("host", "a", "r1", "x:t", T0), ("host", "a", "r1", "x:t", T0 + DAY), ("host", "a", "r2", "y:t", T0 + 40 * DAY), ("host", "b", "r1", "x:t", T0), ("host", "c", "r3", "x:t", T0 + 40 * DAY)],
        "kind string, value string, run_key string, source string, seen timestamp",
    )
    d = spark.createDataFrame([("host", "b", "confirmed", T0), ("host", "c", "confirmed", T0), ("host", "c", "revoked", T0 + DAY)], "kind string, value string, status string, decided timestamp")
    items = memory.fold(s, d)
    assert {(r["value"], r["runs"], r["servers"], r["status"]) for r in items.collect()} == {("a", 2, 2, "observed"), ("b", 1, 1, "confirmed"), ("c", 1, 1, "revoked")}
    assert {r["value"] for r in memory.live(items, F.lit(T0 + 41 * DAY)).collect()} == {"a", "b"}
    assert {r["value"] for r in memory.live(items, F.lit(T0 + 99 * DAY)).collect()} == {"b"}


def test_escalation_and_caps(spark):
    rows = [("h", v, r, s) for v, r, s in (("1", "a", "x:t"), ("2", "b", "y:t"), ("1", "b", "z:t"))] + [("ok", v, r, s) for v, r, s in (("1", "a", "x:t"), ("2", "b", "y:t"), ("1", "b", "z:t"))]
    df = spark.createDataFrame(rows, "host string, value string, run_key string, source string")
    none = spark.createDataFrame([], "host string")
    assert [r["host"] for r in memory.escalated(df, spark.createDataFrame([("ok",)], "host string"), none).collect()] == ["h"]
    items = spark.createDataFrame([("s", str(i), "observed", T0 + i * DAY) for i in range(6)] + [("s", "kept", "confirmed", T0)], "source string, value string, status string, last_seen timestamp")
    assert {r["value"] for r in memory.capped(items, 2, 3).collect()} == {"kept", "5", "4"}
