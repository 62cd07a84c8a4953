"""Ordered folds: null keys and times, large ids, idempotency by the time of each request."""

from vigilmill.operators import fold, memory


def test_null_keys_are_one_key(spark):
    rows = [(None, 1.0, i) for i in range(5)] + [(1, 1.0, i) for i in range(5)] + [((1 << 60) + 1, 1.0, 9), ((1 << 60) + 3, 1.0, 8)]
    got = fold.token_bucket(spark.createDataFrame(rows, "k bigint, s double, i bigint"), "k", "s", 0.0, 2.0, ["s", "i"]).collect()
    allowed = {}
    for r in got:
        allowed.setdefault(r["k"], []).append(r["allowed"])
    assert allowed == {None: [True, True, False, False, False], 1: [True, True, False, False, False], (1 << 60) + 1: [True], (1 << 60) + 3: [True]}


def test_null_times_move_nothing(spark):
    rows = [("a", None, 0), ("a", 1.0, 1), ("a", None, 2), ("a", 100.0, 3)]
    got = fold.token_bucket(spark.createDataFrame(rows, "k string, s double, i int"), "k", "s", 1.0, 1.0, ["i"]).collect()
    assert [r["allowed"] for r in sorted(got, key=lambda r: r["i"])] == [True, False, False, True]
    lives = fold.session_lives(spark.createDataFrame([(*r, r[2] == 1) for r in rows], "k string, s double, i int, bad boolean"), "k", "s", "bad", 10, 50, ["i"]).collect()
    assert [(r["life"], r["held"]) for r in sorted(lives, key=lambda r: r["i"])] == [(1, False), (1, True), (1, True), (2, False)]


def test_idempotency_by_time(spark):
    log = [
        ("k", "a", "request", "RESERVED"), ("k", "a", "request", "IN_PROGRESS"), ("k", "b", "request", "CONFLICT"), ("k", "b", "complete", "IGNORED"), ("k", "a", "complete", "DONE"), ("k", "a", "request", "REPLAY"),
        ("k", "b", "request", "CONFLICT"), ("k", "a", "release", "IGNORED"), ("r", "a", "request", "RESERVED"), ("r", "a", "release", "DONE"), ("r", "b", "request", "RESERVED"), ("r", "b", "doubt", "DONE"),
        ("r", "b", "request", "IN_DOUBT"), ("r", "b", "complete", "IGNORED"), ("r", "a", "request", "CONFLICT"), ("n", "a", "complete", "IGNORED"), (None, "a", "request", "RESERVED"), (None, "a", "request", "RESERVED"),
    ]
    df = spark.createDataFrame([(*r, i, 0) for i, r in enumerate(log)], "key string, request_hash string, act string, want string, at int, tie int").repartition(4)
    assert [(r["at"], r["answer"]) for r in memory.idempotency(df).collect() if r["answer"] != r["want"]] == []
