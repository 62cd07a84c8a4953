"""Session state over an event stream: taint, strikes, budget and idle timeout.

Rows: session_id, ts, n, kind (prompt, call, result), value, hostile; n orders rows of one time.  A result flagged as hostile taints its values;
a call that uses a tainted value that no prompt of the session named is denied; calls beyond the budget ask.  State is
bounded: the newest `most` tainted and the newest `most` named values are kept, and losing a tainted one sets a lasting bit that
turns allow into ask (losing a named one only makes a call stricter).  A clean session is dropped after 7 idle days, one with
taint or the bit after 30; any event renews it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session_id string, ts timestamp, kind string, value string, decision string"
STATE = "taint array<string>, named array<string>, calls int, strikes int, lost boolean"
MOST, BUDGET = 20_000, 4
CLEAN_DAYS, TAINTED_DAYS = 7, 30


def step(state: tuple, rows: list[tuple], most: int = MOST, budget: int = BUDGET) -> tuple[tuple, list[str]]:
    """The state after rows (kind, value, hostile) in order, and each row's decision."""
    taint, named, calls, strikes, lost = dict.fromkeys(state[0]), dict.fromkeys(state[1]), *state[2:]
    out = []
    for kind, value, hostile in rows:
        decision = "allow"
        if kind == "prompt":
            named.pop(value, None)
            named[value], calls, strikes = None, 0, 0
            if len(named) > most:
                del named[next(iter(named))]
        elif kind == "result":
            if hostile:
                taint.pop(value, None)
                taint[value] = None
                while len(taint) > most:
                    del taint[next(iter(taint))]
                    lost = True
        else:
            calls += 1
            if value in taint and value not in named:
                decision, strikes = "deny", strikes + 1
            elif calls > budget or lost or strikes >= 3:
                decision = "ask"
        out.append(decision)
    return (list(taint), list(named), calls, strikes, lost), out


def _run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    # One trigger's rows of a session; the source's rows a trigger bound them.
    rows = pd.concat(list(frames)).sort_values(["ts", "n"], kind="stable")
    held = state.get if state.exists else ([], [], 0, 0, False)
    held, decisions = step(tuple(held), list(zip(rows["kind"], rows["value"], rows["hostile"])))
    state.update(held)
    state.setTimeoutDuration((TAINTED_DAYS if held[0] or held[4] else CLEAN_DAYS) * 86_400_000)
    yield pd.DataFrame({"session_id": key[0], "ts": rows["ts"], "kind": rows["kind"], "value": rows["value"], "decision": decisions})


def decide(events: DataFrame) -> DataFrame:
    """Decisions of a stream of session_id, ts, kind, value, hostile and, where it has it, n."""
    rows = events if "n" in events.columns else events.withColumn("n", F.lit(0))
    return rows.groupBy("session_id").applyInPandasWithState(_run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def once(requests: DataFrame, key: str = "idempotency_key", late: str = "1 hour") -> DataFrame:
    """Requests of a stream, those repeated under a key within the watermark left out."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def enriched(events: DataFrame, load, sink) -> object:
    """A stream writer that joins each micro-batch with a fresh reading of a dimension: load(spark) gives it, sink(joined, batch_id) takes the rows; join on `value`."""

    def batch(rows: DataFrame, number: int) -> None:
        sink(rows.join(load(rows.sparkSession), "value", "left"), number)

    return events.writeStream.foreachBatch(batch)


def flagged_counts(events: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Hostile results in each window of event time."""
    rows = events.withWatermark("ts", late).where("kind = 'result' and hostile")
    return rows.groupBy(F.window("ts", window).alias("w"), "session_id").agg(F.count("*").alias("n")).select("w.start", "session_id", "n")
