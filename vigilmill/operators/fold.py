"""Order-dependent folds: rows of a key in order, through a small state, a batch at a time.

A key's rows are sorted and streamed through the step, so memory is one batch and one state however many rows a key has (they are in one
task: an order is kept).  A null key is a key.  Values come to the step as Python's, whole numbers as they are; a null time moves nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def fold(rows: DataFrame, key: str, order: list[str], start: tuple, step: Callable[[tuple, tuple], tuple[tuple, tuple]], out: str) -> DataFrame:
    """Columns of rows, then those of `out` (a schema) that step(state, row) -> (state, values) gives; `start` is the state of a key's first row."""
    place = rows.columns.index(key)
    added = T.StructType.fromDDL(out)
    schema, kinds = T.StructType([*rows.schema.fields, *added.fields]), to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = (), start  # (): no key yet
        for batch in batches:
            told = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[place] != at:
                    at, state = row[place], start
                state, values = step(state, row)
                told.append(values)
            if told:
                new = [pa.array(column, kind.type) for column, kind in zip(zip(*told), kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *kinds.names])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def token_bucket(rows: DataFrame, key: str, seconds: str, rate: float, burst: float, order: list[str] | None = None) -> DataFrame:
    """rows with `allowed`: a call takes a token if there is one; tokens come back at `rate` a second, `burst` at most and at first."""
    at = rows.columns.index(seconds)

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        tokens, last = state
        now = last if row[at] is None else row[at]
        if last is not None:
            tokens = min(burst, tokens + max(0.0, now - last) * rate)
        ok = tokens >= 1.0
        return (tokens - 1.0 if ok else tokens, now), (ok,)

    return fold(rows, key, order or [seconds], (burst, None), step, "allowed boolean")


def session_lives(rows: DataFrame, key: str, seconds: str, flagged: str, clean_ttl: float, flagged_ttl: float, order: list[str] | None = None) -> DataFrame:
    """rows with `life` (from 1) and `held` (whether the life is flagged by then): a session ends after `clean_ttl` idle seconds, a flagged one after `flagged_ttl`; any event renews it."""
    at, flag = rows.columns.index(seconds), rows.columns.index(flagged)

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        life, held, last = state
        now = last if row[at] is None else row[at]
        if life == 0 or last is not None and now - last > (flagged_ttl if held else clean_ttl):
            life, held = life + 1, False
        held = held or bool(row[flag])
        return (life, held, now), (life, held)

    return fold(rows, key, order or [seconds], (0, False, None), step, "life bigint, held boolean")
