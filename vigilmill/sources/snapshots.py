"""Tables kept as numbered snapshots in a folder: each version is whole, is put in place by one rename, and is never changed again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class StaleSnapshot(RuntimeError):
    """Another writer has put a version in place since this one was read."""


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop, hadoop.Path(path), hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, folder: str) -> None:
    _, path, fs = _fs(spark, folder)
    fs.delete(path, True)


def version(spark: SparkSession, store: str) -> int:
    """The last version of a store, 0 if there is none."""
    _, path, fs = _fs(spark, store)
    if not fs.exists(path):
        return 0
    return max((int(n[1:]) for n in (s.getPath().getName() for s in fs.listStatus(path)) if n[:1] == "v" and n[1:].isdigit()), default=0)


def read(spark: SparkSession, store: str, at: int, table: str, schema: str) -> DataFrame:
    """A table of a version; empty with the schema for version 0."""
    return spark.read.schema(schema).parquet(f"{store}/v{at:08d}/{table}") if at else spark.createDataFrame([], schema)


def commit(spark: SparkSession, store: str, at: int, tables: dict[str, DataFrame]) -> int:
    """Write tables as the version after `at`; StaleSnapshot if that version is there by then, and nothing of this one stays."""
    hadoop, path, fs = _fs(spark, store)
    fresh = f"{store}/_new-{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            df.write.parquet(f"{fresh}/{name}")
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        none = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:  # fails where the target is
            context.rename(hadoop.Path(fresh), hadoop.Path(f"{store}/v{at + 1:08d}"), none)
        except Exception as e:
            if version(spark, store) > at:
                raise StaleSnapshot(f"version {at + 1} was written meanwhile") from e
            raise
    finally:
        fs.delete(hadoop.Path(fresh), True)
    return at + 1
