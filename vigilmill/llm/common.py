"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir; a temporary one only where none is set and all runs in one process (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="ckpt-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame, release: bool = False) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that a lost executor costs no recomputation.

    release: the shuffle files that it was made from go at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not release:
        return df.checkpoint(eager=True)
    with _released(spark):
        own = df.select("*")  # a plan of its own, whose shuffles nothing else reads
    return own.checkpoint(eager=True)


@contextmanager
def _released(spark: SparkSession) -> Iterator[None]:
    """Plans made meanwhile give up their shuffle files when they have run."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a table in columns to the shared folder and reads it again; all such tables go at the end.

    For tables that are read several times by a few of their columns.
    """
    folder = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"

    def put(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        with _released(spark):
            # Hashes and ids hardly repeat: a dictionary would be built in vain.
            df.select("*").write.option("parquet.enable.dictionary", "false").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield put
    finally:
        remove(spark, folder)


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """names, with underscores before them until none is taken (case does not tell columns apart)."""
    used = {x.lower() for x in taken}
    found = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        found.append(name)
    return found


def sampled(hash_: Column, rows: int, total: int) -> Column:
    """Whether a 64-bit hash falls into the share that gives about `rows` of `total` rows; by 63 bits, so that no total rounds it to nothing."""
    return F.shiftrightunsigned(hash_, 1) < F.lit(max(1, min((1 << 63) - 1, (rows << 63) // total)))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver see."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
