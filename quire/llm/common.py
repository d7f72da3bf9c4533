"""What the text operators share: tables cut off from their lineage, and null-safe texts."""

from __future__ import annotations

import ctypes
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_dir

#: The folder of this process within the shared one, and the tables that it has written there, with the thread that did.
RUN = f"quire-{uuid.uuid4().hex}"
_made: list[tuple[int, str]] = []
#: Spark's setting that deletes an action's shuffle files at its end, rather than when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; read by Spark, so any store that Spark reaches will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sends texts to Python by fewer rows at a time than Spark does by itself, as each may be long; a number that the session sets is kept."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again.

    What is computed from it later starts at those files, whichever executors have been lost meanwhile. So the shuffle files
    on the way to it go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{RUN}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    _made.append((threading.get_ident(), path))
    return spark.read.schema(df.schema).parquet(path)


def columns(df: DataFrame, **needed: str | Column) -> DataFrame:
    """Only the named columns under the operator's own names, so that further columns of df can't clash."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name) for name, c in needed.items()])


def drop_written(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes tables that written() has left in the shared folder: those of this process alone. For use after results are stored."""
    jvm = spark._jvm
    gone = {p for _, p in _made} if paths is None else set(paths)
    for path in gone:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _made[:] = [x for x in _made if x[1] not in gone]


def made() -> list[str]:
    """The tables that written() has made in this thread and that are still there, in order."""
    return [p for t, p in _made if t == threading.get_ident()]


def latest() -> list[str]:
    """The table that written() made last."""
    return made()[-1:]


@contextmanager
def scratch(spark: SparkSession, keep: int = 0) -> Iterator[None]:
    """At its end, tables written within are deleted but for the last `keep` of them. What is read from others later must be written within.

    The driver's garbage is collected too: what it holds of broadcasts and of finished plans goes, and its heap shrinks.
    """
    before = set(made())
    yield
    within = [p for p in made() if p not in before]
    drop_written(spark, within[: len(within) - keep])
    spark._jvm.System.gc()


def most_frequent(counted: DataFrame, size: int, name: str, count: str = "n") -> DataFrame:
    """The rows of counted from the lowest frequency on that leaves at most size of them.

    Frequencies are taken in steps of an eighth of a power of two; a few hundred step counts tell where to stop, so the
    driver never gets more rows than are kept.
    """
    stepped = written(counted.withColumn("_step", F.floor(F.log2(count) * 8).cast("int")), name)
    left, least = size, 0
    for r in stepped.groupBy("_step").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("_step")).collect():
        left -= r.rows
        if left < 0:
            least = r._step + 1
            break
    return stepped.filter(F.col("_step") >= least).drop("_step")


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, marked for broadcast if it has few rows; for narrow rows that are written already. Beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def give_back() -> None:
    """Returns memory that a task has freed to the system, at its end: workers live on and idle beside others."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
