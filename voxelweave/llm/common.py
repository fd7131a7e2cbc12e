"""What several operators of this folder share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Where
    that is unset, a temporary folder on one machine (tests, a local master) and
    an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return found.rstrip("/")


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow for columns of long texts. Batches hold 1,000 rows unless the
    session asks for another number than Spark's default; when a task ends its
    worker gives freed memory back, as it goes on to serve other stages."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, "1000")

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return df.mapInArrow(lean, schema)


class Scratch:
    """Tables written to the shared folder to cut lineage: an executor that is
    lost takes nothing of them with it. They go when the driver's JVM ends, or
    at ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        path = self._path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def _path(self, where: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(where)

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        where = f"{self.root}/{self._n}"
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._scratch_path = where
        return out

    def drop(self, df: DataFrame) -> None:
        path = self._path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the rows that no label is learned from. A null id
    counts as held out, as nothing says that it may be learned from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def gapless(scratch: Scratch, df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within each value of the (non-null) keys.

    The rows are written once with the task that made them and their place in
    it. A key's rows of one task are then numbered together, beginning where
    the tasks before it end: however many rows a key has, no group that is
    sorted holds more than one task's rows.
    """
    kept = scratch.keep(df.withColumn("_task", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    before = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy(*keys, "_task").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_task").orderBy("_row")
    out = kept.withColumn("_nth", F.row_number().over(within) - 1).join(starts, [*keys, "_task"])
    return out.withColumn(name, (F.col("_from") + F.col("_nth")).cast("long")).drop("_task", "_row", "_from", "_nth")


def bounded_sample(df: DataFrame, group: str, order: str, k: int, salts: int = 64) -> DataFrame:
    """At most k rows for each value of ``group``, those that come first in
    ``order`` (a hash). Two steps, so that no task meets all of a hot group:
    Spark keeps k rows a group in each task before it shuffles."""
    first = Window.partitionBy(group, "_salt").orderBy(order)
    then = Window.partitionBy(group).orderBy(order)
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))
        .withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= k)
        .withColumn("_rank", F.row_number().over(then)).where(F.col("_rank") <= k)
        .drop("_rank", "_salt")
    )
