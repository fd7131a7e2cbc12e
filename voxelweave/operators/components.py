"""Connected components and checkpoints that survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder on one machine
    (a local master); a cluster has no folder of one machine that all can read."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return found.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes to the shared folder and reads back. The files go
    when the driver's JVM ends."""
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/scene-{uuid.uuid4().hex}"
    df.write.parquet(where)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(where)


#: Up to so many edges (counted) one task joins them all, which spares the rounds.
ONE_TASK = 100_000


def _joined(table):
    """u, v -> node, comp by union and find."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in zip(table.column("u").to_pylist(), table.column("v").to_pylist()):
        p, q = root(u), root(v)
        if p != q:
            parent[max(p, q)] = min(p, q)
    nodes = list(parent)
    return pa.table({"node": pa.array(nodes, pa.int64()), "comp": pa.array([root(x) for x in nodes], pa.int64())})


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of all nodes with an edge: comp is the smallest node that
    edges reach. Large-star and small-star steps alternate until nothing
    changes; rounds grow with the logarithm of the longest path. Few edges are
    joined by one task."""
    e = keep(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())

    def mark(t: DataFrame):
        return tuple(t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())

    now = mark(e)
    if now[0] <= ONE_TASK:
        return e.select(F.lit(0).alias("g"), F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).groupBy("g").applyInArrow(_joined, "node long, comp long")
    while now[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        e = keep(small)
        then = mark(e)
        if then == now:
            break
        now = then
    tops = e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(tops)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds 0, 1, 2, ... in the order, which has no ties. Rows are dealt to
    ranges of the order and sorted there; a row's number is its place in its range
    and the rows of all ranges before, so no task sorts the table."""
    t = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    t = keep(t).withColumn("_p", F.shiftright("_m", 33))
    before, starts = 0, []
    # one row a range
    for part, n in t.groupBy("_p").count().orderBy("_p").collect():
        starts.append((part, before))
        before += n
    s = df.sparkSession.createDataFrame(starts, "_p long, _s long")
    return t.join(F.broadcast(s), "_p").withColumn(name, F.col("_s") + F.col("_m").bitwiseAND(2**33 - 1)).drop("_p", "_m", "_s")


def dense_ids(df: DataFrame, label: str, into: str) -> DataFrame:
    """0, 1, 2, ... in the order of the labels, which are numbered and joined back."""
    ids = numbered(df.select(label).where(F.col(label).isNotNull()).distinct(), [F.col(label)], into)
    return df.join(ids.withColumn(into, F.col(into).cast("int")), label, "left")
