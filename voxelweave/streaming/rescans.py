"""Re-scans as a stream: revisions, selective verification, resume, watching."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.graph import Graph, load, save, upsert


class GraphStream:
    """Applies every micro-batch as one revision a time stamp, in order of the
    stamps. With a ``folder``, the graph and the number of the batch that made it
    are written after each batch and read at the start: a batch that is delivered
    again after a crash changes nothing, and a restart goes on from the last
    revision."""

    def __init__(self, graph: Graph, on_revision: Callable[[Graph], None] | None = None, folder: str | None = None):
        self.graph, self.on_revision, self.last_batch, self.folder = graph, on_revision, -1, folder
        if folder and (found := load(graph.nodes.sparkSession, folder)):
            self.graph, self.last_batch, _ = found

    def apply(self, batch: DataFrame, number: int) -> None:
        if number <= self.last_batch:
            return
        # few: one a scan
        for row in batch.select("ts").distinct().orderBy("ts").collect():
            self.graph = upsert(self.graph, batch.where(F.col("ts") == row["ts"]).drop("ts"), row["ts"])
            if self.on_revision:
                self.on_revision(self.graph)
        self.last_batch = number
        if self.folder:
            save(self.graph, self.folder, number)

    def start(self, scans: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        w = scans.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if once else w).start()


def unseen(records: DataFrame, content: str = "content", ts: str = "event_time", delay: str = "30 days") -> DataFrame:
    """Records whose content was not seen within the delay: what is left to
    verify. State is bounded by the watermark."""
    return records.withColumn("_h", F.md5(content)).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["_h"]).drop("_h")


def resumable(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Finished results appended as JSON; restarts go on after the last one
    that the checkpoint has."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(spark, folder: str, schema, rebuild: Callable[[DataFrame], None], checkpoint: str, every: str = "3 seconds", once: bool = False, tries: int = 3) -> StreamingQuery:
    """Calls rebuild with what changed in a folder. A failing rebuild is tried
    again; after the last try the query ends with its error and the change is
    not committed, so that the next start begins with it."""

    def run(batch: DataFrame, _: int) -> None:
        for k in range(tries):
            try:
                return rebuild(batch)
            except Exception:
                if k + 1 == tries:
                    raise

    w = spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()
