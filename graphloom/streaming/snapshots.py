"""Edge streams kept as graph snapshots: each micro-batch is folded into a table of weights."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import PropertyGraph
from ..plans.iterate import shared_dir

SCHEMA = "src string, dst string, weight double"


class SnapshotSink:
    """A foreachBatch function: sums weights per (src, dst) and keeps the newest snapshot of the graph.

    Each batch writes its snapshot to ``root``/epoch=N, a folder that all
    executors see, from the newest one before it; so a batch that is tried
    again gives the same, and a sink with the same root goes on where another
    one stopped.  Only the newest two snapshots are kept.
    """

    def __init__(self, on_snapshot: Callable[[PropertyGraph, int], None] | None = None, directed: bool = True, root: str | None = None):
        self.on_snapshot, self.directed, self.root = on_snapshot, directed, root

    def _files(self, spark: SparkSession):
        if self.root is None:
            self.root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def epochs(self, spark: SparkSession) -> list[int]:
        """The snapshots that have been written to the end, oldest first."""
        path, fs = self._files(spark)
        if not fs.exists(path(self.root)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.root))]
        return sorted(int(n[6:]) for n in names if n.startswith("epoch=") and fs.exists(path(f"{self.root}/{n}/_SUCCESS")))

    def _read(self, spark: SparkSession, epoch: int) -> DataFrame:
        return spark.read.schema(SCHEMA).parquet(f"{self.root}/epoch={epoch}")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        done = self.epochs(spark)
        if done and epoch <= done[-1]:
            return
        rows = batch.select("src", "dst", F.col("weight").cast("double").alias("weight"))
        if done:
            rows = self._read(spark, done[-1]).unionByName(rows)
        rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).write.mode("overwrite").parquet(f"{self.root}/epoch={epoch}")
        path, fs = self._files(spark)
        for old in done[:-1]:
            fs.delete(path(f"{self.root}/epoch={old}"), True)
        if self.on_snapshot:
            self.on_snapshot(self.graph(spark), epoch)

    def graph(self, spark: SparkSession | None = None) -> PropertyGraph:
        """The newest snapshot; an empty graph before the first batch."""
        spark = spark or SparkSession.getActiveSession()
        caps = {"directed": self.directed, "weighted": True, "loops": True}
        done = self.epochs(spark)
        if not done:
            return PropertyGraph.empty(spark, **caps)
        return PropertyGraph.from_edges(self._read(spark, done[-1]).withColumn("edge_id", F.concat_ws(">", "src", "dst")), check=False, **caps)


def windowed_edges(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, src, dst, weight) counts of an event stream (ts, src, dst) under a watermark."""
    e = events.withWatermark("ts", late).groupBy(F.window("ts", window), "src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    return e.select(F.col("window.start").alias("start"), "src", "dst", "weight")
