"""Driver-side iteration: ending lineage, numbering rows in order, contracting components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.errors import LimitError


#: So many rows are numbered in one task: a traversal's levels are most often small.
FEW = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; unset, a temporary one, on a local master only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise LimitError("spark.checkpoint.dir has to name a folder that all executors see")
    at = getattr(spark, "_graphloom_rounds", None)
    if at is None:
        at = tempfile.mkdtemp(prefix="graphloom-rounds-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark._graphloom_rounds = at
    return at


def cut(df: DataFrame) -> DataFrame:
    """A written copy of df without its lineage; it survives the loss of executors."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._graphloom_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete what ``cut`` wrote of these, once nothing reads it any more; other frames are left alone."""
    for df in frames:
        path = getattr(df, "_graphloom_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """The tables of one operator's rounds: ``cut`` them here, then ``keep`` what its result reads and drop the rest."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def cut(self, df: DataFrame) -> DataFrame:
        out = cut(df)
        self.made.append(out)
        return out

    def keep(self, *frames: DataFrame | None) -> None:
        stay = {getattr(f, "_graphloom_path", None) for f in frames}
        release(*(f for f in self.made if f._graphloom_path not in stay))
        self.made = [f for f in self.made if f._graphloom_path in stay]


def numbered(df: DataFrame, *keys: str, name: str = "ord", start: int = 0) -> DataFrame:
    """df with 0, 1, 2, ... in the order of keys, without sorting more than FEW rows in one task.

    Rows are sorted by range; the few partition sizes give each partition its
    first number.
    """
    at = F.monotonically_increasing_id()
    df = cut(df)
    if df.count() <= FEW:
        return df.coalesce(1).sortWithinPartitions(*keys).withColumn(name, at + F.lit(start))
    s = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    s = cut(s.withColumn("_pid", F.spark_partition_id()).withColumn("_at", at))
    first = {}
    total = start
    for pid, n in sorted((r["_pid"], r["n"]) for r in s.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()):
        first[pid] = total
        total += n
    if not first:
        return s.withColumn(name, F.lit(0).cast("long")).drop("_pid", "_at")
    offset = df.sparkSession.createDataFrame(list(first.items()), "_pid int, _first long")
    # monotonically_increasing_id holds the partition above bit 33 and the row below it.
    return s.join(F.broadcast(offset), "_pid").withColumn(name, F.col("_first") + F.col("_at") - F.shiftleft(F.col("_pid").cast("long"), 33)).drop("_pid", "_at", "_first")


def running_sum(df: DataFrame, key: str, value: str, name: str = "before") -> DataFrame:
    """df with the sum of value over all rows before, in the order of a unique key, without sorting in one task."""
    s = cut(df.repartitionByRange(F.col(key)).withColumn("_pid", F.spark_partition_id()))
    sums = sorted((r["_pid"], r["s"]) for r in s.groupBy("_pid").agg(F.sum(value).alias("s")).collect())
    total, first = 0.0, []
    for pid, x in sums:
        first.append((pid, total))
        total += x or 0.0
    offset = df.sparkSession.createDataFrame(first, "_pid int, _first double")
    inner = Window.partitionBy("_pid").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = s.withColumn("_own", F.coalesce(F.sum(value).over(inner), F.lit(0.0)))
    return out.join(F.broadcast(offset), "_pid").withColumn(name, F.col("_first") + F.col("_own")).drop("_pid", "_own", "_first")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): each node's least connected node; edges (u, v) count both ways.

    Large-star and small-star rounds, so long chains take a logarithmic number of rounds.
    """
    own = Scratch()
    e = own.cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = own.cut(e.join(least, F.col("v") == F.col("c")).select("u", F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        star = large.join(low, F.col("u") == F.col("c")).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = own.cut(star.union(low.select(F.col("c").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
        own.keep(small)
        flat = small.join(small.select(F.col("u").alias("c")).distinct(), F.col("v") == F.col("c"), "left_semi").limit(1).count() == 0
        if flat and small.count() == small.select("u").distinct().count():
            break
        e = small
    return nodes.join(small.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each group: the first in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
