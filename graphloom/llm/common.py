"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII blanks, U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is made once per session
    and removed at exit, on a local master (one machine, tests) only.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors see")
    at = getattr(spark, "_graphloom_scratch", None)
    if at is None:
        at = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark._graphloom_scratch = at
    return at


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._graphloom_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what ``cut`` wrote, once nothing reads it any more."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by exact name, so that others never clash."""
    have = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(have))])
    folded = [c.lower() for c in have]
    out = []
    for name in names:
        i = have.index(name) if name in have else folded.index(name.lower())
        out.append(F.col(f"_c{i}").alias(name))
    return plain.select(*out)


def ascii_lower(c: Column) -> Column:
    """A-Z become a-z and nothing else changes."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, _UPPER, _UPPER.lower())
    )


def digest(c: Column) -> tuple[Column, Column]:
    """128 bits that stand for a string."""
    return F.xxhash64(c), F.xxhash64(F.lit(7), c)


def without(rows: DataFrame, key: Column, gone: DataFrame, near: int = 500_000) -> DataFrame:
    """rows whose key is not among those of gone (one column); null keys stay.

    Up to ``near`` distinct keys travel to the rows, which then stay where they
    are; more are met by a shuffle.
    """
    name = gone.columns[0]
    gone = cut(gone.select(F.col(name).alias("_gone")).where("_gone is not null").distinct())
    few = gone.count() <= near
    return rows.join(F.broadcast(gone) if few else gone, key == F.col("_gone"), "left_anti")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges between longs.

    Returns (node, root) for every node that an edge with two distinct ends
    holds; root is the least node of its component.  Each round replaces the
    edges by stars (large-star, then small-star), so the number of rounds
    grows with the logarithm of the longest path.  A hub's edges are met by
    partial aggregation and by a join that AQE can split, never by one task.
    Null ends and loops are ignored.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    e = cut(e)
    size = e.count()
    while size:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        )
        large = (
            e.select(F.col("v").alias("c"), F.col("u").alias("w"))
            .join(least, F.col("c") == least["u"])
            .select(F.col("w").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        large = cut(large)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(low.select(F.col("u").alias("c"), "m"), F.col("u") == F.col("c"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
        )
        small = cut(small)
        n = small.count()
        # Stars: no node is both a leaf and a centre, and each leaf has one centre.
        leaves = small.select("u").distinct().count()
        done = leaves == n and not small.join(
            small.select(F.col("u").alias("c")).distinct(), F.col("v") == F.col("c"), "left_semi"
        ).take(1)
        for old in (e, least, large, low):
            release(old)
        e = small
        if done:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
