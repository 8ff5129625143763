"""Graphs, series and matrices derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import PropertyGraph
from ..plans.iterate import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight): customer nation to supplier nation, whole quantities summed."""
    t = lambda n: table(spark, sf_dir, n)
    li = t("lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("a"))
    s = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("b"))
    j = li.join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey")
    return j.groupBy("a", "b").agg(F.sum("l_quantity").cast("long").cast("double").alias("weight")).select(F.lpad(F.col("a").cast("string"), 2, "0").alias("src"), F.lpad(F.col("b").cast("string"), 2, "0").alias("dst"), "weight")


def trade_graph(spark: SparkSession, sf_dir: str, directed: bool = True) -> PropertyGraph:
    """Trade between different nations; undirected sums both ways."""
    a = trade_arcs(spark, sf_dir).where("src <> dst")
    if not directed:
        a = a.groupBy(F.least("src", "dst").alias("s"), F.greatest("src", "dst").alias("d")).agg(F.sum("weight").alias("weight")).select(F.col("s").alias("src"), F.col("d").alias("dst"), "weight")
    e = cut(a.withColumn("edge_id", F.concat_ws("-", "src", "dst")))  # a few rows of a join of four tables, read again and again
    v = table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("id"))
    return PropertyGraph.from_edges(e, v, check=False, directed=directed, weighted=True)


def supply_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p): which supplier (S...) has delivered which part (P...)."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return li.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("s"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("p"))


def supply_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    a = cut(supply_arcs(spark, sf_dir))
    e = a.select(F.col("s").alias("src"), F.col("p").alias("dst"), F.concat_ws("-", "s", "p").alias("edge_id"))
    return PropertyGraph.from_edges(e, check=False)


def geo_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Region, nation, customer: a tree for each region."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    up = n.select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("dst"))
    down = c.select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("src"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("dst"))
    return PropertyGraph.from_edges(up.unionByName(down).withColumn("edge_id", F.concat_ws("-", "src", "dst")), check=False)


def order_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, edge_id, src, dst, weight, directed): each customer's orders in the order of date and key."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey").withColumn("nxt", F.lead("o_orderkey").over(w)).where("nxt is not null")
    pad = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    return o.select(F.col("o_custkey").cast("string").alias("graph_id"), pad("o_orderkey").alias("edge_id"), pad("o_orderkey").alias("src"), pad("nxt").alias("dst"), F.lit(0.0).alias("weight"), F.lit(True).alias("directed"))


def session_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Event type to the next event type of the same user, weights are counts."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type").withColumn("nxt", F.lead("event_type").over(w)).where("nxt is not null")
    a = e.groupBy(F.col("event_type").alias("src"), F.col("nxt").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return PropertyGraph.from_edges(cut(a.withColumn("edge_id", F.concat_ws(">", "src", "dst"))), check=False, directed=True, weighted=True, loops=True)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, a): each user's event values in cents, by time."""
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", F.round(F.col("value") * 100).alias("v")).alias("s"))
    return e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("a"))


def feature_cells(spark: SparkSession, sf_dir: str, cols: int | None = None) -> DataFrame:
    """(i, j, v) of the embeddings."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("i"), F.posexplode("embedding").alias("j", "v"))
    e = e.select("i", "j", F.col("v").cast("double").alias("v"))
    return e if cols is None else e.where(F.col("j") < cols)


def part_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, value): parts counted by size (1 to 50) and band of retail price (0 to 19)."""
    p = table(spark, sf_dir, "part").select((F.col("p_size") - 1).cast("int").alias("x"), F.pmod(F.floor("p_retailprice"), F.lit(20)).cast("int").alias("y"))
    cells = spark.range(1000).select(F.pmod("id", F.lit(50)).cast("int").alias("x"), F.floor(F.col("id") / 50).cast("int").alias("y"))
    return cells.join(p.groupBy("x", "y").agg(F.count(F.lit(1)).cast("int").alias("value")), ["x", "y"], "left").na.fill(0)
