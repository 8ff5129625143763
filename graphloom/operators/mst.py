"""Minimum spanning trees and forests by Borůvka rounds on the total order (weight, edge ID)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import components as contract
from ..plans.iterate import cut
from .errors import DisconnectedError, GraphInputError, NotFoundError
from .graph import PropertyGraph

ALGORITHMS = ("kruskal", "prim")


@dataclass
class MSTResult:
    """edges (edge_id, src, dst, weight), the components' roots, and totals."""

    edges: DataFrame
    roots: DataFrame
    components: int
    total_weight: float

    def ordered(self) -> DataFrame:
        return self.edges.orderBy("weight", "edge_id")


def minimum_spanning_tree(g: PropertyGraph, forest: bool = False, algorithm: str = "kruskal", root: str | None = None) -> MSTResult:
    """The one tree (or forest) that (weight, edge ID) makes unique; loops never belong to it.

    Each round every component takes its least outgoing edge and components
    joined by them merge, so at most log2(vertices) rounds are run.  Kruskal
    and Prim pick the same edges under this order; ``root`` is checked and
    becomes the named root of its component under prim.
    """
    if algorithm not in ALGORITHMS:
        raise GraphInputError(f"algorithm {algorithm}")
    n = g.vertices.count()
    if not n:
        raise GraphInputError("an empty graph")
    if g.caps.directed or g.has_directed_edges():
        raise GraphInputError("a directed graph")
    if algorithm == "prim" and not forest and not root:
        raise GraphInputError("prim needs a root")
    if root and not g.has_vertex(root):
        raise NotFoundError(root)
    edges = cut(g.edges.where("src <> dst").select("edge_id", "src", "dst", "weight"))
    label = cut(g.vertices.select("id", F.col("id").alias("component")))
    open_edges = edges.select("edge_id", F.col("src").alias("u"), F.col("dst").alias("v"), "weight")
    taken = edges.select("edge_id").limit(0)
    while True:
        both = open_edges.select(F.explode(F.array(F.col("u"), F.col("v"))).alias("c"), "weight", "edge_id")
        pick = cut(both.groupBy("c").agg(F.min(F.struct("weight", "edge_id")).alias("best")).select(F.col("best.edge_id").alias("edge_id")).distinct())
        if not pick.limit(1).count():
            break
        taken = cut(taken.unionByName(pick))
        merged = open_edges.join(pick, "edge_id", "left_semi")
        to = contract(label.select(F.col("component").alias("id")).distinct(), merged.select("u", "v"))
        to = cut(to.select(F.col("id").alias("old"), F.col("component").alias("new")))
        label = cut(label.join(to, F.col("component") == F.col("old")).select("id", F.col("new").alias("component")))
        a, b = to.select(F.col("old").alias("u"), F.col("new").alias("nu")), to.select(F.col("old").alias("v"), F.col("new").alias("nv"))
        open_edges = cut(open_edges.join(a, "u").join(b, "v").where("nu <> nv").select("edge_id", F.col("nu").alias("u"), F.col("nv").alias("v"), "weight"))
    tree = cut(edges.join(taken, "edge_id", "left_semi"))
    roots = label.select("component").distinct()
    k = roots.count()
    if k > 1 and not forest:
        raise DisconnectedError(f"{k} components")
    if root:
        own = label.where(F.col("id") == root).first()["component"]
        roots = roots.select(F.when(F.col("component") == own, F.lit(root)).otherwise(F.col("component")).alias("component"))
    total = tree.agg(F.sum("weight")).first()[0] or 0.0
    return MSTResult(tree, roots.withColumnRenamed("component", "root"), k, total)


def kruskal(g: PropertyGraph) -> MSTResult:
    return minimum_spanning_tree(g)


def prim(g: PropertyGraph, root: str) -> MSTResult:
    return minimum_spanning_tree(g, algorithm="prim", root=root)


def matrix_mst(coo: DataFrame) -> tuple[float, DataFrame]:
    """Spanning tree of a symmetric matrix (i, j, v), cells above the diagonal; cost rounded to 1e-9."""
    e = coo.where("i < j and v < double('infinity')").select(
        F.concat_ws("-", F.lpad(F.col("i").cast("string"), 12, "0"), F.lpad(F.col("j").cast("string"), 12, "0")).alias("edge_id"), F.col("i").cast("string").alias("src"), F.col("j").cast("string").alias("dst"), F.col("v").alias("weight")
    )
    nodes = coo.select(F.col("i").cast("string").alias("id")).distinct()
    r = minimum_spanning_tree(PropertyGraph.from_edges(e, nodes, check=False, weighted=True, multi=True))
    return round(r.total_weight, 9), r.edges


