"""Kernels over frames of many instances: one task per instance, keyed by graph_id.

An edge frame holds (graph_id, edge_id, src, dst, weight, directed); a vertex
frame (graph_id, id) adds isolated vertices.  Instances run in parallel; one
instance has to fit into one executor's memory.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import Scratch, cut, release
from .errors import CycleError, GraphInputError, TraversalStopped
from .graph import PropertyGraph
from .kernels import flows, tours, walks


def frames(g: PropertyGraph, graph_id: str = "g") -> tuple[DataFrame, DataFrame]:
    """One graph as frames of one instance."""
    return g.edges.withColumn("graph_id", F.lit(graph_id)), g.vertices.select(F.lit(graph_id).alias("graph_id"), "id")


def _rows(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    e = edges.select("graph_id", "edge_id", "src", "dst", F.col("weight").cast("double").alias("weight"), "directed")
    v = vertices.select("graph_id", F.lit(None).cast("string").alias("edge_id"), F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("boolean").alias("directed"))
    return e.unionByName(v)


def _kernel(edges: DataFrame, vertices: DataFrame, of: Callable, schema: str) -> DataFrame:
    """Rows that of(graph_id, vertices, edges) gives for every graph.

    Graphs lie sorted in their partitions and are taken off as they come, so
    thousands of small ones cost one Arrow call and not one each.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    rows = _rows(edges, vertices).repartition("graph_id").sortWithinPartitions("graph_id")

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=names)

    def run(batches):
        gid, vs, es, out = None, set(), [], []

        def flush():
            return of(gid, sorted(vs), sorted(es)) if gid is not None else []

        for b in batches:
            for g, e, s, d, directed in zip(b.graph_id, b.edge_id, b.src, b.dst, b.directed, strict=True):
                if g != gid:
                    out += flush()
                    gid, vs, es = g, set(), []
                vs.add(s)
                if d is not None:
                    vs.add(d)
                    es.append((e, s, d, bool(directed)))
            if out:
                yield frame(out)
                out = []
        out = flush()
        if out:
            yield frame(out)

    return rows.mapInPandas(run, schema)


def depth_first(
    edges: DataFrame,
    vertices: DataFrame,
    start: str | None = None,
    full: bool = False,
    max_depth: int = -1,
    keep: Callable[[str], bool] | None = None,
    on_visit: Callable[[str, int], None] | None = None,
    on_exit: Callable[[str, int], None] | None = None,
    cancelled: Callable[[], bool] | None = None,
) -> DataFrame:
    """(graph_id, id, pre_ord, finish_ord, depth, parent, skipped); neighbours by edge ID, start None: a forest.

    The hooks run beside the kernel; where they stop it, or it is cancelled,
    the vertices finished so far are the rows.
    """
    if max_depth < -1:
        raise GraphInputError("depth limit")

    def of(gid, vs, es):
        try:
            pre, post, depth, parent, skipped = walks.dfs(walks.arcs_of(vs, es), start, full or start is None, max_depth, keep, on_visit, on_exit, cancelled)
        except TraversalStopped as e:
            pre, post, depth, parent, skipped = e.partial
        rank = {v: i for i, v in enumerate(pre)}
        return [(gid, v, rank[v], i, depth[v], parent[v], skipped) for i, v in enumerate(post)]

    return _kernel(edges, vertices, of, "graph_id string, id string, pre_ord long, finish_ord long, depth int, parent string, skipped long")


def detect_cycles(edges: DataFrame, vertices: DataFrame, directed: bool = False, loops: bool = True) -> DataFrame:
    """(graph_id, cycle): canonical witnesses of back edges; a graph without cycles has no row."""

    def of(gid, vs, es):
        return [(gid, c) for c in walks.cycles(vs, es, directed, loops)]

    return _kernel(edges, vertices, of, "graph_id string, cycle array<string>")


def has_cycle(g: PropertyGraph) -> bool:
    return detect_cycles(*frames(g), g.caps.directed, g.caps.loops).limit(1).count() > 0


def topological_sort(edges: DataFrame, vertices: DataFrame, strict: bool = True) -> DataFrame:
    """(graph_id, ord, id): reverse finish order; a cycle raises, or, not strict, gives one row with ord -1."""

    def of(gid, vs, es):
        try:
            order = walks.topological_order(vs, es)
        except CycleError as e:
            if strict:
                raise
            return [(gid, -1, str(e))]
        return [(gid, i, v) for i, v in enumerate(order)]

    return _kernel(edges, vertices, of, "graph_id string, ord long, id string")


def topological_levels(arcs: DataFrame, vertices: DataFrame, cancelled: Callable[[], bool] | None = None) -> DataFrame:
    """(id, level): rounds in which vertices lose their last incoming arc; for DAGs too large for one task.

    cancelled is asked before every round and ends them by an error.
    """
    own = Scratch()
    left = own.cut(arcs.select("src", "dst").where("src <> dst").distinct())
    nodes = vertices.select("id")
    states: list[DataFrame] = []
    levels: list[DataFrame] = []
    while True:
        if cancelled and cancelled():
            raise TraversalStopped("cancelled", levels)
        busy = left.select(F.col("dst").alias("id")).distinct().withColumn("busy", F.lit(True))
        state = cut(nodes.join(busy, "id", "left"))
        states.append(state)
        n = state.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("busy").isNull()).alias("free")).first()
        if n["all"] and not n["free"]:
            raise CycleError("cycle")
        free = state.where("busy is null").select("id")
        levels.append(free.withColumn("level", F.lit(len(levels))))
        if n["all"] == n["free"]:
            break
        nodes = state.where("busy").select("id")
        left = own.cut(left.join(free.withColumnRenamed("id", "src"), "src", "left_anti"))
        own.keep(left)
    own.keep()
    out = cut(reduce(DataFrame.unionByName, levels))
    release(*states)
    return out


_FLOW = "graph_id string, value double, augmentations long, capped boolean, source_side array<string>, sink_side array<string>, residual array<struct<src: string, dst: string, capacity: double>>, events array<struct<n: long, path: array<string>, flow: double>>"


def max_flow(
    edges: DataFrame, vertices: DataFrame, source: str, sink: str, algorithm: str = "dinic", eps: float = 1e-9, level_rebuild: int = 0, max_augmentations: int = 0, observe: bool = False, cancelled: Callable[[], bool] | None = None
) -> DataFrame:
    """One row per network: value, cut sides, residual arcs and, if observed, every augmentation; weights are capacities."""
    if algorithm not in flows.ALGORITHMS:
        raise GraphInputError(algorithm)

    def of(p: pd.DataFrame) -> pd.DataFrame:
        e = p[p.dst.notna()]
        vs = sorted(set(p.src) | set(e.dst))
        events: list[dict] = []
        seen = (lambda n, path, f: events.append({"n": n, "path": path, "flow": f})) if observe else None
        r = flows.max_flow(vs, list(zip(e.src, e.dst, e.weight, e.directed.astype(bool), strict=True)), source, sink, algorithm, eps, level_rebuild, max_augmentations, seen, cancelled)
        residual = [dict(zip(("src", "dst", "capacity"), x, strict=True)) for x in r["residual"]]
        return pd.DataFrame([(p.graph_id.iloc[0], r["value"], r["augmentations"], r["capped"], r["source_side"], r["sink_side"], residual, events)], columns=["graph_id", "value", "augmentations", "capped", "source_side", "sink_side", "residual", "events"])

    return _rows(edges, vertices).groupBy("graph_id").applyInPandas(of, _FLOW)


def residual_graph(flow: DataFrame, graph_id: str = "g") -> PropertyGraph:
    """What one network's flow leaves of its capacities, as a directed weighted graph."""
    arcs = flow.where(F.col("graph_id") == graph_id).select(F.explode("residual").alias("r")).select("r.src", "r.dst", F.col("r.capacity").alias("weight"))
    sides = flow.where(F.col("graph_id") == graph_id).select(F.explode(F.concat("source_side", "sink_side")).alias("id"))
    return PropertyGraph.from_edges(arcs, sides, check=False, directed=True, weighted=True)


def capacity_matrix(g: PropertyGraph, eps: float = 1e-9) -> DataFrame:
    """(src, dst, capacity): parallel arcs summed, undirected edges both ways, loops left out."""
    return g.arcs().where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("capacity")).where(F.col("capacity") > eps)


_TOUR = "instance_id string, tour array<int>, ids array<string>, cost double, optimal boolean, algorithm string"


def solve_tours(instances: DataFrame, **options) -> DataFrame:
    """Tours of instances (instance_id, ids, dist as an array of rows); the options are those of ``tours.solve``."""

    def of(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        for gid, ids, dist in zip(p.instance_id, p.ids, p.dist, strict=True):
            r = tours.solve(np.array([list(x) for x in dist], float), **options)
            out.append((gid, r["tour"], [ids[i] for i in r["tour"]], r["cost"], r["optimal"], r["algorithm"]))
        return pd.DataFrame(out, columns=["instance_id", "tour", "ids", "cost", "optimal", "algorithm"])

    return instances.groupBy("instance_id").applyInPandas(of, _TOUR)


def solve_graph_tour(g: PropertyGraph, **options) -> DataFrame:
    """A tour over a graph's vertices; missing edges are +inf, so the closure is needed unless it is complete."""
    if g.caps.mixed:
        raise GraphInputError("mixed directions")
    symmetric = options.get("symmetric", not g.caps.directed)
    a = g.arcs().where("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("w"))

    def of(p: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(p.src))
        at = {v: i for i, v in enumerate(ids)}
        d = np.full((len(ids), len(ids)), np.inf)
        np.fill_diagonal(d, 0)
        for s, t, w in zip(p.src, p.dst, p.w, strict=True):
            if t is not None:
                d[at[s], at[t]] = w
        r = tours.solve(d, **{**options, "symmetric": symmetric})
        return pd.DataFrame([("g", r["tour"], [ids[i] for i in r["tour"]], r["cost"], r["optimal"], r["algorithm"])], columns=["instance_id", "tour", "ids", "cost", "optimal", "algorithm"])

    rows = a.unionByName(g.vertices.select(F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("double").alias("w")))
    return rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(of, _TOUR)


def tour_costs(tours_df: DataFrame, dist: DataFrame) -> DataFrame:
    """(instance_id, cost) of closed tours (instance_id, tour array<int>) over (instance_id, i, j, v), relationally."""
    step = tours_df.select("instance_id", F.posexplode(F.expr("transform(sequence(0, size(tour) - 2), p -> struct(tour[p] as i, tour[p + 1] as j))")).alias("p", "s")).select("instance_id", "s.i", "s.j")
    c = step.join(dist, ["instance_id", "i", "j"], "left").groupBy("instance_id").agg(F.sum(F.coalesce("v", F.lit(float("inf")))).alias("c"))
    return c.select("instance_id", (F.round(F.col("c") * 1e9) / 1e9).alias("cost"))
