"""Hooks, cancellation, exact matching, bounds, accessors and policies."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import alignment, errors, grouped, traverse
from graphloom.operators import matrix as mx
from graphloom.operators.graph import PropertyGraph
from graphloom.operators.kernels import blossoms, flows, tours, walks
from graphloom.plans import iterate
from graphloom.plans.iterate import Scratch, running_sum
from graphloom.sources import generators as gen
from graphloom.streaming.snapshots import SnapshotSink


@pytest.mark.parametrize("seed", range(60))
def test_matching_is_least(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.choice([2, 4, 8, 12, 14]))
    if seed % 2:
        d = np.triu(rng.integers(0, rng.choice([3, 20, 1000]), (n, n)).astype(float), 1)
        d = d + d.T
    else:
        p = rng.random((n, 2))
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    cost = lambda pairs: sum(d[x] for x in pairs)
    got = blossoms.minimum_perfect(d)
    assert sorted(v for p in got for v in p) == list(range(n))
    assert abs(cost(got) - cost(tours.subset_matching(list(range(n)), d))) < 1e-6


@pytest.mark.parametrize("n", [40, 80])
def test_large_matching_has_no_better_exchange(n):
    p = np.random.default_rng(n).random((n, 2))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    pairs = tours.perfect_matching(list(range(n)), d)
    assert sorted(v for x in pairs for v in x) == list(range(n))
    for i, (a, b) in enumerate(pairs):
        for c, e in pairs[:i]:
            assert d[a, b] + d[c, e] <= min(d[a, c] + d[b, e], d[a, e] + d[b, c]) + 1e-9
    tour = tours.christofides(d)
    assert tours.tour_cost(d, tour) <= 1.5 * tours.tour_cost(d, tours.two_opt(d, tour)) + 1e-9


@pytest.mark.parametrize("seed", range(4))
def test_tree_bound_keeps_the_best(seed):
    rng = np.random.default_rng(seed)
    p = rng.random((9, 2))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    best = tours.solve(d, "held_karp")["cost"]
    for bound in ("none", "simple", "one_tree"):
        r = tours.solve(d, "branch_and_bound", bound=bound)
        assert r["optimal"] and abs(r["cost"] - best) < 1e-9
    assert tours.closed([2, 0, 1], 0) == [0, 1, 2, 0]


def queue_events(near, start):
    seen, todo, out = {start}, [(start, 0)], [("enqueue", start, 0)]
    for v, d in todo:
        out += [("dequeue", v, d), ("visit", v, d)]
        for w in sorted(near[v]):
            if w not in seen:
                seen.add(w)
                todo.append((w, d + 1))
                out.append(("enqueue", w, d + 1))
    return out


def test_hooks_come_as_from_a_queue(spark):
    rng = random.Random(2)
    pairs = sorted({tuple(sorted(rng.sample("abcdefgh", 2))) for _ in range(11)})
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    g = PropertyGraph.from_edges(spark.createDataFrame(pairs, "src string, dst string"), multi=True)
    out = []
    hook = lambda k: lambda v, d: out.append((k, v, d))
    traverse.bfs(g, pairs[0][0], on_enqueue=hook("enqueue"), on_dequeue=hook("dequeue"), on_visit=hook("visit"))
    assert out == queue_events(near, pairs[0][0])

    def stop(v, d):
        if d == 1:
            raise ValueError("enough")

    with pytest.raises(errors.TraversalStopped) as e:
        traverse.bfs(g, pairs[0][0], on_visit=stop)
    assert e.value.partial.visited.count() >= 1
    with pytest.raises(errors.TraversalStopped):
        traverse.bfs(g, pairs[0][0], cancelled=lambda: True)


def test_full_traversal_takes_lone_vertices_at_once(spark):
    e = spark.createDataFrame([("m", "n"), ("x", "y")], "src string, dst string")
    v = spark.createDataFrame([(f"a{i:03d}",) for i in range(40)] + [("z",)], "id string")
    g = PropertyGraph.from_edges(e, v)
    got = [(r.id, r.depth) for r in traverse.bfs(g, "x", full=True).visited.orderBy("ord").collect()]
    assert got == [("x", 0), ("y", 1), *((f"a{i:03d}", 0) for i in range(40)), ("m", 0), ("n", 1), ("z", 0)]


def test_depth_first_hooks_and_cancellation(spark):
    arcs = walks.arcs_of(["a", "b", "c"], [("e1", "a", "b", True), ("e2", "b", "c", True)])
    out = []
    walks.dfs(arcs, "a", on_visit=lambda v, d: out.append((v, d)), on_exit=lambda v, d: out.append((v, -d)))
    assert out == [("a", 0), ("b", 1), ("c", 2), ("c", -2), ("b", -1), ("a", 0)]
    with pytest.raises(errors.TraversalStopped) as e:
        walks.dfs(arcs, "a", cancelled=lambda: len(out) > 0)
    assert e.value.partial[1] == []
    with pytest.raises(errors.TraversalStopped):
        walks.topological_order(["a", "b"], [("e", "a", "b", True)], cancelled=lambda: True)
    edges = spark.createDataFrame([("g", "e1", "a", "b", 0.0, True), ("g", "e2", "b", "c", 0.0, True)], "graph_id string, edge_id string, src string, dst string, weight double, directed boolean")
    nodes = spark.createDataFrame([("g", "a")], "graph_id string, id string")

    def refuse(v, d):
        if v == "b":
            raise ValueError(v)

    assert [r.id for r in grouped.depth_first(edges, nodes, start="a", on_exit=refuse).collect()] == ["c"]
    with pytest.raises(errors.TraversalStopped):
        grouped.topological_levels(edges, nodes.select("id"), cancelled=lambda: True)


def test_many_small_graphs_cross_batches(spark):
    n = 3000
    rows = [(f"g{i:05d}", f"e{j}", f"v{j}", f"v{j + 1}", 0.0, True) for i in range(n) for j in range(4)]
    e = spark.createDataFrame(rows, "graph_id string, edge_id string, src string, dst string, weight double, directed boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    got = grouped.topological_sort(e, spark.createDataFrame([], "graph_id string, id string")).groupBy("graph_id").agg(F.concat_ws(",", F.expr("transform(array_sort(collect_list(struct(ord, id))), x -> x.id)")).alias("o"))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.o for r in got.collect()} == {"v0,v1,v2,v3,v4"} and got.count() == n


def test_levels_are_longest_ways(spark):
    rng = random.Random(7)
    pairs = [(f"v{a}", f"v{b}") for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.25]
    level = {f"v{i}": 0 for i in range(14)}
    for a, b in sorted(pairs, key=lambda p: int(p[0][1:])):
        level[b] = max(level[b], level[a] + 1)
    arcs = spark.createDataFrame([*pairs, ("v1", "v1")], "src string, dst string")
    nodes = spark.createDataFrame([(v,) for v in level], "id string")
    assert {r.id: r.level for r in grouped.topological_levels(arcs, nodes).collect()} == level
    assert grouped.topological_levels(arcs.limit(0), nodes.limit(0)).collect() == []
    with pytest.raises(errors.CycleError):
        grouped.topological_levels(spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"), spark.createDataFrame([("a",), ("b",)], "id string"))


def test_flow_observer_and_residual(spark):
    g = PropertyGraph.from_edges(spark.createDataFrame([("s", "a", 3.0), ("a", "t", 2.0), ("s", "t", 1.0)], "src string, dst string, weight double"), directed=True, weighted=True)
    r = grouped.max_flow(*grouped.frames(g), source="s", sink="t", algorithm="edmonds_karp", observe=True)
    one = r.first()
    assert one.value == 3.0 and sorted((tuple(e.path), e.flow) for e in one.events) == [(("s", "a", "t"), 2.0), (("s", "t"), 1.0)]
    left = {(x.src, x.dst): x.weight for x in grouped.residual_graph(r).edges.collect()}
    assert left == {("s", "a"): 1.0, ("a", "s"): 2.0, ("t", "a"): 2.0, ("t", "s"): 1.0}
    got = flows.max_flow(["s", "t"], [("s", "t", 1.0, True)], "s", "t", cancelled=lambda: True)
    assert got["capped"] and got["value"] == 0.0


def test_matrix_accessors_and_policy(spark):
    m = mx.Matrix.of(spark, [[1.0, 2.0], [3.0, 4.0]])
    with pytest.raises(errors.NumericPolicyError):
        m.set(0, 0, math.inf)
    assert m.with_policy(True).set(0, 0, math.inf).set(1, 1, math.nan).at(0, 0) == math.inf
    w = m.view(1, 0, 1, 2).set(0, 1, 9.0)
    assert w.at(0, 1) == 9.0 and w.parent.at(1, 1) == 9.0 and m.at(1, 1) == 4.0
    g = PropertyGraph.from_edges(spark.createDataFrame([("e1", "a", "b"), ("e2", "b", "c")], "edge_id string, src string, dst string"), directed=True)
    b = mx.incidence(g, mx.MatrixOptions(directed=True))
    assert [(r.j, r.v) for r in b.vertex_incidence("b").orderBy("j").collect()] == [(0, 1.0), (1, -1.0)]
    assert b.edge_endpoints(1) == ("b", "c") and (b.vertex_count(), b.edge_count()) == (3, 2)
    for bad in (lambda: b.vertex_incidence("z"), lambda: mx.need(None), lambda: b.edge_endpoints(7), lambda: mx.need_length([1], 2)):
        with pytest.raises(errors.EngineError):
            bad()


def test_alignment_of_one_pair():
    o = alignment.Options(path=True, memory="full", penalty=0.5)
    assert alignment.dtw([1, 2, 3], [1, 3, 3, 4], o) == (2.5, [(0, 0), (1, 1), (2, 2), (2, 3)])
    for bad in (alignment.Options(path=True), alignment.Options(memory="some"), alignment.Options(window=-1)):
        with pytest.raises(errors.NumericPolicyError):
            alignment.dtw([1], [1], bad)


def test_hexagrams_and_extension(spark):
    count = lambda g: (g.vertex_count(), g.edge_count())
    assert [count(gen.build(spark, gen.hexagram(k))) for k in gen.HEXAGRAMS] == [(6, 12), (8, 12), (13, 30), (13, 36)]
    g = gen.extend(gen.build(spark, gen.path(3), caps={"multi": False}), gen.letters("I"), gen.digit(1))
    assert g.vertex_count() > 3 and g.edges.select("edge_id").distinct().count() == g.edge_count()
    a, b = (gen.Options(rand=random.Random(4)).seed for _ in range(2))
    assert a == b != gen.Options().seed


@pytest.mark.parametrize("few", [10**6, 0])
def test_numbering_by_one_task_or_by_ranges(spark, monkeypatch, few):
    monkeypatch.setattr(iterate, "FEW", few)
    d = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), F.lit("x").alias("v")).repartition(5)
    assert {r.k: r.ord for r in iterate.numbered(d, "k", start=3).collect()} == {k: k + 3 for k in range(500)}
    assert iterate.numbered(d.limit(0), "k").collect() == []


def test_running_sums_and_scratch(spark):
    d = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("x"))
    got = {r.k: r.before for r in running_sum(d, "k", "x").collect()}
    total = 0.0
    for k in range(1000):
        assert got[k] == total
        total += k % 7
    own = Scratch()
    a, b = own.cut(d), own.cut(d.limit(3))
    own.keep(b)
    assert b.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
        spark.read.parquet(a._graphloom_path).count()


def test_snapshots_go_on_after_a_restart(spark, tmp_path):
    batch = lambda *rows: spark.createDataFrame(list(rows), "src string, dst string, weight double")
    root = f"{tmp_path}/snapshots"
    SnapshotSink(root=root)(batch(("a", "b", 1.0)), 0)
    again = SnapshotSink(root=root)
    again(batch(("a", "b", 5.0)), 0)  # a batch that was done already
    again(batch(("a", "b", 2.0), ("b", "c", 1.0)), 1)
    again(batch(("c", "d", 1.0)), 2)
    assert {(r.src, r.dst, r.weight) for r in SnapshotSink(root=root).graph(spark).edges.collect()} == {("a", "b", 3.0), ("b", "c", 1.0), ("c", "d", 1.0)}
    assert SnapshotSink(root=root).epochs(spark) == [1, 2]
    assert SnapshotSink(root=f"{tmp_path}/none").graph(spark).edge_count() == 0


def test_windowed_edges_under_a_watermark(spark, tmp_path):
    from graphloom.streaming.snapshots import windowed_edges

    rows = [("2024-01-01 00:10:00", "a", "b"), ("2024-01-01 00:50:00", "a", "b"), ("2024-01-01 01:10:00", "a", "b"), ("2024-01-01 05:00:00", "z", "z")]
    spark.createDataFrame(rows, "ts string, src string, dst string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("ts timestamp, src string, dst string").parquet(f"{tmp_path}/in")
    q = windowed_edges(s).writeStream.format("memory").queryName("edges_by_hour").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(str(r.start), r.src, r.weight) for r in spark.table("edges_by_hour").collect()}
    assert got >= {("2024-01-01 00:00:00", "a", 2), ("2024-01-01 01:00:00", "a", 1)}
