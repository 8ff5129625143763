"""Graphs, traversals, trees, matrices, alignment and lattices on small fixtures."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import alignment, errors, grouped, mst, traverse
from graphloom.operators import matrix as mx
from graphloom.operators.graph import PropertyGraph
from graphloom.operators.grid import Grid
from graphloom.operators.kernels import dense, flows, tours, walks
from graphloom.sources import generators as gen


def edges(spark, rows, **caps):
    return PropertyGraph.from_edges(spark.createDataFrame(rows, "edge_id string, src string, dst string, weight double"), **caps)


# -- graphs ---------------------------------------------------------------------
def test_capabilities(spark):
    d = spark.createDataFrame([("a", "a", 1.0)], "src string, dst string, weight double")
    with pytest.raises(errors.GraphInputError):
        PropertyGraph.from_edges(d, weighted=True)
    with pytest.raises(errors.GraphInputError):
        PropertyGraph.from_edges(d, loops=True)
    g = PropertyGraph.from_edges(d, loops=True, weighted=True)
    assert [tuple(r) for r in g.degrees().collect()] == [("a", 0, 0, 2)]
    both = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    assert PropertyGraph.from_edges(both, directed=True).edge_count() == 2
    with pytest.raises(errors.GraphInputError):
        PropertyGraph.from_edges(both)


def test_changes(spark):
    g = PropertyGraph.empty(spark, multi=True).add_edge("a", "b").add_edge("b", "c").add_edge("b", "c", edge_id="e7").add_edge("c", "d")
    assert sorted(r.edge_id for r in g.edges.collect()) == ["e1", "e2", "e7", "e8"]
    assert g.has_edge("b", "a") and not g.has_edge("a", "c")
    assert [r.neighbor for r in g.neighbor_ids("b").collect()] == ["a", "c"]
    assert [r.edge_id for r in g.neighbors("c").collect()] == ["e2", "e7", "e8"]
    h, n = g.remove_edges_where(F.col("src") == "b")
    assert n == 2 and h.edge_count() == 2 and h.vertex_count() == 4
    assert g.remove_vertex("c").edge_count() == 1
    assert [r.edge_id for r in g.set_edge_id("e1", "x1").named_edges().collect()] == ["x1"]
    with pytest.raises(errors.NotFoundError):
        g.remove_edge("none")
    assert {r.id: r.edge_ids for r in g.add_vertex("z").adjacency_list().collect()}["z"] == []


# -- traversal --------------------------------------------------------------------
def random_graph(rng, n, m):
    return [(f"e{k}", str(rng.randrange(n)), str(rng.randrange(n)), float(rng.randrange(1, 9))) for k in range(m)]


def test_bfs_order_and_skips(spark):
    rng = random.Random(3)
    rows = [r for r in random_graph(rng, 10, 16)]
    g = edges(spark, [(a, b, c, 0.0) for a, b, c, _ in rows], multi=True, loops=True)
    near = {}
    for _, a, b, _ in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    start = rows[0][1]
    order, depth, parent, skipped, todo = [start], {start: 0}, {start: None}, 0, [start]
    for v in todo:
        if depth[v] == 3:
            continue
        for w in sorted(near[v]):
            if w == "3":
                skipped += 1
            elif w not in depth:
                depth[w], parent[w] = depth[v] + 1, v
                order.append(w)
                todo.append(w)
    r = traverse.bfs(g, start, max_depth=3, keep=F.col("nbr") != "3")
    assert [(x.id, x.depth, x.parent) for x in r.visited.orderBy("ord").collect()] == [(v, depth[v], parent[v]) for v in order]
    assert r.skipped == skipped


def test_components_of_a_long_chain(spark):
    g = gen.build(spark, gen.path(200), gen.letters("HI"))
    got = {r.component: r.members for r in traverse.component_members(g).collect()}
    assert len(got) == 3 and sorted(got["0"]) == sorted(map(str, range(200)))


def test_shortest_paths(spark):
    rng = random.Random(4)
    rows = random_graph(rng, 9, 20)
    g = edges(spark, rows, directed=True, weighted=True, multi=True, loops=True)
    ids = sorted({x for _, a, b, _ in rows for x in (a, b)})
    dist = {v: math.inf for v in ids}
    dist[ids[0]] = 0.0
    for _ in ids:
        for _, a, b, w in rows:
            dist[b] = min(dist[b], dist[a] + w)
    r = traverse.shortest_paths(g, ids[0], track=True)
    assert {x.id: x.dist for x in r.distances.collect()} == dist
    far = max((v for v in ids if dist[v] < math.inf), key=lambda v: dist[v])
    p = r.path_to(far)
    least = {}
    for _, a, b, w in rows:
        least[a, b] = min(w, least.get((a, b), w))
    assert sum(least[e] for e in itertools.pairwise(p)) == dist[far]
    cut = traverse.shortest_paths(g, ids[0], max_distance=5.0).distances.collect()
    assert {x.id: x.dist for x in cut} == {v: d if d <= 5 else math.inf for v, d in dist.items()}
    with pytest.raises(errors.NumericPolicyError):
        traverse.shortest_paths(edges(spark, [("e", "a", "b", -1.0)], weighted=True), "a")


@pytest.mark.parametrize("seed", range(3))
def test_spanning_forest(spark, seed):
    rng = random.Random(seed)
    rows = [r for r in random_graph(rng, 12, 18)]
    g = edges(spark, rows, weighted=True, multi=True, loops=True)
    up = {}

    def root(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    want = []
    for eid, a, b, _w in sorted(rows, key=lambda r: (r[3], r[0])):
        if root(a) != root(b):
            up[root(a)] = root(b)
            want.append(eid)
    r = mst.minimum_spanning_tree(g, forest=True)
    assert sorted(x.edge_id for x in r.edges.collect()) == sorted(want)
    assert r.components == len({root(v) for _, a, b, _ in rows for v in (a, b)})


def test_depth_first_kernels(spark):
    arcs = walks.arcs_of(["a", "b", "c", "d"], [("e1", "a", "c", True), ("e2", "a", "b", True), ("e3", "b", "c", True)])
    pre, post, depth, parent, _ = walks.dfs(arcs, "a")
    assert pre == ["a", "c", "b"] and post == ["c", "b", "a"] and depth["b"] == 1 and parent["c"] == "a"
    assert walks.topological_order(["a", "b", "c"], [("e1", "c", "a", True), ("e2", "a", "b", True)]) == ["c", "a", "b"]
    with pytest.raises(errors.CycleError):
        walks.topological_order(["a", "b"], [("e1", "a", "b", True), ("e2", "b", "a", True)])
    assert walks.cycles(["a", "b", "c"], [("e1", "a", "b", True), ("e2", "b", "c", True), ("e3", "c", "a", True)], True, True) == [["a", "b", "c", "a"]]
    assert walks.cycles(["a", "b"], [("e1", "a", "b", False), ("e2", "a", "b", False)], False, True) == []
    for s in itertools.product("ab", repeat=5):
        assert walks.least_rotation(list(s)) == min(list(s[i:] + s[:i]) for i in range(5))
    chain = [(f"e{i:05d}", str(i), str(i + 1), True) for i in range(20000)]
    assert len(walks.topological_order([str(i) for i in range(20001)], chain)) == 20001


# -- flows ------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(10))
def test_flow_is_cut(seed):
    rng = random.Random(seed)
    vs = [str(i) for i in range(7)]
    es = [(rng.choice(vs), rng.choice(vs), float(rng.randrange(1, 10)), rng.random() < 0.7) for _ in range(18)]
    values = set()
    for a in flows.ALGORITHMS:
        r = flows.max_flow(vs, es, "0", "6", a)
        s = set(r["source_side"])
        cut = sum(c for x, y, c, d in es if x in s and y not in s or (not d and y in s and x not in s))
        assert abs(cut - r["value"]) < 1e-9
        values.add(r["value"])
    assert len(values) == 1


# -- tours --------------------------------------------------------------------------------
@pytest.mark.parametrize("symmetric", [True, False])
def test_tours(symmetric):
    rng = np.random.default_rng(1)
    d = rng.integers(1, 50, (7, 7)).astype(float)
    d = (d + d.T) / 2 if symmetric else d
    np.fill_diagonal(d, 0)
    best = min(tours.tour_cost(d, [0, *p, 0]) for p in itertools.permutations(range(1, 7)))
    for a in ("held_karp", "branch_and_bound"):
        r = tours.solve(d, a, symmetric=symmetric)
        assert r["cost"] == best and r["optimal"] and r["tour"][0] == 0
    for a in ("two_opt", "three_opt", *(["christofides"] if symmetric else [])):
        r = tours.solve(d, a, symmetric=symmetric)
        assert r["cost"] >= best
    if symmetric:
        assert tours.one_tree_bound(d)[0] <= best + 1e-9


def test_matching_and_euler():
    rng = np.random.default_rng(2)
    d = rng.random((8, 8))
    d = d + d.T
    pairs = tours.perfect_matching(list(range(8)), d)
    cost = sum(d[p] for p in pairs)
    best = min(sum(d[p[i], p[i + 1]] for i in range(0, 8, 2)) for p in itertools.permutations(range(8)))
    assert abs(cost - best) < 1e-12
    assert tours.euler_circuit([[1, 2], [0, 2], [0, 1]], 0) == [0, 1, 2, 0]
    with pytest.raises(errors.GraphInputError):
        tours.euler_circuit([[1], [0]], 0)


# -- matrices ---------------------------------------------------------------------------------
def test_dense_kernels():
    rng = np.random.default_rng(3)
    a = rng.random((6, 6)) + 6 * np.eye(6)
    low, up = dense.lu(a)
    assert np.allclose(low @ up, a) and np.allclose(dense.inverse(a) @ a, np.eye(6))
    q, r = dense.qr(a)
    assert np.allclose(q.T @ r, a) and np.allclose(np.tril(r, -1), 0)
    s = a + a.T
    lam, v = dense.jacobi(s)
    assert np.allclose(s @ v, v * lam, atol=1e-6)
    with pytest.raises(errors.SingularError):
        dense.lu(np.array([[0.0, 1], [1, 0]]))


def test_matrix_frames(spark):
    rng = np.random.default_rng(4)
    a, b = rng.random((4, 3)).round(3), rng.random((3, 5)).round(3)
    m, n = mx.Matrix.of(spark, a.tolist()), mx.Matrix.of(spark, b.tolist())
    assert np.allclose(m.mul(n).toarray(), a @ b)
    assert np.allclose(m.T.toarray(), a.T) and np.allclose(m.add(m).sub(m.scale(0.5)).toarray(), 1.5 * a)
    assert np.allclose(m.covariance()[0].toarray(), np.cov(a.T))
    c = mx.Matrix.of(spark, np.column_stack([a, np.ones(4)]).tolist()).correlation()[0].toarray()
    assert np.allclose(c[:3, :3], np.corrcoef(a.T)) and not c[3].any()
    assert np.allclose(m.center_rows()[0].toarray(), a - a.mean(axis=1, keepdims=True))
    assert np.allclose(m.normalize_rows_l1()[0].toarray(), a / a.sum(axis=1, keepdims=True))
    assert m.all_close(m) and not m.all_close(m.scale(1.1))
    assert np.allclose(m.induced([2, 0, 2], [1]).toarray(), a[[2, 0, 2]][:, [1]])
    with pytest.raises(errors.ShapeError):
        m.mul(m)


def test_distances(spark):
    inf = math.inf
    rows = [[0, 4, 9, inf], [inf, 0, -2, 7], [inf, inf, 0, 3], [1, inf, inf, 0]]
    m = mx.Matrix.of(spark, rows, allow_non_finite=True)
    m = mx.Matrix(m.cells.where("v < double('infinity')"), 4, 4)
    want = dense.floyd_warshall(np.array(rows))
    for most in (10, 0):
        got = np.full((4, 4), inf)
        for r in mx.floyd_warshall(m, most=most).cells.collect():
            got[r.i, r.j] = r.v
        assert np.array_equal(got, want)
    bad = mx.Matrix.of(spark, [[0.0, 1.0], [-2.0, 0.0]])
    for most in (10, 0):
        with pytest.raises(errors.NegativeCycleError):
            mx.floyd_warshall(bad, most=most)


def test_adjacency_policies(spark):
    g = edges(spark, [("e1", "a", "b", 2.0), ("e2", "a", "b", 5.0), ("e3", "b", "c", 0.0), ("e4", "c", "c", 3.0)], weighted=True, multi=True, loops=True)
    cell = lambda a, i, j: next((r.v for r in a.matrix.cells.collect() if (r.i, r.j) == (i, j)), None)
    a = mx.adjacency(g)
    assert cell(a, 0, 1) == 5.0 and cell(a, 1, 0) == 5.0 and a.absent == math.inf
    assert cell(mx.adjacency(g, mx.MatrixOptions(multi=False)), 0, 1) == 2.0
    assert cell(mx.adjacency(g, mx.MatrixOptions(loops=False)), 2, 2) is None
    assert {r.id: r.degree for r in mx.adjacency(g, mx.MatrixOptions(weighted=False)).degree_vector().collect()} == {"a": 1.0, "b": 2.0, "c": 2.0}
    b, _, _ = mx.incidence(g)
    assert b.toarray().sum(axis=0).tolist() == [2.0] * 4


# -- alignment ---------------------------------------------------------------------------------
def test_alignment(spark):
    rng = random.Random(6)
    rows = [(str(k), [float(rng.randrange(9)) for _ in range(rng.randrange(1, 9))], [float(rng.randrange(9)) for _ in range(rng.randrange(1, 9))]) for k in range(25)]

    def brute(a, b, w, p):
        d = [[math.inf] * (len(b) + 1) for _ in range(len(a) + 1)]
        d[0][0] = 0.0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                if w is None or abs(i - j) <= w:
                    d[i][j] = abs(a[i - 1] - b[j - 1]) + min(d[i - 1][j - 1], d[i - 1][j] + p, d[i][j - 1] + p)
        return d[-1][-1]

    df = spark.createDataFrame(rows, "pair_id string, a array<double>, b array<double>")
    for w, p in ((None, 0.0), (2, 0.5), (0, 0.0)):
        want = {k: brute(a, b, w, p) for k, a, b in rows}
        assert {r.pair_id: r.d for r in df.select("pair_id", alignment.distance("a", "b", w, p).alias("d")).collect()} == want
        assert {r.pair_id: r.distance for r in alignment.align(df, window=w, penalty=p).collect()} == want
    for r in alignment.align(df, path=True, penalty=0.5).collect():
        a, b = next((a, b) for k, a, b in rows if k == r.pair_id)
        steps = [(x.i, x.j) for x in r.path]
        assert steps[0] == (0, 0) and steps[-1] == (len(a) - 1, len(b) - 1)
        cost = sum(abs(a[i] - b[j]) for i, j in steps) + 0.5 * sum((y[0] - x[0]) + (y[1] - x[1]) == 1 for x, y in itertools.pairwise(steps))
        assert abs(cost - r.distance) < 1e-9


# -- lattices --------------------------------------------------------------------------------------
def test_grid(spark):
    g = Grid.of(spark, [[1, 1, 0, 2], [0, 0, 0, 2], [3, 0, 0, 0]])
    got = sorted((r.value, [(c.x, c.y) for c in r.cells]) for r in g.connected_components().collect())
    assert got == [(1, [(0, 0), (1, 0)]), (2, [(3, 0), (3, 1)]), (3, [(0, 2)])]
    at = lambda *xy: spark.createDataFrame(list(xy), "x int, y int")
    path, cost = g.expand_island(at((0, 0), (1, 0)), at((3, 0), (3, 1)))
    assert cost == 1 and path == [(1, 0), (2, 0), (3, 0)]
    with pytest.raises(errors.ShapeError):
        Grid.of(spark, [[1], [1, 2]])


# -- generators -------------------------------------------------------------------------------------
def test_shapes(spark):
    count = lambda *s, **k: (lambda g: (g.vertex_count(), g.edge_count()))(gen.build(spark, *s, **k))
    assert count(gen.path(5)) == (5, 4) and count(gen.cycle(5)) == (5, 5) and count(gen.star(5)) == (5, 4)
    assert count(gen.complete(6)) == (6, 15) and count(gen.complete(6), caps={"directed": True}) == (6, 30)
    assert count(gen.platonic_solid("icosahedron")) == (12, 30) and count(gen.platonic_solid("dodecahedron", True)) == (21, 50)
    assert count(gen.random_sparse(9, 1.0)) == (9, 36) and count(gen.random_sparse(9, 0.0)) == (9, 0)
    g = gen.build(spark, gen.random_regular(10, 3))
    assert {r.undirected for r in g.degrees().collect()} == {3}
    with pytest.raises(errors.GraphInputError):
        gen.letters("?")


def test_grouped_instances(spark):
    e = spark.createDataFrame([("g1", "e1", "a", "b", 1.0, True), ("g2", "e1", "x", "y", 2.0, True), ("g2", "e2", "y", "x", 2.0, True)], "graph_id string, edge_id string, src string, dst string, weight double, directed boolean")
    v = spark.createDataFrame([("g1", "z")], "graph_id string, id string")
    got = grouped.topological_sort(e, v, strict=False).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.ord) if r.graph_id == "g1"] == ["z", "a", "b"]
    assert [r.ord for r in got if r.graph_id == "g2"] == [-1]
    assert [r.graph_id for r in grouped.detect_cycles(e, v, directed=True).collect()] == ["g2"]
