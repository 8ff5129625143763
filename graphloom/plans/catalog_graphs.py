"""Further registered queries: graphs, walks, flows, tours, alignment, lattices, generators."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import naming
from ..operators import alignment, grouped, mst, traverse
from ..operators.errors import EngineError
from ..operators.graph import PropertyGraph
from ..operators.grid import Grid
from ..operators.kernels import tours
from ..sources import generators as gen
from ..sources import tables as t
from .catalog import _ARCS, _CELLS, _DTW, _SESSION, query, user_pairs
from .iterate import cut


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _raises(f) -> bool:
    try:
        f()
    except EngineError:
        return True
    return False


def _said(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "op string, value string")


# -- graphs -------------------------------------------------------------------------
@query(f"""WITH {_ARCS}, n AS (SELECT count(*) AS v FROM ids), e AS (SELECT count(*) AS c, count(*) FILTER (WHERE weight > 1000) AS big,
  count(*) FILTER (WHERE src = '07' OR dst = '07') AS seven, 1 AS one FROM arcs)
SELECT s.step, CASE s.step WHEN 'empty' THEN 0 WHEN 'clear' THEN 0 WHEN 'add_vertex' THEN v + 1 WHEN 'add_edge' THEN v + 1 WHEN 'remove_vertex' THEN v - 1 ELSE v END AS vertices,
 CASE s.step WHEN 'empty' THEN 0 WHEN 'clear' THEN 0 WHEN 'clone_empty' THEN 0 WHEN 'add_edge' THEN c + 1 WHEN 'remove_edge' THEN c - one WHEN 'remove_where' THEN c - big WHEN 'remove_vertex' THEN c - seven ELSE c END AS edges
FROM n, e, (VALUES ('empty'), ('built'), ('add_vertex'), ('add_edge'), ('remove_edge'), ('remove_where'), ('remove_vertex'), ('set_id'), ('clear'), ('clone_empty'), ('clone'), ('mixed')) s(step)""")
def graph_changes_trade(spark, sf_dir):
    """Vertices and edges after every kind of change."""
    g = t.trade_graph(spark, sf_dir)
    first = g.ordered_edges().first()["edge_id"]
    m = PropertyGraph.mixed(spark, directed=True, weighted=True).add_vertices(g.vertices).add_edges(g.edges.select("src", "dst", "weight", "edge_id"))
    steps = {
        "empty": PropertyGraph.empty(spark, directed=True), "built": g, "add_vertex": g.add_vertex("99"), "add_edge": g.add_edge("99", "00", 7.0),
        "remove_edge": g.remove_edge(first), "remove_where": g.remove_edges_where(F.col("weight") > 1000)[0], "remove_vertex": g.remove_vertex("07"),
        "set_id": g.set_edge_id(first, "first"), "clear": g.clear(), "clone_empty": g.clone_empty(), "clone": g.clone(), "mixed": m,
    }
    return _union([x.stats().select(F.lit(k).alias("step"), "vertices", "edges") for k, x in steps.items()])


@query(f"""WITH {_ARCS} SELECT * FROM (
SELECT 'has_edge' AS op, 'True' AS value UNION ALL SELECT 'has_no_edge', 'False' UNION ALL SELECT 'has_vertex', 'True' UNION ALL SELECT 'has_no_vertex', 'False'
UNION ALL SELECT 'taken_id', 'True' UNION ALL SELECT 'free_id', 'False' UNION ALL SELECT 'directed', 'True' UNION ALL SELECT 'missing_edge', 'True'
UNION ALL SELECT 'weight', (SELECT CAST(CAST(arg_min(weight, src || '-' || dst) AS BIGINT) AS VARCHAR) FROM arcs)
UNION ALL SELECT 'named', (SELECT CAST(count(*) AS VARCHAR) FROM arcs)
UNION ALL SELECT 'first_edge', (SELECT min(src || '-' || dst) FROM arcs) UNION ALL SELECT 'first_vertex', (SELECT min(id) FROM ids)
UNION ALL SELECT 'mapped', (SELECT CAST(count(*) AS VARCHAR) FROM ids)
UNION ALL SELECT 'caps', 'True True False False False')""")
def lookups_trade(spark, sf_dir):
    g = t.trade_graph(spark, sf_dir)
    c, e = g.caps, g.ordered_edges().first()
    return _said(spark, [
        ("has_edge", g.has_edge(e["src"], e["dst"])), ("has_no_edge", g.has_edge("00", "00")), ("has_vertex", g.has_vertex("03")), ("has_no_vertex", g.has_vertex("77")),
        ("taken_id", _raises(lambda: g.validate_edge_id(e["edge_id"]))), ("free_id", _raises(lambda: g.validate_edge_id("new"))), ("directed", g.has_directed_edges()),
        ("missing_edge", _raises(lambda: g.edge("none"))), ("weight", int(g.edge(e["edge_id"])["weight"])), ("named", g.named_edges().count()),
        ("first_edge", e["edge_id"]), ("first_vertex", g.ordered_vertices().first()["id"]), ("mapped", g.vertices_map().count()),
        ("caps", f"{c.directed} {c.weighted} {c.multi} {c.loops} {c.mixed}"),
    ])


def _mixed_sessions(spark, sf_dir) -> PropertyGraph:
    """Sessions with every edge twice, directed where its weight is even, loops kept."""
    e = t.session_graph(spark, sf_dir).edges.withColumn("directed", F.col("weight") % 2 == 0)
    both = e.withColumn("edge_id", F.concat(F.lit("a:"), "edge_id")).unionByName(e.select(F.concat(F.lit("b:"), "edge_id").alias("edge_id"), "src", "dst", (F.col("weight") + 1).alias("weight"), "directed"))
    return PropertyGraph.from_edges(both, directed=True, weighted=True, loops=True, multi=True, mixed=True)


_MIXED = _SESSION + """, mix AS (SELECT 'a:' || src || '>' || dst AS edge_id, src, dst, weight, weight % 2 = 0 AS directed FROM sess
UNION ALL SELECT 'b:' || src || '>' || dst, src, dst, weight + 1, weight % 2 = 0 FROM sess)"""


@query(f"""WITH {_MIXED}, x AS (SELECT src AS id, true AS o, directed FROM mix UNION ALL SELECT dst, false, directed FROM mix)
SELECT id, count(*) FILTER (WHERE directed AND NOT o) AS in_degree, count(*) FILTER (WHERE directed AND o) AS out_degree, count(*) FILTER (WHERE NOT directed) AS undirected FROM x GROUP BY id""")
def degrees_mixed_sessions(spark, sf_dir):
    """Degrees with parallel edges, loops and both kinds of direction."""
    return _mixed_sessions(spark, sf_dir).degrees()


@query(f"""WITH {_MIXED} SELECT src, dst, weight, edge_id FROM mix UNION ALL SELECT dst, src, weight, edge_id FROM mix WHERE NOT directed AND src <> dst""")
def arcs_mixed_sessions(spark, sf_dir):
    return _mixed_sessions(spark, sf_dir).arcs()


# -- walks --------------------------------------------------------------------------
_TREE = """tree AS (SELECT 'R' || n_regionkey AS p, 'N' || n_nationkey AS c FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer),
b AS (SELECT p AS a, c AS b FROM tree UNION ALL SELECT c, p FROM tree)"""


@query(f"""WITH {_TREE}, w AS (SELECT 'R0' AS id, 0 AS depth, [] AS path UNION ALL SELECT c, 1, [c] FROM tree WHERE p = 'R0'
UNION ALL SELECT y.c, 2, [x.c, y.c] FROM tree x JOIN tree y ON x.c = y.p WHERE x.p = 'R0')
SELECT id, row_number() OVER (ORDER BY depth, path) - 1 AS ord, depth FROM w""")
def bfs_geo_order(spark, sf_dir):
    """The order in which a queue meets what lies under region 0."""
    return traverse.bfs(t.geo_graph(spark, sf_dir), "R0").visited.select("id", "ord", "depth")


@query(f"""WITH RECURSIVE {_TREE}, region AS (SELECT 'C' || c_custkey AS id, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'N' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT DISTINCT 'R' || n_regionkey, n_regionkey FROM nation),
roots AS (SELECT CASE WHEN r = 0 THEN 'R0' ELSE min(id) END AS id FROM region GROUP BY r),
w(id, d) AS (SELECT id, 0 FROM roots UNION SELECT b.b, w.d + 1 FROM w JOIN b ON w.id = b.a WHERE w.d < 4)
SELECT id, CAST(min(d) AS INTEGER) AS depth FROM w GROUP BY id""")
def bfs_geo_full(spark, sf_dir):
    """All regions, one after the other: the others begin at their least vertex."""
    return traverse.bfs(t.geo_graph(spark, sf_dir), "R0", full=True).visited.select("id", "depth")


@query("""WITH n AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 0 AND NOT ('N' || n_nationkey) LIKE 'N1%')
SELECT 0 AS depth, 1::BIGINT AS vertices, (SELECT count(*) FROM nation WHERE n_regionkey = 0 AND ('N' || n_nationkey) LIKE 'N1%') AS skipped
UNION ALL SELECT 1, (SELECT count(*) FROM n), (SELECT count(*) FROM nation WHERE n_regionkey = 0 AND ('N' || n_nationkey) LIKE 'N1%')
UNION ALL SELECT 2, (SELECT count(*) FROM customer WHERE c_nationkey IN (SELECT k FROM n)), (SELECT count(*) FROM nation WHERE n_regionkey = 0 AND ('N' || n_nationkey) LIKE 'N1%')""")
def bfs_geo_filtered(spark, sf_dir):
    """Under region 0 without the nations whose ID begins with N1, and how many were turned away."""
    r = traverse.bfs(t.geo_graph(spark, sf_dir), "R0", max_depth=2, keep=~F.col("nbr").like("N1%"))
    return r.visited.groupBy("depth").agg(F.count(F.lit(1)).alias("vertices")).withColumn("skipped", F.lit(r.skipped).cast("long"))


@query("""WITH n AS (SELECT count(*) AS k FROM nation WHERE n_regionkey = 1) SELECT e.event, n.k + 1 AS times, CASE e.event WHEN 'path' THEN 'R1>N' || (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 1) ELSE 'R1' END AS first
FROM n, (VALUES ('enqueue'), ('dequeue'), ('visit'), ('path')) e(event)""")
def bfs_hooks(spark, sf_dir):
    """Hooks meet every vertex once, the root first; a path leads to a nation."""
    seen: dict[str, list[str]] = {"enqueue": [], "dequeue": [], "visit": []}
    hook = lambda k: lambda v, _d: seen[k].append(v)
    r = traverse.bfs(t.geo_graph(spark, sf_dir), "R1", max_depth=1, on_enqueue=hook("enqueue"), on_dequeue=hook("dequeue"), on_visit=hook("visit"))
    n = t.table(spark, sf_dir, "nation").where("n_regionkey = 1").agg(F.min("n_nationkey")).first()[0]
    rows = [(k, len(v), v[0]) for k, v in seen.items()] + [("path", r.visited.count(), ">".join(r.path_to(f"N{n}")))]
    return spark.createDataFrame(rows, "event string, times long, first string")


_FOREST = """f AS (SELECT DISTINCT 'A' || n_regionkey AS id, NULL AS parent, 0 AS depth, 'A' || n_regionkey AS r, '' AS e1, '' AS e2 FROM nation
UNION ALL SELECT 'B' || n_nationkey, 'A' || n_regionkey, 1, 'A' || n_regionkey, 'A' || n_regionkey || '-B' || n_nationkey, '' FROM nation
UNION ALL SELECT 'C' || c_custkey, 'B' || n_nationkey, 2, 'A' || n_regionkey, 'A' || n_regionkey || '-B' || n_nationkey, 'B' || n_nationkey || '-C' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _forest(spark, sf_dir) -> PropertyGraph:
    n, c = t.table(spark, sf_dir, "nation"), t.table(spark, sf_dir, "customer")
    up = n.select(F.concat(F.lit("A"), "n_regionkey").alias("src"), F.concat(F.lit("B"), "n_nationkey").alias("dst"))
    down = c.select(F.concat(F.lit("B"), "c_nationkey").alias("src"), F.concat(F.lit("C"), "c_custkey").alias("dst"))
    return PropertyGraph.from_edges(up.unionByName(down).withColumn("edge_id", F.concat_ws("-", "src", "dst")), check=False, directed=True)


@query(f"""WITH {_FOREST}, s AS (SELECT *, row_number() OVER (ORDER BY r, e1, e2) - 1 AS pre,
  CASE depth WHEN 0 THEN count(*) OVER (PARTITION BY r) WHEN 1 THEN count(*) OVER (PARTITION BY r, e1) ELSE 1 END AS size FROM f)
SELECT id, pre AS pre_ord, pre + size - 1 - depth AS finish_ord, depth, parent FROM s""")
def dfs_forest(spark, sf_dir):
    """Depth first through regions, nations and customers, children by edge ID."""
    return grouped.depth_first(*grouped.frames(_forest(spark, sf_dir))).select("id", "pre_ord", "finish_ord", "depth", "parent")


@query(f"""WITH {_FOREST} SELECT id, depth FROM f WHERE r = 'A2' AND depth < 2 AND id NOT LIKE 'B1%'""")
def dfs_bounded(spark, sf_dir):
    """From one region, one step deep, without some nations."""
    got = grouped.depth_first(*grouped.frames(_forest(spark, sf_dir)), start="A2", max_depth=1, keep=lambda v: not v.startswith("B1"))
    return got.select("id", "depth")


@query("""WITH o AS (SELECT o_custkey AS c, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
l AS (SELECT c, list(id ORDER BY k) AS l FROM o GROUP BY c HAVING count(*) > 1), p AS (SELECT c, l, list_position(l, list_min(l)) AS q FROM l)
SELECT CAST(c AS VARCHAR) AS graph_id, array_to_string(l[q:] || l[:q - 1] || [l[q]], '>') AS cycle FROM p""")
def cycles_rings(spark, sf_dir):
    """Every customer's orders closed to a ring: one cycle, told from its least order."""
    e = cut(t.order_chains(spark, sf_dir))
    ends = e.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    first = e.join(e.select("graph_id", F.col("dst").alias("src")), ["graph_id", "src"], "left_anti").select("graph_id", F.col("src").alias("a"))
    last = e.join(e.select("graph_id", F.col("src").alias("dst")), ["graph_id", "dst"], "left_anti").select("graph_id", F.col("dst").alias("z"))
    back = first.join(last, "graph_id").join(ends, "graph_id").select("graph_id", F.concat(F.lit("z"), "z").alias("edge_id"), F.col("z").alias("src"), F.col("a").alias("dst"), F.lit(0.0).alias("weight"), F.lit(True).alias("directed"))
    v = e.select("graph_id", F.col("src").alias("id"))
    got = grouped.detect_cycles(e.unionByName(back), v, directed=True)
    return got.select("graph_id", F.array_join("cycle", ">").alias("cycle"))


@query(f"""WITH {_SESSION}, loop AS (SELECT count(*) > 0 AS l FROM sess WHERE src = dst)
SELECT 'forest' AS graph, false AS cyclic UNION ALL SELECT 'sessions', l FROM loop UNION ALL SELECT 'ring', true UNION ALL SELECT 'path', false""")
def has_cycle_graphs(spark, sf_dir):
    graphs = {"forest": _forest(spark, sf_dir), "sessions": t.session_graph(spark, sf_dir), "ring": gen.build(spark, gen.cycle(9)), "path": gen.build(spark, gen.path(9))}
    return spark.createDataFrame([(k, grouped.has_cycle(g)) for k, g in graphs.items()], "graph string, cyclic boolean")


_LIMITED = f"""{_ARCS}, near(id, d, h) AS (
  SELECT '00', 0.0::DOUBLE, 0 UNION SELECT id, min(d), h FROM (SELECT arcs.dst AS id, near.d + arcs.weight AS d, near.h + 1 AS h FROM near JOIN arcs ON near.id = arcs.src
  WHERE near.h < 24 AND arcs.weight < WALL AND near.d + arcs.weight <= MOST) GROUP BY id, h),
best AS (SELECT id, min(d) AS dist FROM near GROUP BY id),
par AS (SELECT y.id, x.id AS prev FROM best x JOIN arcs ON x.id = arcs.src AND arcs.weight < WALL JOIN best y ON arcs.dst = y.id AND x.dist + arcs.weight = y.dist
  WHERE y.id <> '00' QUALIFY row_number() OVER (PARTITION BY y.id ORDER BY x.dist, x.id) = 1)"""


@query(f"""WITH RECURSIVE {_LIMITED.replace('WALL', '(SELECT quantile_cont(weight, 0.6) FROM arcs)').replace('MOST', '(SELECT 3 * quantile_cont(weight, 0.2) FROM arcs)')}
SELECT ids.id, coalesce(dist, 'infinity'::DOUBLE) AS dist, prev FROM ids LEFT JOIN best ON ids.id = best.id LEFT JOIN par ON ids.id = par.id""")
def sssp_limits_trade(spark, sf_dir):
    """Distances and parents with a cutoff and a wall that bite: both are quantiles of the weights."""
    g = t.trade_graph(spark, sf_dir)
    wall, low = g.edges.agg(F.percentile("weight", 0.6), F.percentile("weight", 0.2)).first()
    r = traverse.shortest_paths(g, "00", track=True, max_distance=3 * low, wall=wall)
    return r.distances.join(r.parents, "id")


@query(f"""WITH RECURSIVE {_LIMITED.replace('WALL', "'infinity'::DOUBLE").replace('MOST', "'infinity'::DOUBLE")},
walk(goal, now, path) AS (SELECT id, id, id FROM best UNION ALL SELECT walk.goal, par.prev, par.prev || '>' || walk.path FROM walk JOIN par ON walk.now = par.id)
SELECT '03' AS goal, walk.path, best.dist, true AS reachable, false AS cyclic FROM walk JOIN best ON walk.goal = best.id WHERE walk.now = '00' AND goal = '03'""")
def shortest_path_parts_trade(spark, sf_dir):
    """A way and its length, by the result's own calls."""
    r = traverse.shortest_paths(t.trade_graph(spark, sf_dir), "00", track=True)
    row = ("03", ">".join(r.path_to("03")), r.distance_to("03"), r.has_path_to("03"), len(set(r.path_to("03"))) < len(r.path_to("03")))
    return spark.createDataFrame([row], "goal string, path string, dist double, reachable boolean, cyclic boolean")


# -- trees, flows, tours ----------------------------------------------------------------
@query("""WITH w AS (SELECT p_partkey AS k, p_size AS s FROM part) SELECT a.algorithm, count(*) - 1 AS edges, CAST(sum(s) - min(s) FILTER (WHERE k = 1) AS DOUBLE) AS total, 1::BIGINT AS components
FROM w, (VALUES ('kruskal'), ('prim')) a(algorithm) GROUP BY a.algorithm""")
def mst_star_parts(spark, sf_dir):
    """A wheel of parts whose spokes cost the part's size and whose rim costs more: the tree is all spokes."""
    p = t.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("w"))
    hub = F.lit("1")
    spokes = p.where("p_partkey <> 1").select(hub.alias("src"), F.col("p_partkey").cast("string").alias("dst"), F.col("w").alias("weight"))
    rim = p.where("p_partkey > 2").select((F.col("p_partkey") - 1).cast("string").alias("src"), F.col("p_partkey").cast("string").alias("dst"), F.lit(100.0).alias("weight"))
    e = spokes.unionByName(rim).withColumn("edge_id", F.concat_ws("-", "src", "dst"))
    g = PropertyGraph.from_edges(cut(e), check=False, weighted=True)
    out = []
    for name, r in (("kruskal", mst.kruskal(g)), ("prim", mst.prim(g, "1"))):
        out.append((name, r.ordered().count(), r.total_weight, r.components))
    return spark.createDataFrame(out, "algorithm string, edges long, total double, components long")


_REGIONS = """flow AS (SELECT c.n_regionkey AS a, s.n_regionkey AS b, CAST(CAST(sum(l_quantity) AS BIGINT) AS DOUBLE) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation c ON c_nationkey = c.n_nationkey JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY 1, 2),
cuts AS (SELECT 1 + 2 * m AS side FROM (SELECT unnest(generate_series(0, 7)) AS m)),
least AS (SELECT min(v) AS v FROM (SELECT side, sum(CASE WHEN (side >> a) & 1 = 1 AND (side >> b) & 1 = 0 THEN w ELSE 0 END) AS v FROM cuts, flow WHERE a <> b GROUP BY side))"""


@query(f"""WITH {_REGIONS} SELECT algorithm, v AS value, v AS cut, v AS observed, 0.0::DOUBLE AS left_over FROM least, (VALUES ('dinic'), ('edmonds_karp'), ('ford_fulkerson')) x(algorithm)""")
def max_flow_regions(spark, sf_dir):
    """Flow from region 0 to region 4 by each algorithm: its value, the cut found, what was seen pushed, and what the residual graph leaves across the cut."""
    n = t.table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("id"), F.col("n_regionkey").cast("string").alias("r"))
    arcs = t.trade_arcs(spark, sf_dir)
    a = arcs.join(n.select(F.col("id").alias("src"), F.col("r").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("r").alias("b")), "dst").where("a <> b")
    e = cut(a.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")).withColumn("edge_id", F.concat_ws("-", "src", "dst")))
    g = PropertyGraph.from_edges(e, check=False, directed=True, weighted=True)
    out = []
    for name in ("dinic", "edmonds_karp", "ford_fulkerson"):
        r = cut(grouped.max_flow(*grouped.frames(g), source="0", sink="4", algorithm=name, observe=True, level_rebuild=2 if name == "dinic" else 0))
        side = r.select(F.explode("source_side").alias("id"))
        across = lambda h, side=side: h.edges.join(side.select(F.col("id").alias("src")), "src", "left_semi").join(side.select(F.col("id").alias("dst")), "dst", "left_anti").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("s"))
        one = r.select(F.lit(name).alias("algorithm"), "value", F.expr("aggregate(events, 0D, (s, x) -> s + x.flow)").alias("observed"))
        out.append(one.crossJoin(across(g).withColumnRenamed("s", "cut")).crossJoin(across(grouped.residual_graph(r)).withColumnRenamed("s", "left_over")))  # one row each
    return _union(out).select("algorithm", "value", "cut", "observed", "left_over")


def _line(spark, sf_dir) -> DataFrame:
    """(instance_id, ids, dist): each region's nations on a line, at their numbers of customers."""
    n = t.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    c = t.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    p = n.join(c, "n_nationkey", "left").na.fill(0.0)
    ps = p.groupBy(F.col("n_regionkey").cast("string").alias("instance_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "x"))).alias("p"))
    return ps.select("instance_id", F.expr("transform(p, q -> string(q.n_nationkey))").alias("ids"), F.expr("transform(p, a -> transform(p, b -> abs(a.x - b.x)))").alias("dist"))


_EXACT = (("held_karp", "simple"), ("branch_and_bound", "none"), ("branch_and_bound", "simple"), ("branch_and_bound", "one_tree"), ("auto", "simple"))


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS x FROM customer GROUP BY 1), p AS (SELECT n_regionkey AS r, coalesce(x, 0) AS x FROM nation LEFT JOIN c ON n_nationkey = k)
SELECT CAST(r AS VARCHAR) AS instance_id, method, CAST(2 * (max(x) - min(x)) AS DOUBLE) AS cost, true AS optimal, true AS valid
FROM p, (VALUES ('held_karp simple'), ('branch_and_bound none'), ('branch_and_bound simple'), ('branch_and_bound one_tree'), ('auto simple')) m(method) GROUP BY r, method""")
def tours_exact_line(spark, sf_dir):
    """Exact tours of points on a line go to both ends and back."""
    inst = cut(_line(spark, sf_dir))
    out = []
    for algorithm, bound in _EXACT:
        r = grouped.solve_tours(inst, algorithm=algorithm, bound=bound)
        ok = (F.size(F.array_distinct("tour")) == F.size("tour") - 1) & (F.element_at("tour", 1) == 0) & (F.element_at("tour", -1) == 0)
        out.append(r.select("instance_id", F.lit(f"{algorithm} {bound}").alias("method"), "cost", "optimal", ok.alias("valid")))
    return _union(out)


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS instance_id, method, true AS within, true AS above FROM (SELECT DISTINCT n_regionkey FROM nation),
(VALUES ('christofides blossom'), ('christofides greedy'), ('two_opt'), ('three_opt')) m(method)""")
def tours_heuristic_line(spark, sf_dir):
    """Heuristic tours of each region cost at least the one-tree bound and, for Christofides with exact matching, at most half as much again as the best."""
    inst = cut(_line(spark, sf_dir))
    best = grouped.solve_tours(inst, algorithm="held_karp").select("instance_id", F.col("cost").alias("best"))
    bound = inst.select("instance_id", F.udf(lambda d: float(tours.one_tree_bound(tours.checked(d))[0]), "double")("dist").alias("low"))  # five rows
    out = []
    for name, kw in (
        ("christofides blossom", {"algorithm": "christofides"}), ("christofides greedy", {"algorithm": "christofides", "matching": "greedy", "three": True}),
        ("two_opt", {"algorithm": "two_opt"}), ("three_opt", {"algorithm": "three_opt"}),
    ):
        r = grouped.solve_tours(inst, **kw).select("instance_id", "cost").join(best, "instance_id").join(bound, "instance_id")
        most = F.col("best") * (1.5 if name != "christofides greedy" else 2.0) + 1e-6
        out.append(r.select("instance_id", F.lit(name).alias("method"), (F.col("cost") <= most).alias("within"), (F.col("cost") >= F.col("low") - 1e-6).alias("above")))
    return _union(out)


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS x FROM customer GROUP BY 1), p AS (SELECT n_nationkey AS k, CAST(coalesce(x, 0) AS DOUBLE) AS x FROM nation LEFT JOIN c ON n_nationkey = k),
s AS (SELECT x, row_number() OVER (ORDER BY x) AS r FROM p WHERE k < 24)
SELECT 'spanning_tree' AS op, (SELECT max(x) - min(x) FROM p) AS value UNION ALL SELECT 'matching', (SELECT sum(CASE WHEN r % 2 = 0 THEN x ELSE -x END) FROM s)
UNION ALL SELECT 'walk', 26.0 UNION ALL SELECT 'shortcut', 26.0 UNION ALL SELECT 'rotated', 7.0 UNION ALL SELECT 'canonical', 1.0 UNION ALL SELECT 'closed', 3.0 UNION ALL SELECT 'refused', 4.0
UNION ALL SELECT 'tour', (SELECT sum(abs(a.x - b.x)) FROM p a JOIN p b ON b.k = (a.k + 1) % 25) UNION ALL SELECT 'auto', (SELECT 2 * (max(x) - min(x)) FROM p WHERE k < 12)""")
def tour_parts_line(spark, sf_dir):
    """The parts of tour algorithms on all nations, on a line at their numbers of customers."""
    n = t.table(spark, sf_dir, "nation").select("n_nationkey")
    c = t.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    x = np.array([r["x"] for r in n.join(c, "n_nationkey", "left").na.fill(0.0).orderBy("n_nationkey").collect()])
    d = np.abs(x[:, None] - x[None, :])
    around = [*range(25), 0]
    adj = [[(v - 1) % 25, (v + 1) % 25] for v in range(25)]
    walk = tours.euler_circuit(adj, 0)
    refused = [lambda: tours.validate_permutation([0, 0], 2), lambda: tours.validate_tour([0, 1, 0], 3, 0), lambda: tours.euler_circuit([[1], [0]], 0), lambda: tours.rotated([0, 1], 5)]
    tours.validate_permutation(around[:-1], 25)
    tours.validate_tour(around, 25, 0)
    rows = [
        ("spanning_tree", tours.prim(d)[0]), ("matching", sum(d[p] for p in tours.perfect_matching(list(range(24)), d))), ("walk", float(len(walk))), ("shortcut", float(len(tours.shortcut(walk, 25, 0)))),
        ("rotated", float(tours.rotated(around, 7)[0])), ("canonical", float(tours.canonical([0, 3, 2, 1, 0])[1])), ("closed", float(tours.closed([3, 0, 2, 1], 3)[0])), ("refused", float(sum(map(_raises, refused)))),
        ("tour", tours.tour_cost(d, around)), ("auto", tours.solve(d[:12, :12], "auto")["cost"]),
    ]
    return spark.createDataFrame([(k, float(v)) for k, v in rows], "op string, value double")


@query("""SELECT * FROM (VALUES ('capped', true), ('uncapped', true), ('epsilon', true), ('rebuilt', true), ('cancelled', true), ('unknown', true)) v(op, ok)""")
def max_flow_options(spark, sf_dir):
    """What bounds on augmentations, tolerance, rebuilding of levels and cancellation do on the trade graph."""
    g = cut(t.trade_graph(spark, sf_dir).edges.where("src <> '05' and dst <> '00'"))
    g = PropertyGraph.from_edges(g, check=False, directed=True, weighted=True)
    a, b = "00", g.edges.agg(F.max("dst")).first()[0]
    run = lambda **kw: grouped.max_flow(*grouped.frames(g), source=a, sink=b, **kw).select("value", "capped", "augmentations", F.size("source_side").alias("side")).first()
    full, one = run(), run(algorithm="ford_fulkerson", max_augmentations=1)
    none, often, stopped = run(eps=1e15), run(level_rebuild=1), run(cancelled=lambda: True)
    rows = [
        ("capped", one["capped"] and one["augmentations"] == 1 and one["side"] == 0 and one["value"] <= full["value"]), ("uncapped", not full["capped"] and full["side"] > 0),
        ("epsilon", none["value"] == 0.0), ("rebuilt", often["value"] == full["value"]), ("cancelled", stopped["capped"] and stopped["value"] == 0.0),
        ("unknown", _raises(lambda: grouped.max_flow(*grouped.frames(g), source=a, sink=b, algorithm="other"))),
    ]
    return spark.createDataFrame([(k, bool(v)) for k, v in rows], "op string, ok boolean")


# -- alignment --------------------------------------------------------------------------
@query(f"""WITH RECURSIVE {_DTW.replace('BAND', '1000000').replace('PENALTY', '0.0')}
SELECT CAST(user_id AS VARCHAR) AS pair_id, one[n + 1] AS distance, true AS path_ok FROM d WHERE s = n + m""")
def dtw_path_costs(spark, sf_dir):
    """Warping distances of neighbouring users, and whether the path found goes from end to end by single steps and costs as much."""
    j = cut(user_pairs(spark, sf_dir).select(F.col("user_id").cast("string").alias("pair_id"), "a", "b"))
    r = alignment.align(j, path=True).select("pair_id", "distance", "path").join(j, "pair_id")
    steps = "forall(sequence(2, size(path)), k -> path[k - 1].i - path[k - 2].i between 0 and 1 and path[k - 1].j - path[k - 2].j between 0 and 1)"
    ends = "path[0].i = 0 and path[0].j = 0 and element_at(path, -1).i = size(a) - 1 and element_at(path, -1).j = size(b) - 1"
    cost = "abs(aggregate(path, 0D, (s, p) -> s + abs(a[p.i] - b[p.j])) - distance) < 1e-6"
    return r.select("pair_id", "distance", F.expr(f"(size(path) = 1 or {steps}) and {ends} and {cost}").alias("path_ok"))


@query("""WITH RECURSIVE v AS (SELECT vec_id AS k, embedding AS e FROM embeddings), pr AS (SELECT x.k, x.e AS a, y.e AS b FROM v x JOIN v y ON y.k = x.k + 1),
c AS (SELECT k, list_transform(range(0, 8), lambda i: list_transform(range(0, 8), lambda j: list_sum(list_transform(range(1, 9), lambda q: (CAST(a[8 * i + q] AS DOUBLE) - CAST(b[8 * j + q] AS DOUBLE)) ** 2)))) AS c FROM pr),
d(k, s, two, one) AS (SELECT k, 1, [0.0::DOUBLE] || list_transform(range(0, 8), lambda i: 'infinity'::DOUBLE), list_transform(range(0, 9), lambda i: 'infinity'::DOUBLE) FROM c
  UNION ALL SELECT d.k, d.s + 1, d.one, list_transform(range(0, 9), lambda i: CASE WHEN i >= 1 AND d.s + 1 - i BETWEEN 1 AND 8 THEN c.c[i][d.s + 1 - i] + least(d.two[i], d.one[i] + 0.5, d.one[i + 1] + 0.5) ELSE 'infinity'::DOUBLE END)
  FROM d JOIN c ON d.k = c.k WHERE d.s < 16)
SELECT CAST(k AS VARCHAR) AS pair_id, round(one[9], 6) AS by_features, round(one[9], 6) AS by_costs, round(one[9], 6) AS last_cell, true AS finite FROM d WHERE s = 16""")
def dtw_feature_rows(spark, sf_dir):
    """Embeddings as eight rows of eight features, each against the next vector's, from the features and from a matrix of costs."""
    e = t.table(spark, sf_dir, "embeddings").select("vec_id", F.expr("transform(sequence(0, 7), i -> transform(slice(embedding, 8 * i + 1, 8), x -> double(x)))").alias("x"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id").select(F.col("vec_id").cast("string").alias("pair_id"), "x", "y")
    cost = F.expr("transform(x, r -> transform(y, q -> aggregate(zip_with(r, q, (a, b) -> (a - b) * (a - b)), 0D, (s, z) -> s + z)))")
    a = alignment.align(p, kind="features", penalty=0.5).select("pair_id", F.round("distance", 6).alias("by_features"), alignment.is_finite(F.col("distance")).alias("finite"))
    b = alignment.align(p.select("pair_id", cost.alias("cost")), kind="cost", penalty=0.5, accumulated=True, local_cost=True)
    b = b.select("pair_id", F.round("distance", 6).alias("by_costs"), F.expr("round(element_at(element_at(accumulated, -1), -1), 6)").alias("last_cell"))
    return a.join(b, "pair_id").select("pair_id", "by_features", "by_costs", "last_cell", "finite")


@query(f"""WITH RECURSIVE {_DTW.replace('BAND', '5').replace('PENALTY', '2.0')}, f AS (SELECT one[n + 1] AS v FROM d WHERE s = n + m AND user_id = (SELECT min(user_id) FROM pr))
SELECT m.mode, f.v AS distance, m.mode = 'full' AS has_path, true AS refused FROM f, (VALUES ('none'), ('two_rows'), ('full')) m(mode)""")
def dtw_modes(spark, sf_dir):
    """The first pair of users inside a narrow band, by each memory mode; a path needs the full table, options are checked."""
    r = user_pairs(spark, sf_dir).orderBy("user_id").select("a", "b").first()
    pad = abs(len(r["a"]) - len(r["b"]))  # a band that no path fits gives +inf and no path
    refused = _raises(lambda: alignment.dtw([1.0], [2.0], alignment.Options(path=True))) and _raises(lambda: alignment.Options(penalty=-1.0).validate())
    out = []
    for mode in alignment.MEMORY:
        path = mode == "full" and pad <= 5
        v, steps = alignment.dtw(r["a"], r["b"], alignment.Options(window=5, penalty=2.0, path=path, memory=mode))
        out.append((mode, v, steps is not None or (mode == "full" and pad > 5), refused))
    return spark.createDataFrame(out, "mode string, distance double, has_path boolean, refused boolean")


# -- lattices ---------------------------------------------------------------------------
@query(f"""WITH RECURSIVE {_CELLS}, g AS (SELECT x, y, value >= 1 AS land FROM c), r(x, y, cost) AS (
  SELECT x, y, 0 FROM g WHERE y = 0 UNION SELECT g.x, g.y, r.cost + CASE WHEN g.land THEN 0 ELSE 1 END FROM r JOIN g ON abs(g.x - r.x) + abs(g.y - r.y) = 1 WHERE r.cost + CASE WHEN g.land THEN 0 ELSE 1 END <= 20)
SELECT min(cost) AS cost, true AS first_row, true AS last_row, true AS steps, true AS paid FROM r WHERE y = 19""")
def bridge_cost_parts(spark, sf_dir):
    """What the cheapest way across the lattice costs, and whether the way found is one."""
    g = Grid(cut(t.part_lattice(spark, sf_dir)), 50, 20)
    path, cost = g.expand_island(g.cells.where("y = 0"), g.cells.where("y = 19"))
    land = {(r["x"], r["y"]): r["value"] >= 1 for r in g.cells.collect()}  # a lattice of fixed size
    steps = all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(path, path[1:]))  # noqa: B905
    row = (cost, path[0][1] == 0, path[-1][1] == 19, steps, sum(not land[p] for p in path[1:]) == cost)
    return spark.createDataFrame([row], "cost int, first_row boolean, last_row boolean, steps boolean, paid boolean")


@query("""SELECT * FROM (VALUES ('inside', 'True'), ('outside', 'False'), ('coordinate', '(7, 3)'), ('four', '[(0, -1), (1, 0), (0, 1), (-1, 0)]'),
('eight', '[(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]'), ('defaults', '1 4')) v(op, value)""")
def grid_lookups(spark, sf_dir):
    cells = t.part_lattice(spark, sf_dir)
    g = Grid(cells, 50, 20)
    return _said(spark, [
        ("inside", g.in_bounds(49, 19)), ("outside", g.in_bounds(50, 0)), ("coordinate", g.coordinate(157)), ("four", list(g.neighbor_offsets())),
        ("eight", list(Grid(cells, 50, 20, connect=8).neighbor_offsets())), ("defaults", f"{g.threshold} {g.connect}"),
    ])


@query(f"""WITH RECURSIVE {_CELLS}, land AS (SELECT *, y * 50 + x AS k FROM c WHERE value >= 2),
e AS (SELECT a.k AS a, b.k AS b FROM land a JOIN land b ON a.value = b.value AND greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1),
r(root, k) AS (SELECT k, k FROM land UNION SELECT r.root, e.b FROM r JOIN e ON r.k = e.a WHERE e.b > -1),
l AS (SELECT k, min(root) AS component FROM r GROUP BY k)
SELECT land.value, CAST(l.component AS BIGINT) AS component, count(*) AS cells FROM land JOIN l ON land.k = l.k GROUP BY 1, 2""")
def islands_diagonal_parts(spark, sf_dir):
    """Islands over eight neighbours, of cells of at least 2."""
    g = Grid(cut(t.part_lattice(spark, sf_dir)), 50, 20, threshold=2, connect=8)
    return g.connected_components().select("value", "component", F.size("cells").cast("long").alias("cells"))


# -- generators -------------------------------------------------------------------------
_HEX = {
    "default": (6, "0-2 2-4 0-4 1-3 3-5 1-5"), "medium": (8, "0-2 0-6 2-4 4-6"),
    "big": (12, "1-3 5-7 7-9 9-11 3-5 1-11 C-0 C-1 C-2 C-3 C-4 C-5 C-6 C-7 C-8 C-9 C-10 C-11"),
    "huge": (12, "1-3 5-7 7-9 9-11 3-5 1-11 1-5 5-9 1-9 3-7 7-11 3-11 C-0 C-1 C-2 C-3 C-4 C-5 C-6 C-7 C-8 C-9 C-10 C-11"),
}
_HEX_ROWS = ", ".join(
    f"('{k}', '{min(p)}', '{max(p)}')"
    for k, (n, more) in _HEX.items()
    for p in ([(f"{i}", f"{(i + 1) % n}") for i in range(n)] + [tuple(x.replace("C", "Center").split("-")) for x in more.split()])
)


@query(f"SELECT * FROM (VALUES {_HEX_ROWS}) v(shape, a, b)")
def generate_hexagrams(spark, sf_dir):
    """Edges of every variant, ends in the order of their text."""
    return _union([gen.build(spark, gen.hexagram(k)).edges.select(F.lit(k).alias("shape"), F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")) for k in _HEX])


@query("""SELECT 'path' AS shape, CAST(i AS VARCHAR) AS src, CAST(i + 1 AS VARCHAR) AS dst FROM (SELECT unnest(generate_series(0, 18)) AS i)
UNION ALL SELECT 'star', 'Center', CAST(i AS VARCHAR) FROM (SELECT unnest(generate_series(1, 14)) AS i)
UNION ALL SELECT 'cycle', CAST(i AS VARCHAR), CAST((i + 1) % 11 AS VARCHAR) FROM (SELECT unnest(generate_series(0, 10)) AS i)
UNION ALL SELECT 'sparse', CAST(a AS VARCHAR), CAST(b AS VARCHAR) FROM (SELECT unnest(generate_series(0, 12)) AS a), (SELECT unnest(generate_series(0, 12)) AS b) WHERE a < b
UNION ALL SELECT 'extended', CAST(i AS VARCHAR), CAST(i + 1 AS VARCHAR) FROM (SELECT unnest(generate_series(0, 3)) AS i)
UNION ALL SELECT 'extended', 'Center', CAST(i AS VARCHAR) FROM (SELECT unnest(generate_series(1, 5)) AS i)""")
def generate_shapes(spark, sf_dir):
    shapes = {"path": gen.path(20), "star": gen.star(15), "cycle": gen.cycle(11), "sparse": gen.random_sparse(13, 1.0)}
    graphs = {k: gen.build(spark, s) for k, s in shapes.items()} | {"none": gen.build(spark, gen.random_sparse(13, 0.0))}
    graphs["extended"] = gen.extend(gen.build(spark, gen.path(5)), gen.star(6))
    return _union([g.edges.select(F.lit(k).alias("shape"), "src", "dst") for k, g in graphs.items()])


@query("""SELECT * FROM (VALUES ('SPARK', 'SPARK', true, 5::BIGINT), ('word', 'GO', true, 2), ('digit', '7', true, 1), ('number', '2024', true, 4), ('decimal', '35', true, 2), ('extended', 'L', true, 1)) v(name, text, whole, glyphs)""")
def generate_glyphs(spark, sf_dir):
    """Each character is one connected skeleton at a position of its own, with as many edges as its strokes have steps."""
    base = gen.build(spark, gen.path(2))
    graphs = {
        "SPARK": ("SPARK", gen.build(spark, gen.letters("SPARK", "w"))), "word": ("GO", gen.build(spark, gen.word("GO"))), "digit": ("7", gen.build(spark, gen.digit(7))),
        "number": ("2024", gen.build(spark, gen.number(2024))), "decimal": ("35", gen.build(spark, gen.number(3.5, decimal=True))), "extended": ("L", gen.extend(base, gen.letters("L", "x"))),
    }
    out = []
    for name, (text, g) in graphs.items():
        ends = g.edges.where("src like '%::%'")
        at = F.element_at(F.split("src", "::"), -2)
        groups = traverse.components(g).where("id like '%::%'").select("component").distinct().count()
        steps = sum(len(set(gen.glyph_steps(c))) for c in text)
        inside = ends.where(at != F.element_at(F.split("dst", "::"), -2)).count() == 0
        out.append((name, text, inside and ends.count() == steps, groups))
    return spark.createDataFrame(out, "name string, text string, whole boolean, glyphs long")


@query("""WITH RECURSIVE r(i, n, s) AS (SELECT i, i, '' FROM (SELECT unnest(generate_series(0, 25)) AS i)
UNION ALL SELECT i, n // 36, substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(n % 36 + 1 AS INTEGER), 1) || s FROM r WHERE n > 0)
SELECT i, chr(CAST(65 + i AS INTEGER)) AS symbol, CASE WHEN i = 0 THEN '0' ELSE s END AS alphanumeric, CAST(i AS VARCHAR) AS plain FROM r WHERE n = 0""")
def id_schemes_small(spark, sf_dir):
    i = F.col("id")
    return spark.range(26).select(i.alias("i"), naming.symbol_ids(i).alias("symbol"), naming.alphanumeric_ids(i).alias("alphanumeric"), naming.decimal_ids(i).alias("plain"))


@query("SELECT * FROM (VALUES ('constant', true, true), ('uniform', true, true), ('normal', true, true), ('exponential', true, true), ('drawn', true, true)) v(scheme, in_range, mean_ok)")
def weight_schemes(spark, sf_dir):
    """Weights of 20,000 edges lie in their range and have the mean that their distribution has."""
    import random

    schemes = {
        "constant": (naming.constant_weight(2.5), 2.5, 2.5, 2.5, {}), "uniform": (naming.uniform_weight(), 1.0, 100.0, 50.5, {}), "normal": (naming.normal_weight(50.0, 5.0), 0.0, 1e9, 50.0, {}),
        "exponential": (naming.exponential_weight(0.1), 0.0, 1e9, 10.0, {}), "drawn": (naming.uniform_weight(2.0, 4.0), 2.0, 4.0, 3.0, {"rand": random.Random(5)}),
    }
    out = []
    for name, (w, lo, hi, mean, kw) in schemes.items():
        g = gen.build(spark, gen.path(20_001), caps={"weighted": True}, weight=w, **kw)
        r = g.edges.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"), F.avg("weight").alias("mean")).first()
        out.append((name, lo <= r["lo"] and r["hi"] <= hi, abs(r["mean"] - mean) <= 0.05 * mean))
    return spark.createDataFrame(out, "scheme string, in_range boolean, mean_ok boolean")


@query("""SELECT 'pulse' AS signal, i, CASE WHEN (i * 0.25) % 1 < 0.25 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END + i * 0.5 AS value FROM (SELECT unnest(generate_series(0, 199)) AS i)
UNION ALL SELECT 'chirp', i, round(2 * sin(2 * pi() * sum(0.1::DOUBLE + (0.2::DOUBLE - 0.1::DOUBLE) / 199 * i) OVER (ORDER BY i)) - i * 0.25, 6) + 0.0::DOUBLE FROM (SELECT unnest(generate_series(0, 199)) AS i)""")
def signal_options(spark, sf_dir):
    """Amplitude, frequency, duty and trend at work."""
    p = gen.pulse(spark, 200, frequency=0.25, duty=0.25, amplitude=3.0, trend=0.5).select(F.lit("pulse").alias("signal"), "i", "value")
    c = gen.audio_chirp(spark, 200, f0=0.1, f1=0.2, amplitude=2.0, trend=-0.25).select(F.lit("chirp").alias("signal"), "i", (F.round("value", 6) + 0.0).alias("value"))
    return p.unionByName(c)


@query("SELECT 'U' || a AS src, 'V' || b AS dst, 2.0::DOUBLE AS weight FROM (SELECT unnest(generate_series(0, 3)) AS a), (SELECT unnest(generate_series(0, 6)) AS b)")
def generate_prefixed(spark, sf_dir):
    """A bipartite graph whose sides have prefixes of their own and edges a constant weight."""
    g = gen.build(spark, gen.complete_bipartite(4, 7), caps={"weighted": True}, left="U", right="V", weight=naming.constant_weight(2.0))
    return g.edges.select("src", "dst", "weight")


@query("SELECT * FROM (VALUES ('excel', 'A', 'B'), ('excel', 'B', 'C'), ('hex', '0', '1'), ('hex', '1', '2'), ('alphanumeric', '0', '1'), ('alphanumeric', '1', '2'), ('symbol', 'A', 'B'), ('symbol', 'B', 'C'), ('number', 'v0', 'v1'), ('number', 'v1', 'v2'), ('plain', '0', '1'), ('plain', '1', '2')) v(scheme, src, dst)")
def generate_named(spark, sf_dir):
    """A path under every ID scheme."""
    schemes = {"excel": naming.excel_ids, "hex": naming.hex_ids, "alphanumeric": naming.alphanumeric_ids, "symbol": naming.symbol_ids, "number": naming.prefixed_ids("v"), "plain": naming.decimal_ids}
    return _union([gen.build(spark, gen.path(3), ids=f).edges.select(F.lit(k).alias("scheme"), "src", "dst") for k, f in schemes.items()])
