"""The registered queries, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming
from ..operators import alignment, grouped, mst, traverse
from ..operators import matrix as mx
from ..operators.grid import Grid
from ..sources import generators as gen
from ..sources import tables as t
from .iterate import cut, numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


#: SQL of the derived graphs.
_TRADE = """trade AS (
  SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS src, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS dst,
         CAST(CAST(sum(l_quantity) AS BIGINT) AS DOUBLE) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2)"""
_ARCS = _TRADE + ", arcs AS (SELECT * FROM trade WHERE src <> dst), ids AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS id FROM nation)"
_BOTH = _TRADE + """, und AS (
  SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(weight) AS weight FROM trade WHERE src <> dst GROUP BY 1, 2)"""
_SUPPLY = "sp AS (SELECT DISTINCT 'S' || l_suppkey AS s, 'P' || l_partkey AS p FROM lineitem)"
_SESSION = """nx AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
sess AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM nx WHERE dst IS NOT NULL GROUP BY 1, 2)"""
_M = "m AS (SELECT vec_id AS i, u.j - 1 AS j, CAST(embedding[u.j] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS j) u)"


# -- traversal ----------------------------------------------------------------
@query(f"""WITH RECURSIVE {_SUPPLY}, ends AS (SELECT s AS a, p AS b FROM sp UNION ALL SELECT p, s FROM sp),
r(id, h) AS (SELECT 'S1', 0 UNION SELECT ends.b, r.h + 1 FROM r JOIN ends ON r.id = ends.a WHERE r.h < 4)
SELECT depth, count(*) AS vertices FROM (SELECT id, min(h) AS depth FROM r GROUP BY id) GROUP BY depth""")
def bfs_supply_depths(spark, sf_dir):
    """Vertices of the supply graph at each hop from supplier 1, up to four."""
    d = traverse.hop_depths(t.supply_graph(spark, sf_dir).arcs(), spark.createDataFrame([("S1",)], "id string"), 4)
    return d.groupBy("depth").agg(F.count(F.lit(1)).alias("vertices"))


@query("""WITH RECURSIVE tree AS (
  SELECT 'R' || n_regionkey AS p, 'N' || n_nationkey AS c FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer),
b AS (SELECT p AS a, c AS b FROM tree UNION ALL SELECT c, p FROM tree),
r(id, h) AS (SELECT 'R0', 0 UNION SELECT b.b, r.h + 1 FROM r JOIN b ON r.id = b.a WHERE r.h < 3),
lv AS (SELECT id, min(h) AS depth FROM r GROUP BY id)
SELECT lv.id, CAST(lv.depth AS INTEGER) AS depth, (SELECT x.id FROM lv x JOIN b ON b.a = x.id WHERE b.b = lv.id AND x.depth = lv.depth - 1) AS parent FROM lv""")
def bfs_geo_parents(spark, sf_dir):
    """Depth and parent of everything under region 0."""
    return traverse.bfs(t.geo_graph(spark, sf_dir), "R0").visited.select("id", "depth", "parent")


@query("""WITH ids AS (
  SELECT n_regionkey AS r, 'C' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, 'N' || n_nationkey FROM nation UNION ALL SELECT DISTINCT n_regionkey, 'R' || n_regionkey FROM nation)
SELECT min(id) AS component, count(*) AS members FROM ids GROUP BY r""")
def components_geo(spark, sf_dir):
    return traverse.components(t.geo_graph(spark, sf_dir)).groupBy("component").agg(F.count(F.lit(1)).alias("members"))


@query(f"""WITH RECURSIVE {_ARCS}, r(id, d, h) AS (
  SELECT '00', 0.0::DOUBLE, 0 UNION SELECT id, min(d), h FROM (SELECT arcs.dst AS id, r.d + arcs.weight AS d, r.h + 1 AS h FROM r JOIN arcs ON r.id = arcs.src WHERE r.h < 24) GROUP BY id, h)
SELECT ids.id, coalesce(min(r.d), 'infinity'::DOUBLE) AS dist FROM ids LEFT JOIN r ON ids.id = r.id GROUP BY ids.id""")
def sssp_trade(spark, sf_dir):
    return traverse.shortest_paths(t.trade_graph(spark, sf_dir), "00").distances


@query(f"""WITH RECURSIVE {_ARCS}, near(id, d, h) AS (
  SELECT '00', 0.0::DOUBLE, 0 UNION SELECT id, min(d), h FROM (SELECT arcs.dst AS id, near.d + arcs.weight AS d, near.h + 1 AS h FROM near JOIN arcs ON near.id = arcs.src
  WHERE near.h < 24 AND arcs.weight < 4000 AND near.d + arcs.weight <= 5000) GROUP BY id, h),
best AS (SELECT id, min(d) AS dist FROM near GROUP BY id),
par AS (SELECT y.id, x.id AS prev FROM best x JOIN arcs ON x.id = arcs.src AND arcs.weight < 4000 JOIN best y ON arcs.dst = y.id AND x.dist + arcs.weight = y.dist
  WHERE y.id <> '00' QUALIFY row_number() OVER (PARTITION BY y.id ORDER BY x.dist, x.id) = 1)
SELECT ids.id, coalesce(dist, 'infinity'::DOUBLE) AS dist, prev FROM ids LEFT JOIN best ON ids.id = best.id LEFT JOIN par ON ids.id = par.id""")
def sssp_trade_paths(spark, sf_dir):
    """Distance and parent with a cutoff and a wall."""
    r = traverse.shortest_paths(t.trade_graph(spark, sf_dir), "00", track=True, max_distance=5000.0, wall=4000.0)
    return r.distances.join(r.parents, "id")


@query(f"""WITH RECURSIVE {_ARCS}, r(s, id, d, h) AS (
  SELECT id, id, 0.0::DOUBLE, 0 FROM ids
  UNION SELECT s, id, min(d), h FROM (SELECT r.s, arcs.dst AS id, r.d + arcs.weight AS d, r.h + 1 AS h FROM r JOIN arcs ON r.id = arcs.src WHERE r.h < 24) GROUP BY s, id, h)
SELECT CAST(CAST(s AS INTEGER) AS INTEGER) AS i, CAST(CAST(id AS INTEGER) AS INTEGER) AS j, min(d) AS v FROM r GROUP BY s, id""")
def apsp_trade(spark, sf_dir):
    """All distances of the trade graph; a vertex's number is that of its nation."""
    a = mx.adjacency(t.trade_graph(spark, sf_dir), mx.MatrixOptions(directed=True))
    return mx.metric_closure(a).matrix.cells


@query("""SELECT CAST(o_custkey AS VARCHAR) AS graph_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS ord, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id
FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)""")
def toposort_chains(spark, sf_dir):
    """Every customer's chain of orders, sorted; one small graph each."""
    e = t.order_chains(spark, sf_dir)
    v = e.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
    return grouped.topological_sort(e, v)


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS level, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT CAST(level AS INTEGER) AS level, count(*) AS vertices FROM o WHERE n > 1 GROUP BY 1""")
def toposort_levels(spark, sf_dir):
    """All levels of all chains together, by peeling."""
    e = t.order_chains(spark, sf_dir).where("true")
    v = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return grouped.topological_levels(e, v).groupBy("level").agg(F.count(F.lit(1)).alias("vertices"))


@query()
def dfs_sessions(spark, sf_dir):
    return grouped.depth_first(*grouped.frames(t.session_graph(spark, sf_dir)))


@query()
def cycles_sessions(spark, sf_dir):
    g = t.session_graph(spark, sf_dir)
    return grouped.detect_cycles(*grouped.frames(g), directed=True).select(F.array_join("cycle", ">").alias("cycle"))


# -- graphs as tables -------------------------------------------------------------
@query(f"""WITH {_SUPPLY} SELECT id, 0::BIGINT AS in_degree, 0::BIGINT AS out_degree, count(*) AS undirected
FROM (SELECT s AS id FROM sp UNION ALL SELECT p FROM sp) GROUP BY id""")
def degrees_supply(spark, sf_dir):
    return t.supply_graph(spark, sf_dir).degrees()


@query(f"WITH {_ARCS} SELECT src AS id, dst AS neighbor FROM arcs")
def neighbor_ids_trade(spark, sf_dir):
    return t.trade_graph(spark, sf_dir).neighbor_ids()


@query(f"WITH {_ARCS} SELECT src AS id, src || '-' || dst AS edge_id, src, dst, weight, true AS directed FROM arcs WHERE src = '03'")
def neighbors_trade(spark, sf_dir):
    return t.trade_graph(spark, sf_dir).neighbors("03")


@query(f"WITH {_ARCS} SELECT ids.id, coalesce(string_agg(src || '-' || dst, ',' ORDER BY src || '-' || dst), '') AS edge_ids FROM ids LEFT JOIN arcs ON ids.id = arcs.src GROUP BY ids.id")
def adjacency_list_trade(spark, sf_dir):
    a = t.trade_graph(spark, sf_dir).adjacency_list()
    return a.select("id", F.array_join("edge_ids", ",").alias("edge_ids"))


@query(f"""WITH {_ARCS} SELECT (SELECT count(*) FROM ids) AS vertices, count(*) AS edges, count(*) AS directed_edges, 0::BIGINT AS undirected_edges,
true AS directed, true AS weighted, false AS multi, false AS loops, false AS mixed FROM arcs""")
def stats_trade(spark, sf_dir):
    return t.trade_graph(spark, sf_dir).stats()


@query(f"WITH {_ARCS} SELECT src || '-' || dst AS edge_id, src, dst, weight, true AS directed FROM arcs WHERE weight > 1000")
def filter_edges_trade(spark, sf_dir):
    return t.trade_graph(spark, sf_dir).filter_edges(F.col("weight") > 1000)


@query(f"""WITH {_ARCS}, k AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS id FROM nation WHERE n_regionkey IN (1, 2))
SELECT src || '-' || dst AS edge_id, src, dst, 0.0::DOUBLE AS weight, true AS directed FROM arcs WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""")
def induced_unweighted_trade(spark, sf_dir):
    """Trade among two regions, weights left out."""
    k = t.table(spark, sf_dir, "nation").where("n_regionkey in (1, 2)").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("id"))
    return t.trade_graph(spark, sf_dir).induced(k).unweighted_view().edges


@query(f"WITH {_ARCS} SELECT src || '-' || dst AS edge_id, src, dst, weight, true AS directed FROM arcs WHERE src <> '07' AND dst <> '07'")
def remove_vertex_trade(spark, sf_dir):
    return t.trade_graph(spark, sf_dir).remove_vertex("07").edges


@query(f"WITH {_ARCS} SELECT src, dst, weight AS capacity FROM arcs")
def capacities_trade(spark, sf_dir):
    return grouped.capacity_matrix(t.trade_graph(spark, sf_dir))


# -- matrices -----------------------------------------------------------------------
@query(f"WITH {_ARCS} SELECT CAST(src AS INTEGER) AS i, CAST(dst AS INTEGER) AS j, weight AS v FROM arcs")
def adjacency_trade(spark, sf_dir):
    return mx.adjacency(t.trade_graph(spark, sf_dir), mx.MatrixOptions(directed=True)).matrix.cells


@query(f"WITH {_ARCS} SELECT ids.id, coalesce(sum(weight), 0.0) AS degree FROM ids LEFT JOIN arcs ON src = ids.id GROUP BY ids.id")
def degree_vector_trade(spark, sf_dir):
    return mx.adjacency(t.trade_graph(spark, sf_dir), mx.MatrixOptions(directed=True)).degree_vector()


@query(f"""WITH {_SESSION}, vx AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM (SELECT src AS id FROM sess UNION SELECT dst FROM sess)),
cx AS (SELECT src, dst, row_number() OVER (ORDER BY src || '>' || dst) - 1 AS j FROM sess WHERE src <> dst),
e AS (SELECT src AS id, j, -1.0::DOUBLE AS v FROM cx UNION ALL SELECT dst, j, 1.0 FROM cx)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, sum(v) AS v FROM e JOIN vx ON e.id = vx.id GROUP BY 1, 2""")
def incidence_sessions(spark, sf_dir):
    return mx.incidence(t.session_graph(spark, sf_dir), mx.MatrixOptions(directed=True))[0].cells


def _features(spark, sf_dir, cols: int = 64) -> mx.Matrix:
    n = t.table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    return mx.Matrix(t.feature_cells(spark, sf_dir, cols), int(n or -1) + 1, cols)


@query(f"WITH {_M} SELECT CAST(i AS INTEGER) AS i, round(sum(v), 6) AS total FROM m GROUP BY i")
def row_sums_features(spark, sf_dir):
    return _features(spark, sf_dir).row_sums().select("i", F.round("total", 6).alias("total"))


@query(f"WITH {_M} SELECT CAST(j AS INTEGER) AS j, round(sum(v), 6) AS total FROM m GROUP BY j")
def col_sums_features(spark, sf_dir):
    return _features(spark, sf_dir).col_sums().select("j", F.round("total", 6).alias("total"))


@query(f"WITH {_M} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(v - avg(v) OVER (PARTITION BY j), 6) AS v FROM m")
def center_columns_features(spark, sf_dir):
    return _features(spark, sf_dir).center_columns()[0].cells.select("i", "j", F.round("v", 6).alias("v"))


@query(f"WITH {_M} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(v / sqrt(sum(v * v) OVER (PARTITION BY i)), 6) AS v FROM m")
def normalize_l2_features(spark, sf_dir):
    return _features(spark, sf_dir).normalize_rows_l2()[0].cells.select("i", "j", F.round("v", 6).alias("v"))


@query(f"WITH {_M} SELECT CAST(a.j AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, round(covar_samp(a.v, b.v), 9) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j")
def covariance_features(spark, sf_dir):
    return _features(spark, sf_dir).covariance()[0].cells.select("i", "j", F.round("v", 9).alias("v"))


@query(f"WITH {_M} SELECT CAST(a.j AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, round(corr(a.v, b.v), 6) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j")
def correlation_features(spark, sf_dir):
    return _features(spark, sf_dir).correlation()[0].cells.select("i", "j", F.round("v", 6).alias("v"))


@query(f"WITH {_M} SELECT CAST(a.j AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, round(sum(a.v * b.v), 6) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j")
def gram_features(spark, sf_dir):
    m = _features(spark, sf_dir)
    return m.transpose().mul(m).cells.select("i", "j", F.round("v", 6).alias("v"))


@query(f"WITH {_M} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, least(greatest(v, -0.1), 0.1) AS v FROM m")
def clip_features(spark, sf_dir):
    return _features(spark, sf_dir).clip(0.1, -0.1).cells


@query(f"WITH {_TRADE}, x AS (SELECT CAST(src AS INTEGER) AS i, CAST(dst AS INTEGER) AS j, weight AS v FROM trade) SELECT coalesce(a.i, b.j) AS i, coalesce(a.j, b.i) AS j, (coalesce(a.v, 0) + coalesce(b.v, 0)) / 2 AS v FROM x a FULL JOIN x b ON a.i = b.j AND a.j = b.i")
def symmetrize_trade(spark, sf_dir):
    c = t.trade_arcs(spark, sf_dir).select(F.col("src").cast("int").alias("i"), F.col("dst").cast("int").alias("j"), F.col("weight").alias("v"))
    return mx.Matrix(c, 25, 25).symmetrize().cells


# -- optimisation -----------------------------------------------------------------------
@query(f"""WITH RECURSIVE {_BOTH}, e AS (SELECT src || '-' || dst AS edge_id, src, dst, weight FROM und),
r(edge_id, pos, weight) AS (
  SELECT edge_id, src, weight FROM e
  UNION SELECT r.edge_id, CASE WHEN x.src = r.pos THEN x.dst ELSE x.src END, r.weight FROM r JOIN e x ON (x.src = r.pos OR x.dst = r.pos) AND (x.weight < r.weight OR (x.weight = r.weight AND x.edge_id < r.edge_id)))
SELECT e.edge_id, e.src, e.dst, e.weight FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.edge_id = e.edge_id AND r.pos = e.dst)""")
def mst_trade(spark, sf_dir):
    """The spanning forest: edges whose ends no lighter edges connect."""
    return mst.minimum_spanning_tree(t.trade_graph(spark, sf_dir, directed=False), forest=True).edges


@query()
def max_flow_trade(spark, sf_dir):
    r = grouped.max_flow(*grouped.frames(t.trade_graph(spark, sf_dir)), source="00", sink="05")
    return r.select("graph_id", "value", F.array_join("source_side", ",").alias("source_side"))


@query(f"""WITH RECURSIVE {_BOTH}, two AS (SELECT src, dst, weight FROM und UNION ALL SELECT dst, src, weight FROM und),
w(s, id, d, h) AS (SELECT DISTINCT src, src, 0.0::DOUBLE, 0 FROM two
  UNION SELECT s, id, min(d), h FROM (SELECT w.s, two.dst AS id, w.d + two.weight AS d, w.h + 1 AS h FROM w JOIN two ON w.id = two.src WHERE w.h < 24) GROUP BY s, id, h),
q AS (SELECT s, id, min(d) AS d FROM w GROUP BY s, id),
n AS (SELECT CAST(n_regionkey AS VARCHAR) AS r, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS id FROM nation),
p AS (SELECT a.r, a.id AS a, b.id AS b, c.id AS c, d.id AS d, e.id AS e FROM n a JOIN n b ON b.r = a.r AND b.id > a.id JOIN n c ON c.r = a.r AND c.id > a.id AND c.id <> b.id
  JOIN n d ON d.r = a.r AND d.id > a.id AND d.id NOT IN (b.id, c.id) JOIN n e ON e.r = a.r AND e.id > b.id AND e.id NOT IN (c.id, d.id)),
t AS (SELECT p.r, p.a || '>' || p.b || '>' || p.c || '>' || p.d || '>' || p.e || '>' || p.a AS tour, q1.d + q2.d + q3.d + q4.d + q5.d AS cost FROM p JOIN q q1 ON q1.s = p.a AND q1.id = p.b
  JOIN q q2 ON q2.s = p.b AND q2.id = p.c JOIN q q3 ON q3.s = p.c AND q3.id = p.d JOIN q q4 ON q4.s = p.d AND q4.id = p.e JOIN q q5 ON q5.s = p.e AND q5.id = p.a)
SELECT r AS instance_id, min(cost) AS cost, true AS optimal, 5 AS stops FROM t GROUP BY r""")
def tours_by_region(spark, sf_dir):
    """Exact tours over each region's nations, by trade both ways; missing trade costs the closure's distance."""
    n = t.table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("id"), F.col("n_regionkey").cast("string").alias("r"))
    a = mx.metric_closure(mx.adjacency(t.trade_graph(spark, sf_dir, directed=False)))
    ix = a.index.join(n, "id")
    d = a.matrix.cells.join(ix.select(F.col("idx").alias("i"), F.col("id").alias("x"), "r"), "i").join(ix.select(F.col("idx").alias("j"), F.col("id").alias("y"), F.col("r").alias("s")), "j").where("r = s")
    rows = d.groupBy("r", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "v"))), lambda s: s["v"]).alias("row"))
    inst = rows.groupBy(F.col("r").alias("instance_id")).agg(F.array_sort(F.collect_list(F.struct("x", "row"))).alias("m"))
    inst = inst.select("instance_id", F.transform("m", lambda s: s["x"]).alias("ids"), F.transform("m", lambda s: s["row"]).alias("dist"))
    # Equally short tours are told apart by nothing in SQL, so what is compared is how many nations they visit.
    return grouped.solve_tours(inst, algorithm="held_karp").select("instance_id", "cost", "optimal", F.size(F.array_distinct("ids")).alias("stops"))


def user_pairs(spark, sf_dir) -> DataFrame:
    """(user_id, other, a, b): every user's series with the next user's."""
    s = cut(t.series(spark, sf_dir))
    at = numbered(s.select("user_id"), "user_id", name="k")
    p = at.join(at.select((F.col("k") - 1).alias("k"), F.col("user_id").alias("other")), "k").select("user_id", "other")
    return p.join(s, "user_id").join(s.select(F.col("user_id").alias("other"), F.col("a").alias("b")), "other")


#: Anti-diagonals of the warping tables of all pairs at once, the last two at a time.
_DTW = """z AS (SELECT user_id, list(CAST(round(value * 100) AS DOUBLE) ORDER BY ts, event_id) AS a, row_number() OVER (ORDER BY user_id) AS k FROM events GROUP BY user_id),
pr AS (SELECT x.user_id, y.user_id AS other, x.a AS a, y.a AS b, len(x.a) AS n, len(y.a) AS m FROM z x JOIN z y ON y.k = x.k + 1),
d(user_id, s, two, one, n, m) AS (
  SELECT user_id, 1, list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE 'infinity'::DOUBLE END), list_transform(range(0, n + 1), lambda i: 'infinity'::DOUBLE), n, m FROM pr
  UNION ALL
  SELECT d.user_id, d.s + 1, d.one, list_transform(range(0, d.n + 1), lambda i: CASE WHEN i >= 1 AND d.s + 1 - i BETWEEN 1 AND d.m AND abs(2 * i - d.s - 1) <= BAND
    THEN abs(pr.a[i] - pr.b[d.s + 1 - i]) + least(d.two[i], d.one[i] + PENALTY, d.one[i + 1] + PENALTY) ELSE 'infinity'::DOUBLE END), d.n, d.m
  FROM d JOIN pr ON d.user_id = pr.user_id WHERE d.s < d.n + d.m)"""


@query(f"""WITH RECURSIVE {_DTW.replace('BAND', '40').replace('PENALTY', '1.0')}
SELECT d.user_id, pr.other, d.one[d.n + 1] AS distance FROM d JOIN pr ON d.user_id = pr.user_id WHERE d.s = d.n + d.m""")
def dtw_users(spark, sf_dir):
    """Every user's series against the next user's, inside a band."""
    j = user_pairs(spark, sf_dir)
    r = alignment.align(j.select(F.concat_ws(",", "user_id", "other").alias("pair_id"), "a", "b"), window=40, penalty=1.0)
    ids = F.split("pair_id", ",")
    return r.select(ids[0].cast("long").alias("user_id"), ids[1].cast("long").alias("other"), "distance")


# -- lattices ------------------------------------------------------------------------------
_CELLS = """c AS (SELECT x, y, CAST(coalesce(n, 0) AS INTEGER) AS value FROM (SELECT i % 50 AS x, i // 50 AS y FROM (SELECT unnest(generate_series(0, 999)) AS i))
LEFT JOIN (SELECT p_size - 1 AS px, CAST(floor(p_retailprice) AS BIGINT) % 20 AS py, count(*) AS n FROM part GROUP BY 1, 2) ON x = px AND y = py)"""


@query(f"""WITH RECURSIVE {_CELLS}, land AS (SELECT *, y * 50 + x AS k FROM c WHERE value >= 1),
e AS (SELECT a.k AS a, b.k AS b FROM land a JOIN land b ON a.value = b.value AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
r(root, k) AS (SELECT k, k FROM land UNION SELECT r.root, e.b FROM r JOIN e ON r.k = e.a WHERE e.b > -1),
l AS (SELECT k, min(root) AS component FROM r GROUP BY k)
SELECT land.value, CAST(l.component AS BIGINT) AS component, count(*) AS cells FROM land JOIN l ON land.k = l.k GROUP BY 1, 2""")
def islands_parts(spark, sf_dir):
    g = Grid(t.part_lattice(spark, sf_dir), 50, 20)
    return g.connected_components().select("value", "component", F.size("cells").cast("long").alias("cells"))


@query(f"""WITH {_CELLS} SELECT a.x || ',' || a.y AS src, b.x || ',' || b.y AS dst FROM c a JOIN c b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)""")
def lattice_edges(spark, sf_dir):
    return Grid(t.part_lattice(spark, sf_dir), 50, 20).to_graph().edges.select("src", "dst")


# -- generators -------------------------------------------------------------------------------
@query("SELECT CAST(a AS VARCHAR) AS src, CAST(b AS VARCHAR) AS dst FROM (SELECT unnest(generate_series(0, 59)) AS a), (SELECT unnest(generate_series(0, 59)) AS b) WHERE a < b")
def generate_complete(spark, sf_dir):
    return gen.build(spark, gen.complete(60)).edges.select("src", "dst")


@query("""WITH c AS (SELECT i // 30 AS r, i % 30 AS k FROM (SELECT unnest(generate_series(0, 599)) AS i))
SELECT r || ',' || k AS src, r || ',' || (k + 1) AS dst FROM c WHERE k < 29 UNION ALL SELECT r || ',' || k, (r + 1) || ',' || k FROM c WHERE r < 19""")
def generate_grid(spark, sf_dir):
    return gen.build(spark, gen.grid(20, 30)).edges.select("src", "dst")


@query("SELECT 'L' || a AS src, 'R' || b AS dst FROM (SELECT unnest(generate_series(0, 19)) AS a), (SELECT unnest(generate_series(0, 29)) AS b)")
def generate_bipartite(spark, sf_dir):
    return gen.build(spark, gen.complete_bipartite(20, 30)).edges.select("src", "dst")


@query("""SELECT CAST(i AS VARCHAR) AS src, CAST((i + 1) % 40 AS VARCHAR) AS dst FROM (SELECT unnest(generate_series(0, 39)) AS i)
UNION ALL SELECT 'Center', CAST(i AS VARCHAR) FROM (SELECT unnest(generate_series(0, 39)) AS i)""")
def generate_wheel(spark, sf_dir):
    return gen.build(spark, gen.wheel(40)).edges.select("src", "dst")


@query("SELECT i, CASE WHEN (i * 0.125) % 1 < 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM (SELECT unnest(generate_series(0, 999)) AS i)")
def signal_pulse(spark, sf_dir):
    return gen.pulse(spark, 1000)


@query("""SELECT i, round(sin(2 * pi() * sum(0.02::DOUBLE + (0.25::DOUBLE - 0.02::DOUBLE) / 499 * i) OVER (ORDER BY i)), 6) + 0.0::DOUBLE AS value FROM (SELECT unnest(generate_series(0, 499)) AS i)""")
def signal_chirp(spark, sf_dir):
    return gen.audio_chirp(spark, 500).select("i", (F.round("value", 6) + 0.0).alias("value"))


@query("""WITH RECURSIVE r(i, n, s) AS (SELECT i, i + 1, '' FROM (SELECT unnest(generate_series(0, 1999)) AS i)
UNION ALL SELECT i, (n - 1) // 26, chr(CAST(65 + (n - 1) % 26 AS INTEGER)) || s FROM r WHERE n > 0)
SELECT i, lower(to_hex(i)) AS hex, s AS excel, 'v' || i AS prefixed FROM r WHERE n = 0""")
def id_schemes(spark, sf_dir):
    i = F.col("id")
    return spark.range(2000).select(i.alias("i"), naming.hex_ids(i).alias("hex"), naming.excel_ids(i).alias("excel"), naming.prefixed_ids("v")(i).alias("prefixed"))


# -- factorisations: what they must give back ------------------------------------------------------
_GRAM = f"WITH {_M} SELECT CAST(a.j AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, round(sum(a.v * b.v), 6) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j"


def _gram(spark, sf_dir) -> mx.Matrix:
    m = _features(spark, sf_dir)
    return m.transpose().mul(m)


def _cells(spark, a, digits: int = 6) -> DataFrame:
    """A small array as cells; -0.0 becomes 0.0."""
    rows = [(i, j, float(v) + 0.0) for i, r in enumerate(a) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "i int, j int, v double").select("i", "j", (F.round("v", digits) + 0.0).alias("v"))


_GRAM_OK = _GRAM.replace("SELECT CAST(a.j", "SELECT true AS ok, CAST(a.j", 1)


@query(_GRAM_OK)
def lu_gram(spark, sf_dir):
    """The product of both factors, and whether each cell is what a unit lower and an upper factor may hold there."""
    low, up = _gram(spark, sf_dir).lu()
    n = len(low)
    ok = [(i, j, bool((low[i, j] == (1.0 if i == j else 0.0) or i > j) and (up[i, j] == 0.0 or i <= j))) for i in range(n) for j in range(n)]
    return _cells(spark, low @ up).join(spark.createDataFrame(ok, "i int, j int, ok boolean"), ["i", "j"])


@query(_GRAM_OK)
def qr_gram(spark, sf_dir):
    """The product, and whether Q is orthogonal and R upper triangular at each cell."""
    q, r = _gram(spark, sf_dir).qr()
    n, unit = len(q), q.T @ q
    ok = [(i, j, bool(abs(unit[i, j] - (i == j)) < 1e-9 and (i <= j or r[i, j] == 0.0))) for i in range(n) for j in range(n)]
    return _cells(spark, q.T @ r).join(spark.createDataFrame(ok, "i int, j int, ok boolean"), ["i", "j"])


@query("SELECT CAST(a AS INTEGER) AS i, CAST(b AS INTEGER) AS j, CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM (SELECT unnest(generate_series(0, 63)) AS a), (SELECT unnest(generate_series(0, 63)) AS b)")
def inverse_gram(spark, sf_dir):
    m = _gram(spark, sf_dir)
    return _cells(spark, m.toarray() @ m.inverse())


@query(f"""WITH {_M},
g AS (SELECT CAST(a.j AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j)
SELECT 64::BIGINT AS n, round((SELECT sum(v) FROM g WHERE i = j), 4) AS trace, round((SELECT sum(v * v) FROM g), 2) AS squares, true AS pairs, true AS unit""")
def eigen_gram(spark, sf_dir):
    """Sums of the eigenvalues and of their squares, whether every pair solves its equation, and whether the vectors are orthonormal."""
    m = _gram(spark, sf_dir)
    lam, v = m.eigen_sym()
    a, n = m.toarray(), len(lam)
    pairs = bool((abs(a @ v - v * lam) < 1e-6 * max(1.0, float(abs(lam).max()))).all())
    unit = bool((abs(v.T @ v - _eye(n)) < 1e-9).all())
    rows = [(n, float(lam.sum()), float((lam * lam).sum()), pairs, unit)]
    return spark.createDataFrame(rows, "n long, trace double, squares double, pairs boolean, unit boolean").select("n", F.round("trace", 4).alias("trace"), F.round("squares", 2).alias("squares"), "pairs", "unit")


def _eye(n: int):
    import numpy as np

    return np.eye(n)


# -- further operators -----------------------------------------------------------------------------------
@query(ORACLES["mst_trade"])
def prim_trade(spark, sf_dir):
    return mst.minimum_spanning_tree(t.trade_graph(spark, sf_dir, directed=False), forest=True, algorithm="prim", root="00").edges


@query(f"""WITH {_BOTH}, s AS (SELECT lpad(CAST(a AS VARCHAR), 2, '0') AS p, lpad(CAST((a + 1) % 25 AS VARCHAR), 2, '0') AS q FROM (SELECT unnest(generate_series(0, 24)) AS a))
SELECT 'all' AS instance_id, round(sum(coalesce(weight, 'infinity'::DOUBLE)) * 1e9) / 1e9 AS cost FROM s LEFT JOIN und ON und.src = least(p, q) AND und.dst = greatest(p, q)""")
def tour_cost_trade(spark, sf_dir):
    """All nations in the order of their numbers."""
    e = t.trade_graph(spark, sf_dir, directed=False).arcs()
    d = e.select(F.lit("all").alias("instance_id"), F.col("src").cast("int").alias("i"), F.col("dst").cast("int").alias("j"), F.col("weight").alias("v"))
    tour = spark.createDataFrame([("all", [*range(25), 0])], "instance_id string, tour array<int>")
    return grouped.tour_costs(tour, d)


@query()
def tour_christofides(spark, sf_dir):
    g = t.trade_graph(spark, sf_dir, directed=False)
    return grouped.solve_graph_tour(g, algorithm="christofides", closure=True).select(F.array_join("ids", ">").alias("tour"), "cost", "optimal")


@query(f"""WITH RECURSIVE {_ARCS}, near(id, d, h) AS (
  SELECT '00', 0.0::DOUBLE, 0 UNION SELECT id, min(d), h FROM (SELECT arcs.dst AS id, near.d + arcs.weight AS d, near.h + 1 AS h FROM near JOIN arcs ON near.id = arcs.src WHERE near.h < 24) GROUP BY id, h),
best AS (SELECT id, min(d) AS dist FROM near GROUP BY id),
par AS (SELECT y.id, x.id AS prev FROM best x JOIN arcs ON x.id = arcs.src JOIN best y ON arcs.dst = y.id AND x.dist + arcs.weight = y.dist
  WHERE y.id <> '00' QUALIFY row_number() OVER (PARTITION BY y.id ORDER BY x.dist, x.id) = 1),
walk(now, path) AS (SELECT '03', '03' UNION ALL SELECT par.prev, par.prev || '>' || walk.path FROM walk JOIN par ON walk.now = par.id)
SELECT path, (SELECT dist FROM best WHERE id = '03') AS dist FROM walk WHERE now = '00'""")
def shortest_path_trade(spark, sf_dir):
    path, d = traverse.shortest_path(t.trade_graph(spark, sf_dir), "00", "03")
    return spark.createDataFrame([(">".join(path), d)], "path string, dist double")


@query("SELECT CAST(i AS VARCHAR) AS id, 4::BIGINT AS undirected FROM (SELECT unnest(generate_series(0, 39)) AS i)")
def generate_regular(spark, sf_dir):
    return gen.build(spark, gen.random_regular(40, 4)).degrees().select("id", "undirected")


@query("SELECT * FROM (VALUES ('tetrahedron', 4::BIGINT, 6::BIGINT, 3::BIGINT), ('cube', 8, 12, 3), ('octahedron', 6, 12, 4), ('dodecahedron', 20, 30, 3), ('icosahedron', 12, 30, 5)) v(solid, vertices, edges, degree)")
def generate_platonic(spark, sf_dir):
    out = []
    for name in gen.PLATONIC:
        g = gen.build(spark, gen.platonic_solid(name))
        degrees = {r["undirected"] for r in g.degrees().select("undirected").distinct().collect()}
        out.append((name, g.vertex_count(), g.edge_count(), degrees.pop() if len(degrees) == 1 else -1))
    return spark.createDataFrame(out, "solid string, vertices long, edges long, degree long")


@query("""WITH s AS (SELECT i, i // 8 AS day, i % 8 AS step, CAST('0x' || substr(md5('1:' || i || ':1'), 1, 13) AS BIGINT) / 4503599627370496.0 AS u, CAST('0x' || substr(md5('1:' || i || ':2'), 1, 13) AS BIGINT) / 4503599627370496.0 AS v
  FROM (SELECT unnest(generate_series(0, 1999)) AS i)),
r AS (SELECT day, step, (0.0005 - 0.02 * 0.02 / 2) / 8 + 0.02 * sqrt(1.0 / 8) * sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v) AS r FROM s),
w AS (SELECT day, r, sum(r) OVER (PARTITION BY day ORDER BY step) AS w FROM r),
d AS (SELECT day, sum(r) AS total, greatest(max(w), 0) AS hi, least(min(w), 0) AS lo FROM w GROUP BY day),
b AS (SELECT *, coalesce(sum(total) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM d)
SELECT day, round(100 * exp(base), 6) AS open, round(100 * exp(base + hi), 6) AS high, round(100 * exp(base + lo), 6) AS low, round(100 * exp(base + total), 6) AS close FROM b""")
def signal_ohlc(spark, sf_dir):
    """A year of prices, from digests of their numbers."""
    o = gen.ohlc_series(spark, 250)
    return o.select("day", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")])


from . import catalog_graphs, catalog_matrices  # noqa: E402, F401  (they register themselves)
