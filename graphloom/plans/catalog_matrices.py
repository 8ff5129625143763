"""Further registered queries: matrices, their checks and the adapters between graphs and matrices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matrix as mx
from ..operators.errors import EngineError
from ..operators.graph import PropertyGraph
from ..sources import tables as t
from .catalog import _ARCS, _M, _SESSION, _TRADE, _features, query
from .iterate import cut


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _raises(f) -> bool:
    try:
        f()
    except EngineError:
        return True
    return False


def _tagged(parts: dict[str, mx.Matrix], name: str = "op") -> DataFrame:
    return _union([m.cells.select(F.lit(k).alias(name), "i", "j", "v") for k, m in parts.items()])


def _trade_matrix(spark, sf_dir) -> mx.Matrix:
    c = t.trade_arcs(spark, sf_dir).select(F.col("src").cast("int").alias("i"), F.col("dst").cast("int").alias("j"), F.col("weight").alias("v"))
    return mx.Matrix(cut(c), 25, 25)


_X = f"{_TRADE}, x AS (SELECT CAST(src AS INTEGER) AS i, CAST(dst AS INTEGER) AS j, weight AS v FROM trade)"
_FULL = f"{_X}, y AS (SELECT coalesce(a.i, b.j) AS i, coalesce(a.j, b.i) AS j, coalesce(a.v, 0) AS v, coalesce(b.v, 0) AS w FROM x a FULL JOIN x b ON a.i = b.j AND a.j = b.i)"


@query(f"""WITH {_FULL} SELECT 'add' AS op, i, j, v + w AS v FROM y UNION ALL SELECT 'sub', i, j, v - w FROM y UNION ALL SELECT 'scale', i, j, v * 0.5 FROM x
UNION ALL SELECT 'hadamard', a.i, a.j, a.v * b.v FROM x a JOIN x b ON a.i = b.j AND a.j = b.i UNION ALL SELECT 'transpose', j, i, v FROM x""")
def matrix_elementwise_trade(spark, sf_dir):
    """Trade with its transpose: sum, difference, cellwise product; and half of it."""
    m = _trade_matrix(spark, sf_dir)
    return _tagged({"add": m.add(m.T), "sub": m.sub(m.T), "scale": m.scale(0.5), "hadamard": m.hadamard(m.T), "transpose": m.transpose()})


@query(f"WITH {_X}, r AS (SELECT i, sum(v * (j + 1)) AS v FROM x GROUP BY i) SELECT CAST(n AS INTEGER) AS i, coalesce(v, 0.0) AS v FROM (SELECT unnest(generate_series(0, 24)) AS n) LEFT JOIN r ON n = i")
def mat_vec_trade(spark, sf_dir):
    """Trade times 1, 2, ..., 25."""
    x = spark.range(25).select(F.col("id").cast("int").alias("j"), (F.col("id") + 1).cast("double").alias("x"))
    return _trade_matrix(spark, sf_dir).mat_vec(x)


@query(f"""WITH {_M}, r AS (SELECT * FROM (VALUES (0, 2), (1, 0), (2, 2)) v(ni, i)), c AS (SELECT * FROM (VALUES (0, 5), (1, 63)) v(nj, j))
SELECT 'induced' AS op, ni AS i, nj AS j, v FROM m JOIN r ON m.i = r.i JOIN c ON m.j = c.j
UNION ALL SELECT 'view', CAST(i - 1 AS INTEGER), CAST(j - 60 AS INTEGER), v FROM m WHERE i BETWEEN 1 AND 3 AND j BETWEEN 60 AND 63
UNION ALL SELECT 'view_set', CAST(i AS INTEGER), CAST(j AS INTEGER), CASE WHEN i = 2 AND j = 61 THEN -7.5 ELSE v END FROM m WHERE i < 4
UNION ALL SELECT 'at', 0, 0, v FROM m WHERE i = 3 AND j = 7 UNION ALL SELECT 'set', 0, 0, 9.0""")
def matrix_windows_features(spark, sf_dir):
    """Chosen rows and columns, a window, what is set through a window, and single cells."""
    m = _features(spark, sf_dir)
    w = m.view(1, 60, 3, 4)
    one = lambda v: mx.Matrix.of(spark, [[v]])
    changed = w.set(1, 1, -7.5).parent
    return _tagged({
        "induced": m.induced([2, 0, 2], [5, 63]), "view": w, "view_set": mx.Matrix(changed.cells.where("i < 4"), 4, 64),
        "at": one(m.at(3, 7)), "set": one(m.set(4, 4, 9.0).at(4, 4)),
    })


@query(f"""WITH {_M}, s AS (SELECT max(i) + 1 AS n FROM m) SELECT name, CAST(r AS BIGINT) AS rows, CAST(c AS BIGINT) AS cols, total FROM (
SELECT 'zeros' AS name, 4 AS r, 3 AS c, 0.0::DOUBLE AS total UNION ALL SELECT 'identity', 5, 5, 5.0 UNION ALL SELECT 'zeros_like', n, 64, 0.0 FROM s UNION ALL SELECT 'identity_like', 64, 64, 64.0
UNION ALL SELECT 'dense', 2, 2, 10.0 UNION ALL SELECT 'fill', 2, 3, 21.0 UNION ALL SELECT 'prepared', 3, 3, 'infinity'::DOUBLE
UNION ALL SELECT 'clone', s.n, 64, (SELECT round(sum(v), 6) FROM m) FROM s UNION ALL SELECT 'applied', s.n, 64, (SELECT round(sum(v * 2 + j), 6) FROM m) FROM s
UNION ALL SELECT 'walked', 2, 2, 6.0 UNION ALL SELECT 'text', 2, 2, 14.0)""")
def matrix_constructors(spark, sf_dir):
    """Shapes and sums of matrices made in every way; how far a walk over cells went, and how long a text is."""
    m = _features(spark, sf_dir)
    d = mx.Matrix.of(spark, [[1.0, 2.0], [3.0, 4.0]])
    prepared = mx.Matrix.zeros(spark, 3, 3, allow_non_finite=True).set(1, 1, float("inf"))
    made = {
        "zeros": mx.Matrix.zeros(spark, 4, 3), "identity": mx.Matrix.identity(spark, 5), "zeros_like": m.zeros_like(), "identity_like": m.T.mul(m).identity_like(),
        "dense": d, "fill": mx.Matrix.fill(spark, 2, 3, [1, 2, 3, 4, 5, 6]), "prepared": prepared, "clone": m.clone(), "applied": m.apply(lambda i, j, v: v * 2 + j),
    }
    rows = [x.cells.agg(F.coalesce(F.round(F.sum("v"), 6), F.lit(0.0)).alias("total")).select(F.lit(k).alias("name"), F.lit(x.rows).cast("long").alias("rows"), F.lit(x.cols).cast("long").alias("cols"), "total") for k, x in made.items()]
    seen: list[float] = []
    d.do(lambda i, j, v: seen.append(v) or (i, j) != (1, 0))
    rows.append(spark.createDataFrame([("walked", *d.shape, float(sum(seen))), ("text", *d.shape, float(len(d.to_string())))], "name string, rows long, cols long, total double"))
    return _union(rows)


_CHECKS = "zero_shape nonempty square not_square same_shape other_shape finite not_finite off_diagonal symmetric not_symmetric distances no_distances inner no_matrix length other_length policy close not_close all_rows adjacency ragged".split()


@query("SELECT op, true AS ok FROM (VALUES " + ", ".join(f"('{c}')" for c in _CHECKS) + ") v(op)")
def matrix_checks(spark, sf_dir):
    """Every check accepts what it should and refuses what it should."""
    m = _features(spark, sf_dir)
    g = m.T.mul(m)
    d = mx.Matrix.of(spark, [[0.0, 2.0], [3.0, 0.0]])
    inf = float("inf")
    bad = mx.Matrix.of(spark, [[0.0, inf], [1.0, 0.0]], allow_non_finite=True)
    a = mx.adjacency(t.trade_graph(spark, sf_dir, directed=False))
    broken = mx.Adjacency(d, a.index, a.options)
    x = spark.range(64).select(F.col("id").alias("x"))
    ok = {
        "zero_shape": mx.Matrix.zeros(spark, 0, 3).is_zero_shape() and not m.is_zero_shape(), "nonempty": _raises(mx.Matrix.zeros(spark, 2, 0).need_nonempty) and not _raises(m.need_nonempty),
        "square": not _raises(g.need_square), "not_square": _raises(m.need_square), "same_shape": not _raises(lambda: m.need_same(m)), "other_shape": _raises(lambda: m.need_same(g)),
        "finite": not _raises(m.need_finite), "not_finite": _raises(bad.need_finite), "off_diagonal": g.identity_like().is_zero_off_diagonal() and not g.is_zero_off_diagonal(),
        "symmetric": not _raises(lambda: g.need_symmetric(1e-6)), "not_symmetric": _raises(d.need_symmetric), "distances": not _raises(bad.need_distances), "no_distances": _raises(g.need_distances),
        "inner": _raises(lambda: m.mul(m)), "no_matrix": _raises(lambda: mx.need(None)) and mx.need(m) is m, "length": not _raises(lambda: mx.need_length(x, 64)), "other_length": _raises(lambda: mx.need_length([1.0], 2)),
        "policy": _raises(lambda: d.set(0, 0, inf)) and not _raises(lambda: d.with_policy(True).set(0, 0, inf)), "close": m.all_close(m.scale(1 + 1e-9)), "not_close": not m.all_close(m.scale(1.1)),
        "all_rows": m.grid().cells.count() == m.rows * m.cols, "adjacency": not _raises(a.validate) and _raises(broken.validate), "ragged": _raises(lambda: mx.Matrix.of(spark, [[1.0], [1.0, 2.0]])),
    }
    return spark.createDataFrame([(c, bool(ok[c])) for c in _CHECKS], "op string, ok boolean")


@query(f"""WITH {_M} SELECT 'center_rows' AS op, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(v - avg(v) OVER (PARTITION BY i), 6) AS v FROM m
UNION ALL SELECT 'normalize_l1', CAST(i AS INTEGER), CAST(j AS INTEGER), round(v / sum(abs(v)) OVER (PARTITION BY i), 6) FROM m
UNION ALL SELECT 'replaced', CAST(i AS INTEGER), CAST(j AS INTEGER), CASE WHEN i = j THEN -1.0 ELSE round(v, 6) END FROM m""")
def row_statistics_features(spark, sf_dir):
    """Rows centred, rows divided by their absolute sums, and what is not finite replaced."""
    m = _features(spark, sf_dir)
    odd = m.apply(lambda i, j, v: F.when(i == j, F.when(i % 2 == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).otherwise(v), dense_cells=False)
    parts = {"center_rows": m.center_rows()[0], "normalize_l1": m.normalize_rows_l1()[0], "replaced": odd.replace_non_finite(-1.0)}
    return _tagged(parts).select("op", "i", "j", (F.round("v", 6) + 0.0).alias("v"))


# -- adapters -------------------------------------------------------------------------------
_TWICE = _SESSION + """, tw AS (SELECT 'a:' || src || '>' || dst AS e, src, dst, weight AS w FROM sess UNION ALL SELECT 'b:' || src || '>' || dst, src, dst, weight + 1 FROM sess),
ix AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS n FROM (SELECT src AS id FROM sess UNION SELECT dst FROM sess)),
c AS (SELECT a.n AS i, b.n AS j, e, w FROM tw JOIN ix a ON src = a.id JOIN ix b ON dst = b.id), ways AS (SELECT * FROM c UNION ALL SELECT j, i, e, w FROM c WHERE i <> j)"""


def _twice(spark, sf_dir) -> PropertyGraph:
    """Sessions with every edge twice, the second heavier by one."""
    e = t.session_graph(spark, sf_dir).edges
    both = e.withColumn("edge_id", F.concat(F.lit("a:"), "edge_id")).unionByName(e.withColumn("edge_id", F.concat(F.lit("b:"), "edge_id")).withColumn("weight", F.col("weight") + 1))
    return PropertyGraph.from_edges(both, directed=True, weighted=True, loops=True, multi=True)


@query(f"""WITH {_TWICE}, o AS (
SELECT 'last' AS op, i, j, arg_max(w, e) AS v FROM c GROUP BY i, j UNION ALL SELECT 'first', i, j, arg_min(w, e) FROM c GROUP BY i, j
UNION ALL SELECT 'no_loops', i, j, arg_max(w, e) FROM c WHERE i <> j GROUP BY i, j UNION ALL SELECT 'unweighted', i, j, 1.0 FROM c GROUP BY i, j
UNION ALL SELECT 'undirected', i, j, arg_max(w, e) FROM ways GROUP BY i, j)
SELECT * FROM o""")
def adjacency_options_sessions(spark, sf_dir):
    """What parallel edges, loops, weights and direction become under each option."""
    g = _twice(spark, sf_dir)
    o = {"last": {}, "first": {"multi": False}, "no_loops": {"loops": False}, "unweighted": {"weighted": False}, "undirected": {"directed": False}}
    return _tagged({k: mx.adjacency(g, mx.MatrixOptions(**{"directed": True, **kw})).matrix for k, kw in o.items()})


@query(f"""WITH {_ARCS}, z AS (SELECT src, dst, CASE WHEN weight > 1000 THEN 0.0 ELSE weight END AS w FROM arcs)
SELECT 'zeros_count' AS op, (SELECT count(*) FROM z) AS cells, CAST((SELECT sum(w) FROM z) AS DOUBLE) AS total, 'inf' AS absent
UNION ALL SELECT 'all_zero', (SELECT count(*) FROM z), CAST((SELECT count(*) FROM z) AS DOUBLE), '0.0' UNION ALL SELECT 'all_zero_kept', (SELECT count(*) FROM z), 0.0, 'inf'
UNION ALL SELECT 'inf_distances', (SELECT count(*) FROM z), (SELECT sum(weight) FROM arcs), 'inf' UNION ALL SELECT 'plain', (SELECT count(*) FROM z), (SELECT sum(weight) FROM arcs), '0.0'""")
def adjacency_zeros_trade(spark, sf_dir):
    """What a missing cell means, by the weights and the options."""
    g = t.trade_graph(spark, sf_dir)
    some = g._with(edges=g.edges.withColumn("weight", F.when(F.col("weight") > 1000, 0.0).otherwise(F.col("weight"))))
    none = g._with(edges=g.edges.withColumn("weight", F.lit(0.0)))
    opt = lambda **kw: mx.MatrixOptions(directed=True, **kw)
    made = {"zeros_count": mx.adjacency(some, opt()), "all_zero": mx.adjacency(none, opt()), "all_zero_kept": mx.adjacency(none, opt(preserve_zero=True)), "inf_distances": mx.adjacency(g, opt(inf_distances=True)), "plain": mx.adjacency(g, opt())}
    return _union([a.matrix.cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("v").alias("total")).select(F.lit(k).alias("op"), "cells", "total", F.lit(str(a.absent)).alias("absent")) for k, a in made.items()])


@query(f"""WITH {_ARCS} SELECT 'kept' AS op, src, dst, weight FROM arcs WHERE weight > 0.5 UNION ALL SELECT 'threshold', src, dst, weight FROM arcs WHERE weight > 1000
UNION ALL SELECT 'binary', src, dst, 1.0 FROM arcs WHERE weight > 1000""")
def matrix_to_graph_trade(spark, sf_dir):
    """A matrix back to a graph: all of it, above a threshold, and without weights."""
    a = mx.adjacency(t.trade_graph(spark, sf_dir), mx.MatrixOptions(directed=True))
    g = {"kept": a.to_graph(), "threshold": a.to_graph(threshold=1000.0), "binary": a.to_graph(threshold=1000.0, keep_weights=False)}
    return _union([x.edges.select(F.lit(k).alias("op"), "src", "dst", "weight") for k, x in g.items()])


@query(f"""WITH {_ARCS} SELECT 'neighbor' AS op, dst AS id FROM arcs WHERE src = '04' UNION ALL SELECT 'vertex', id FROM ids UNION ALL SELECT 'count', CAST(count(*) AS VARCHAR) FROM ids""")
def adjacency_lookups_trade(spark, sf_dir):
    a = mx.adjacency(t.trade_graph(spark, sf_dir), mx.MatrixOptions(directed=True))
    n = spark.createDataFrame([("count", str(a.vertex_count()))], "op string, id string")
    return _union([a.neighbors("04").select(F.lit("neighbor").alias("op"), "id"), a.vertex_ids().select(F.lit("vertex").alias("op"), "id"), n])


@query(f"""WITH {_SESSION}, cx AS (SELECT src, dst, row_number() OVER (ORDER BY src || '>' || dst) - 1 AS j FROM sess WHERE src <> dst), f AS (SELECT min(src) AS id FROM sess)
SELECT 'row' AS op, CAST(j AS VARCHAR) AS a, CASE WHEN src = id THEN '-1.0' WHEN dst = id THEN '1.0' ELSE '0.0' END AS b FROM cx, f
UNION ALL SELECT 'ends', src, dst FROM cx WHERE j = 3
UNION ALL SELECT 'counts', (SELECT CAST(count(*) AS VARCHAR) FROM (SELECT src FROM sess UNION SELECT dst FROM sess)), (SELECT CAST(count(*) AS VARCHAR) FROM cx)""")
def incidence_lookups_sessions(spark, sf_dir):
    """A vertex's row of the incidence matrix, a column's ends, and both counts."""
    g = t.session_graph(spark, sf_dir)
    b = mx.incidence(g, mx.MatrixOptions(directed=True))
    first = g.edges.agg(F.min("src")).first()[0]
    row = b.vertex_incidence(first).select(F.lit("row").alias("op"), F.col("j").cast("string").alias("a"), F.col("v").cast("string").alias("b"))
    rest = spark.createDataFrame([("ends", *b.edge_endpoints(3)), ("counts", str(b.vertex_count()), str(b.edge_count()))], "op string, a string, b string")
    return row.unionByName(rest)


@query(f"""WITH RECURSIVE {_ARCS}, r(s, id, d, h) AS (
  SELECT id, id, 0.0::DOUBLE, 0 FROM ids
  UNION SELECT s, id, min(d), h FROM (SELECT r.s, arcs.dst AS id, r.d + arcs.weight AS d, r.h + 1 AS h FROM r JOIN arcs ON r.id = arcs.src WHERE r.h < 24) GROUP BY s, id, h)
SELECT CAST(s AS INTEGER) AS i, CAST(id AS INTEGER) AS j, min(d) AS v FROM r GROUP BY s, id""")
def apsp_rounds_trade(spark, sf_dir):
    """All distances by rounds of relaxation, which no task has to hold at once."""
    a = mx.adjacency(t.trade_graph(spark, sf_dir), mx.MatrixOptions(directed=True))
    return mx.floyd_warshall(mx.init_distances(a), most=0).cells


@query(f"""WITH RECURSIVE {_ARCS}, r(s, id, d, h) AS (
  SELECT id, id, 0.0::DOUBLE, 0 FROM ids
  UNION SELECT s, id, min(d), h FROM (SELECT r.s, arcs.dst AS id, r.d + arcs.weight AS d, r.h + 1 AS h FROM r JOIN arcs ON r.id = arcs.src WHERE r.h < 24) GROUP BY s, id, h)
SELECT CAST(s AS INTEGER) AS i, CAST(id AS INTEGER) AS j, min(d) AS v FROM r GROUP BY s, id""")
def apsp_option_trade(spark, sf_dir):
    """The same as an option of the adjacency."""
    return mx.adjacency(t.trade_graph(spark, sf_dir), mx.MatrixOptions(directed=True, metric_closure=True)).matrix.cells
