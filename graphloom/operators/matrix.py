"""Matrices as cells (i, j, v): algebra, statistics, sanitation, adapters to graphs.

A Matrix is a frame of cells with its shape.  Cells that are absent are 0
unless the encoding says that they are +inf (distance encoding).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import cut
from .errors import GraphInputError, NegativeCycleError, NotFoundError, NumericPolicyError, ShapeError
from .graph import PropertyGraph
from .kernels import dense

EPSILON = 1e-9
COO = "i int, j int, v double"
INF = float("inf")


@dataclass
class Matrix:
    cells: DataFrame
    rows: int
    cols: int
    allow_non_finite: bool = False  # the numeric policy, which set() follows

    def __post_init__(self):
        if self.rows < 0 or self.cols < 0:
            raise ShapeError("negative dimensions")

    def with_policy(self, allow_non_finite: bool) -> Matrix:
        return replace(self, allow_non_finite=allow_non_finite)

    # -- construction ---------------------------------------------------------
    @classmethod
    def zeros(cls, spark: SparkSession, rows: int, cols: int, allow_non_finite: bool = False) -> Matrix:
        return cls(spark.createDataFrame([], COO), rows, cols, allow_non_finite)

    @classmethod
    def identity(cls, spark: SparkSession, n: int) -> Matrix:
        if n < 0:
            raise ShapeError("negative dimensions")
        r = spark.range(n).select(F.col("id").cast("int").alias("i"))
        return cls(r.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v")), n, n)

    @classmethod
    def of(cls, spark: SparkSession, values: list[list[float]], allow_non_finite: bool = False) -> Matrix:
        cols = {len(r) for r in values} or {0}
        if len(cols) > 1:
            raise ShapeError("ragged rows")
        if not allow_non_finite and any(not math.isfinite(x) for r in values for x in r):
            raise NumericPolicyError("NaN or infinity")
        return cls(spark.createDataFrame([(i, j, float(x)) for i, r in enumerate(values) for j, x in enumerate(r)], COO), len(values), cols.pop(), allow_non_finite)

    @classmethod
    def fill(cls, spark: SparkSession, rows: int, cols: int, data: list[float]) -> Matrix:
        if len(data) != rows * cols:
            raise ShapeError("data of another size")
        return cls.of(spark, [data[r * cols : (r + 1) * cols] for r in range(rows)]) if rows else cls.zeros(spark, 0, cols)

    @classmethod
    def of_arrays(cls, df: DataFrame, row: str, values: str, rows: int, cols: int) -> Matrix:
        """Rows given as (row number, array of cells)."""
        return cls(df.select(F.col(row).cast("int").alias("i"), F.posexplode(values).alias("j", "v")).select("i", "j", F.col("v").cast("double").alias("v")), rows, cols)

    def zeros_like(self) -> Matrix:
        return Matrix.zeros(self.cells.sparkSession, self.rows, self.cols)

    def identity_like(self) -> Matrix:
        self.need_square()
        return Matrix.identity(self.cells.sparkSession, self.rows)

    def clone(self) -> Matrix:
        return self

    @property
    def shape(self) -> tuple[int, int]:
        return self.rows, self.cols

    def grid(self) -> Matrix:
        """With every cell present."""
        s = self.cells.sparkSession
        all_cells = s.range(self.rows * self.cols).select((F.col("id") / max(self.cols, 1)).cast("int").alias("i"), F.pmod("id", F.lit(max(self.cols, 1))).cast("int").alias("j"))
        return Matrix(all_cells.join(self.cells, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v")), self.rows, self.cols)

    def toarray(self, most: int = 4_000_000) -> np.ndarray:
        """A dense copy on the driver, refused beyond ``most`` cells."""
        if self.rows * self.cols > most:
            raise ShapeError("too large for one place")
        out = np.zeros((self.rows, self.cols))
        t = self.cells.toArrow()
        out[t.column("i").to_numpy(), t.column("j").to_numpy()] = t.column("v").to_numpy()
        return out

    def to_string(self) -> str:
        return "".join("[" + ", ".join(f"{x:g}" for x in r) + "]\n" for r in self.toarray())

    # -- checks -----------------------------------------------------------------
    def is_zero_shape(self) -> bool:
        return not self.rows or not self.cols

    def need_nonempty(self) -> None:
        if self.is_zero_shape():
            raise ShapeError("zero shape")

    def need_square(self) -> None:
        if self.rows != self.cols:
            raise ShapeError("not square")

    def need_same(self, other: Matrix) -> None:
        if self.shape != other.shape:
            raise ShapeError("shapes differ")

    def need_finite(self) -> None:
        if self.cells.where(~finite("v")).limit(1).count():
            raise NumericPolicyError("NaN or infinity")

    def is_zero_off_diagonal(self, tol: float = 0.0) -> bool:
        return not self.cells.where(F.col("i") != F.col("j")).where(F.isnan("v") | (F.abs("v") > tol)).limit(1).count()

    def need_symmetric(self, tol: float = EPSILON) -> None:
        self.need_square()
        self.need_finite()
        if _both(self, self.transpose(), lambda a, b: a - b).cells.where(F.abs("v") > tol).limit(1).count():
            raise NumericPolicyError("not symmetric")

    def need_distances(self, eps: float = EPSILON) -> None:
        """Square, a diagonal of 0, no NaN or -inf; +inf off the diagonal only."""
        self.need_square()
        bad = F.isnan("v") | (F.col("v") == -INF) | ((F.col("i") == F.col("j")) & (F.abs("v") > eps))
        if self.cells.where(bad).limit(1).count():
            raise NumericPolicyError("not distances")

    # -- cells ---------------------------------------------------------------------
    def at(self, i: int, j: int) -> float:
        self._inside(i, j)
        got = self.cells.where((F.col("i") == i) & (F.col("j") == j)).limit(1).collect()
        return got[0]["v"] if got else 0.0

    def set(self, i: int, j: int, v: float, allow_non_finite: bool = False) -> Matrix:
        self._inside(i, j)
        if not (allow_non_finite or self.allow_non_finite) and not math.isfinite(v):
            raise NumericPolicyError("NaN or infinity")
        rest = self.cells.where(~((F.col("i") == i) & (F.col("j") == j)))
        return Matrix(rest.unionByName(self.cells.sparkSession.createDataFrame([(i, j, float(v))], COO)), *self.shape, self.allow_non_finite)

    def _inside(self, i: int, j: int) -> None:
        if not (0 <= i < self.rows and 0 <= j < self.cols):
            raise ShapeError("outside")

    def induced(self, rows: list[int], cols: list[int]) -> Matrix:
        """The listed rows and columns, in that order, repeats allowed."""
        if any(not 0 <= r < self.rows for r in rows) or any(not 0 <= c < self.cols for c in cols):
            raise ShapeError("outside")
        s = self.cells.sparkSession
        r = s.createDataFrame(list(enumerate(rows)), "ni int, i int")
        c = s.createDataFrame(list(enumerate(cols)), "nj int, j int")
        return Matrix(self.cells.join(r, "i").join(c, "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), "v"), len(rows), len(cols))

    def view(self, r0: int, c0: int, rows: int, cols: int) -> View:
        """A window; what is set in it is set in the matrix it gives back."""
        if r0 < 0 or c0 < 0 or rows < 0 or cols < 0 or r0 + rows > self.rows or c0 + cols > self.cols:
            raise ShapeError("outside")
        w = self.cells.where(F.col("i").between(r0, r0 + rows - 1) & F.col("j").between(c0, c0 + cols - 1))
        return View(w.select((F.col("i") - r0).alias("i"), (F.col("j") - c0).alias("j"), "v"), rows, cols, self.allow_non_finite, self, r0, c0)

    def do(self, f) -> None:
        """f(i, j, v) in row-major order until it returns False; cells stream to the driver."""
        for r in self.grid().cells.orderBy("i", "j").toLocalIterator():
            if f(r["i"], r["j"], r["v"]) is False:
                return

    def apply(self, f, dense_cells: bool = True) -> Matrix:
        """Cells to f(i, j, v), a Column of Columns."""
        m = self.grid() if dense_cells else self
        return Matrix(m.cells.select("i", "j", f(F.col("i"), F.col("j"), F.col("v")).cast("double").alias("v")), *self.shape)

    # -- algebra ------------------------------------------------------------------
    def transpose(self) -> Matrix:
        return Matrix(self.cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.cols, self.rows)

    T = property(transpose)

    def scale(self, a: float) -> Matrix:
        return Matrix(self.cells.withColumn("v", F.col("v") * F.lit(float(a))), *self.shape)

    def add(self, b: Matrix) -> Matrix:
        return _both(self, b, lambda x, y: x + y)

    def sub(self, b: Matrix) -> Matrix:
        return _both(self, b, lambda x, y: x - y)

    def hadamard(self, b: Matrix) -> Matrix:
        self.need_same(b)
        o = b.cells.select("i", "j", F.col("v").alias("w"))
        return Matrix(self.cells.join(o, ["i", "j"]).select("i", "j", (F.col("v") * F.col("w")).alias("v")), *self.shape)

    def mul(self, b: Matrix) -> Matrix:
        """The product; both sides meet on the inner index and sums are pre-aggregated before the shuffle."""
        if self.cols != b.rows:
            raise ShapeError("inner dimensions differ")
        x = self.cells.where("v <> 0").select("i", F.col("j").alias("k"), F.col("v").alias("x"))
        y = b.cells.where("v <> 0").select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
        return Matrix(x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v")), self.rows, b.cols)

    def mat_vec(self, x: DataFrame) -> DataFrame:
        """(i, v) of this times (j, x)."""
        p = self.cells.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))
        return self._every_row(p, "v")

    def symmetrize(self) -> Matrix:
        self.need_square()
        return _both(self, self.transpose(), lambda x, y: (x + y) / 2)

    def _every_row(self, p: DataFrame, v: str) -> DataFrame:
        r = self.cells.sparkSession.range(self.rows).select(F.col("id").cast("int").alias("i"))
        return r.join(p, "i", "left").select("i", F.coalesce(v, F.lit(0.0)).alias(v))

    # -- sums and statistics -------------------------------------------------------
    def row_sums(self) -> DataFrame:
        return self._every_row(self.cells.groupBy("i").agg(F.sum("v").alias("total")), "total")

    def col_sums(self) -> DataFrame:
        return self.transpose().row_sums().withColumnRenamed("i", "j")

    def col_means(self) -> DataFrame:
        return self.col_sums().select("j", (F.col("total") / max(self.rows, 1)).alias("mean"))

    def center_columns(self) -> tuple[Matrix, DataFrame]:
        m = self.col_means()
        return Matrix(self.grid().cells.join(F.broadcast(m) if self.cols <= 100_000 else m, "j").select("i", "j", (F.col("v") - F.col("mean")).alias("v")), *self.shape), m

    def center_rows(self) -> tuple[Matrix, DataFrame]:
        c, m = self.transpose().center_columns()
        return c.transpose(), m.withColumnRenamed("j", "i")

    def _normalized(self, norm: Column) -> tuple[Matrix, DataFrame]:
        n = self._every_row(self.cells.groupBy("i").agg(norm.alias("norm")), "norm")
        by = F.when(F.col("norm") == 0, F.col("v")).otherwise(F.try_divide("v", "norm"))
        return Matrix(self.cells.join(n, "i").select("i", "j", by.alias("v")), *self.shape), n

    def normalize_rows_l1(self) -> tuple[Matrix, DataFrame]:
        return self._normalized(F.sum(F.abs("v")))

    def normalize_rows_l2(self) -> tuple[Matrix, DataFrame]:
        return self._normalized(F.sqrt(F.sum(F.col("v") * F.col("v"))))

    def covariance(self) -> tuple[Matrix, DataFrame]:
        """Sample covariance of the columns, and their means.

        Rows become arrays and each partition adds up its own products, so one
        small matrix per partition is all that is shuffled.
        """
        if self.rows < 2 and self.cols:
            raise ShapeError("fewer than two rows")
        c, m = self.center_columns()
        n = self.cols
        rows = c.cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("r"))

        def of(batches):
            s = np.zeros((n, n))
            for b in batches:
                if b.num_rows:
                    x = b.column("r").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, n)
                    s += x.T @ x
            i, j = np.divmod(np.arange(n * n), max(n, 1))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(s.ravel())], ["i", "j", "v"])

        parts = rows.select("r").mapInArrow(of, COO)
        return Matrix(parts.groupBy("i", "j").agg((F.sum("v") / max(self.rows - 1, 1)).alias("v")), n, n), m

    def correlation(self) -> tuple[Matrix, DataFrame, DataFrame]:
        """Pearson correlation of the columns, their means and deviations; a constant column correlates 0 with all."""
        c, m = self.covariance()
        c = Matrix(cut(c.cells), *c.shape)
        d = c.cells.where("i = j").select(F.col("i").alias("j"), F.sqrt(F.greatest("v", F.lit(0.0))).alias("std"))
        a, b = d.select(F.col("j").alias("i"), F.col("std").alias("si")), d.select("j", F.col("std").alias("sj"))
        r = c.cells.join(a, "i").join(b, "j")
        v = F.when((F.col("si") == 0) | (F.col("sj") == 0), 0.0).when(F.col("i") == F.col("j"), 1.0).otherwise(F.try_divide("v", F.col("si") * F.col("sj")))
        return Matrix(r.select("i", "j", v.alias("v")), *c.shape), m, d

    # -- sanitation ------------------------------------------------------------------
    def replace_non_finite(self, by: float) -> Matrix:
        return Matrix(self.cells.withColumn("v", F.when(finite("v"), F.col("v")).otherwise(F.lit(float(by)))), *self.shape)

    def clip(self, lo: float, hi: float) -> Matrix:
        lo, hi = min(lo, hi), max(lo, hi)
        return self.apply(lambda i, j, v: F.when(F.isnan(v), v).when(v < lo, lo).when(v > hi, hi).otherwise(v))

    def all_close(self, b: Matrix, rtol: float = 1e-5, atol: float = 1e-8) -> bool:
        self.need_same(b)
        o = b.cells.select("i", "j", F.col("v").alias("w"))
        j = self.cells.join(o, ["i", "j"], "full").na.fill(0.0, ["v", "w"])
        x, y = F.col("v"), F.col("w")
        inf = x.isin(INF, -INF) | y.isin(INF, -INF)
        ok = ~(F.isnan(x) | F.isnan(y)) & F.when(inf, x == y).otherwise(F.abs(x - y) <= atol + rtol * F.abs(y))
        return not j.where(~ok).limit(1).count()

    # -- kernels: one matrix in one place -----------------------------------------------
    def _kernel(self, f, *args):
        self.need_square()
        return f(self.toarray(), *args)

    def lu(self):
        return self._kernel(dense.lu)

    def qr(self):
        return self._kernel(dense.qr)

    def inverse(self):
        return self._kernel(dense.inverse)

    def eigen_sym(self, tol: float = EPSILON, max_iter: int = 10_000):
        self.need_symmetric(max(tol, EPSILON))
        return self._kernel(dense.jacobi, tol, max_iter)


@dataclass
class View(Matrix):
    """A window on a matrix from (r0, c0)."""

    parent: Matrix | None = None
    r0: int = 0
    c0: int = 0

    def set(self, i: int, j: int, v: float, allow_non_finite: bool = False) -> View:
        """The window on the changed matrix, which is its ``parent``."""
        self._inside(i, j)
        return self.parent.set(self.r0 + i, self.c0 + j, v, allow_non_finite).view(self.r0, self.c0, self.rows, self.cols)


def need(m: Matrix | None) -> Matrix:
    """The matrix, which has to be one."""
    if m is None or m.cells is None:
        raise GraphInputError("no matrix")
    return m


def need_length(x, n: int) -> None:
    """A vector of n numbers: a sequence, or a frame of rows."""
    size = x.count() if isinstance(x, DataFrame) else None if x is None else len(x)
    if size != n:
        raise ShapeError(f"a vector of {size}, not {n}")


def finite(c: str) -> Column:
    return ~(F.isnan(c) | F.col(c).isin(INF, -INF))


def _both(a: Matrix, b: Matrix, f) -> Matrix:
    a.need_same(b)
    o = b.cells.select("i", "j", F.col("v").alias("w"))
    j = a.cells.join(o, ["i", "j"], "full").na.fill(0.0, ["v", "w"])
    return Matrix(j.select("i", "j", f(F.col("v"), F.col("w")).alias("v")), *a.shape)


# -- adapters -------------------------------------------------------------------------
@dataclass(frozen=True)
class MatrixOptions:
    directed: bool = False
    multi: bool = True  # the later edge, by ID, overwrites; else the first one wins
    loops: bool = True
    weighted: bool = True
    preserve_zero: bool = False
    inf_distances: bool = False
    metric_closure: bool = False
    epsilon: float = EPSILON

    def __post_init__(self):
        if not (self.epsilon > 0 and math.isfinite(self.epsilon)):
            raise NumericPolicyError("epsilon")


@dataclass
class Adjacency:
    """A matrix with the vertices' numbers (idx, id); absent says what a missing cell means."""

    matrix: Matrix
    index: DataFrame
    options: MatrixOptions
    absent: float = 0.0
    closed: bool = field(default=False)

    def vertex_ids(self) -> DataFrame:
        return self.index.orderBy("idx")

    def vertex_count(self) -> int:
        n = self.index.count()
        if n != self.matrix.rows:
            raise ShapeError("index and matrix differ")
        return n

    def validate(self) -> Adjacency:
        """Square, numbered without gaps, no NaN, and symmetric where undirected."""
        need(self.matrix).need_square()
        n = self.vertex_count()
        ix = self.index.agg(F.count_distinct("idx").alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count_distinct("id").alias("ids")).first()
        if n and (ix["n"], ix["lo"], ix["hi"], ix["ids"]) != (n, 0, n - 1, n):
            raise ShapeError("the index does not number the rows")
        if self.matrix.cells.where("isnan(v)").limit(1).count():
            raise NumericPolicyError("NaN")
        if not self.options.directed:
            c = self.matrix.cells
            o = c.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("v").alias("w"))
            if c.join(o, ["i", "j"], "left").where("w is null or v <> w").limit(1).count():
                raise NumericPolicyError("not symmetric")
        return self

    def neighbors(self, vid: str) -> DataFrame:
        at = self.index.where(F.col("id") == vid).limit(1).collect()
        if not at:
            raise NotFoundError(vid)
        c = self.matrix.cells.where((F.col("i") == at[0]["idx"]) & (F.col("j") != at[0]["idx"]))
        c = c.where(finite("v")) if self.absent else c.where("v <> 0")
        return c.join(self.index, F.col("j") == F.col("idx")).select("idx", "id").orderBy("idx").select("id")

    def degree_vector(self) -> DataFrame:
        """(id, degree): sums of weights, or counts where unweighted; a loop counts 1."""
        c = self.matrix.cells.where(finite("v"))
        if self.absent:
            c = c.where("i <> j or v <> 0")
        w = F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("v") if self.options.weighted else F.lit(1.0))
        d = c.where("v <> 0").groupBy("i").agg(F.sum(w).alias("degree")) if not self.absent else c.groupBy("i").agg(F.sum(w).alias("degree"))
        return self.index.join(d, F.col("idx") == F.col("i"), "left").select("id", F.coalesce("degree", F.lit(0.0)).alias("degree"))

    def to_graph(self, threshold: float | None = None, keep_weights: bool = True) -> PropertyGraph:
        """Cells above the threshold (0.5 where absence is 0) as edges; a closure is refused."""
        if self.closed:
            raise GraphInputError("a metric closure is no adjacency")
        c = self.matrix.cells.where(finite("v"))
        t = threshold if threshold is not None else (None if self.absent else 0.5)
        if t is not None:
            c = c.where(F.col("v") > t)
        if self.absent and threshold is None:
            c = c.where("i <> j or v <> 0")
        if not self.options.directed:
            c = c.where("i <= j")
        a, b = self.index.select(F.col("idx").alias("i"), F.col("id").alias("src")), self.index.select(F.col("idx").alias("j"), F.col("id").alias("dst"))
        e = c.join(a, "i").join(b, "j").select("src", "dst", (F.col("v") if keep_weights else F.lit(1.0)).alias("weight"))
        return PropertyGraph.from_edges(e, self.index.select("id"), check=False, directed=self.options.directed, weighted=True, loops=True)


def vertex_index(g: PropertyGraph) -> DataFrame:
    from ..plans.iterate import numbered

    return numbered(g.vertices.select("id"), "id", name="idx").select(F.col("idx").cast("int").alias("idx"), "id")


def adjacency(g: PropertyGraph, options: MatrixOptions = MatrixOptions()) -> Adjacency:
    """Vertices in the order of their IDs; what a missing edge means follows the weights.

    All weights 0: cells are 1 unless zeros are preserved.  Some 0, some not:
    absence is +inf.  The matrix's direction is the options', not the edges'.
    """
    index = vertex_index(g)
    n = index.count()
    e = g.edges if options.loops else g.edges.where("src <> dst")
    some = e.agg(F.bool_or(F.col("weight") == 0).alias("zero"), F.bool_or(F.col("weight") != 0).alias("other")).first()
    zero, other = bool(some["zero"]), bool(some["other"])
    binary = not options.weighted or (zero and not other and not options.preserve_zero)
    inf = options.inf_distances or options.metric_closure or (options.weighted and ((zero and other) or (zero and options.preserve_zero)))
    a, b = index.select(F.col("idx").alias("i"), F.col("id").alias("src")), index.select(F.col("idx").alias("j"), F.col("id").alias("dst"))
    c = e.join(a, "src").join(b, "dst").select("i", "j", (F.lit(1.0) if binary else F.col("weight")).alias("v"), "edge_id")
    if not options.directed:
        c = c.unionByName(c.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v", "edge_id"))
    pick = F.max_by("v", "edge_id") if options.multi else F.min_by("v", "edge_id")
    m = Matrix(cut(c.groupBy("i", "j").agg(pick.alias("v"))), n, n)
    out = Adjacency(m, index, options, INF if inf else 0.0)
    return metric_closure(out) if options.metric_closure else out


class Incidence(NamedTuple):
    """(matrix, vertices (idx, id), columns (idx, edge_id, src, dst))."""

    matrix: Matrix
    index: DataFrame
    columns: DataFrame

    def vertex_count(self) -> int:
        return self.matrix.rows

    def edge_count(self) -> int:
        return self.matrix.cols

    def vertex_incidence(self, vid: str) -> DataFrame:
        """(j, v): a vertex's row, every column in it."""
        at = self.index.where(F.col("id") == vid).limit(1).collect()
        if not at:
            raise NotFoundError(vid)
        row = self.matrix.cells.where(F.col("i") == at[0]["idx"]).select("j", "v")
        return self.columns.select(F.col("idx").alias("j")).join(row, "j", "left").select("j", F.coalesce("v", F.lit(0.0)).alias("v"))

    def edge_endpoints(self, j: int) -> tuple[str, str]:
        got = self.columns.where(F.col("idx") == j).limit(1).collect()
        if not got:
            raise ShapeError("outside")
        return got[0]["src"], got[0]["dst"]


def incidence(g: PropertyGraph, options: MatrixOptions = MatrixOptions()) -> Incidence:
    """(matrix, vertices (idx, id), columns (idx, edge_id, src, dst)).

    Directed: -1 at the source, +1 at the target, loops left out; undirected:
    +1 at both ends, +2 for a loop.
    """
    from ..plans.iterate import first_by, numbered

    index = vertex_index(g)
    e = g.edges.where("src <> dst") if options.directed or not options.loops else g.edges
    if not options.multi:
        e = e.withColumn("p", F.col("src") if options.directed else F.least("src", "dst")).withColumn("q", F.col("dst") if options.directed else F.greatest("src", "dst"))
        e = first_by(e, ["p", "q"], ["edge_id"])
    cols = numbered(e.select("edge_id", "src", "dst"), "edge_id", name="idx").select(F.col("idx").cast("int").alias("idx"), "edge_id", "src", "dst")
    ends = cols.select(F.col("idx").alias("j"), F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(-1.0 if options.directed else 1.0).alias("v")), F.struct(F.col("dst").alias("id"), F.lit(1.0).alias("v")))).alias("x")).select("j", "x.id", "x.v")
    cells = ends.join(index, "id").groupBy(F.col("idx").alias("i"), "j").agg(F.sum("v").alias("v"))
    return Incidence(Matrix(cells, index.count(), cols.count()), index, cols)


def init_distances(a: Adjacency) -> Matrix:
    """Distance encoding: 0 off the diagonal is no edge, the diagonal is 0 unless negative."""
    m = a.matrix
    c = m.cells.where("i <> j" if a.absent else "i <> j and v <> 0").unionByName(
        m.cells.sparkSession.range(m.rows).select(F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"), F.lit(0.0).alias("v"))
    )
    loops = m.cells.where("i = j and v < 0")
    return Matrix(c.unionByName(loops).groupBy("i", "j").agg(F.min("v").alias("v")), *m.shape)


def floyd_warshall(m: Matrix, most: int = 2000, eps: float = EPSILON) -> Matrix:
    """All shortest distances of a matrix in distance encoding (absent cells: none).

    Up to ``most`` vertices one Arrow task runs the pivots in order; beyond
    that every row is relaxed against the edges in rounds, which needs no task
    to hold more than its rows.  A negative cycle is an error.
    """
    m.need_square()
    if m.rows <= most:
        n = m.rows

        def run(t: pa.Table) -> pa.Table:
            d = np.full((n, n), INF)
            d[t.column("i").to_numpy(), t.column("j").to_numpy()] = t.column("v").to_numpy()
            d = dense.floyd_warshall(d)
            i, j = np.nonzero(np.isfinite(d))
            return pa.table({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": d[i, j]})

        out = cut(m.cells.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(run, COO))
    else:
        arcs = cut(m.cells.where("i <> j").select(F.col("i").alias("k"), F.col("j").alias("to"), F.col("v").alias("w")))
        out = new = cut(m.cells)
        for r in range(m.rows + 1):
            cand = new.join(arcs, F.col("j") == F.col("k")).groupBy("i", F.col("to").alias("j")).agg(F.min(F.col("v") + F.col("w")).alias("c"))
            new = cut(cand.join(out, ["i", "j"], "left").where("v is null or c < v").select("i", "j", F.col("c").alias("v")))
            if not new.limit(1).count():
                break
            if r == m.rows or new.where(f"i = j and v < {-eps}").limit(1).count():
                raise NegativeCycleError("negative cycle")
            out = cut(out.join(new, ["i", "j"], "left_anti").unionByName(new))
    if out.where(f"i = j and v < {-eps}").limit(1).count():
        raise NegativeCycleError("negative cycle")
    return Matrix(out, *m.shape)


def metric_closure(a: Adjacency) -> Adjacency:
    return a if a.closed else Adjacency(floyd_warshall(init_distances(a)), a.index, a.options, INF, True)


