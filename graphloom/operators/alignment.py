"""Dynamic time warping: a Catalyst fold for distances, an Arrow kernel where a path or tables are asked for."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import NumericPolicyError, ShapeError, UnreachableError

EPS = 1e-9
INF = float("inf")


def absolute(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def squared(a: Column, b: Column) -> Column:
    return (a - b) * (a - b)


def distance(a: str, b: str, window: int | None = None, penalty: float = 0.0, cost: Callable[[Column, Column], Column] = absolute) -> Column:
    """The distance of two array columns, one row of the table at a time, all in the JVM.

    window: |i - j| is at most this (never widened; +inf where no path
    fits).  penalty is added to steps along one series only.
    """
    _checked(window, penalty)
    x, y = F.col(a), F.col(b)
    inf, pen = F.lit(INF), F.lit(float(penalty))
    indexed = F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    first = F.transform(y, lambda v, j: F.lit(INF))

    def row(prev: Column, e: Column) -> Column:
        # prev: struct(row, diag) where diag stands left of the row's first cell.
        def cell(acc: Column, t: Column) -> Column:
            best = F.least(acc["diag"], t["up"] + pen, acc["left"] + pen)
            v = cost(e["v"], t["y"]) + best
            if window is not None:
                v = F.when(F.abs(e["i"] - t["j"]) <= window, v).otherwise(inf)
            return F.struct(F.concat(acc["out"], F.array(v)).alias("out"), v.alias("left"), t["up"].alias("diag"))

        cells = F.zip_with(y, prev["row"], lambda v, u: F.struct(v.alias("y"), u.alias("up")))
        cells = F.transform(cells, lambda s, j: F.struct(s["y"].alias("y"), s["up"].alias("up"), j.alias("j")))
        start = F.struct(F.array().cast("array<double>").alias("out"), inf.alias("left"), prev["diag"].alias("diag"))
        out = F.aggregate(cells, start, cell)
        return F.struct(out["out"].alias("row"), inf.alias("diag"))

    table = F.aggregate(indexed, F.struct(first.alias("row"), F.lit(0.0).alias("diag")), row)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.element_at(table["row"], -1))


def _checked(window: int | None, penalty: float) -> None:
    if window is not None and window < 0:
        raise NumericPolicyError("window")
    if not math.isfinite(penalty) or penalty < 0:
        raise NumericPolicyError("slope penalty")


def table_of(cost: np.ndarray, window: int | None = None, penalty: float = 0.0) -> np.ndarray:
    """The accumulated (n + 1) x (m + 1) table; anti-diagonals are filled at once."""
    n, m = cost.shape
    d = np.full((n + 1, m + 1), INF)
    d[0, 0] = 0
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        j = s - i
        if window is not None:
            ok = np.abs(i - j) <= window
            i, j = i[ok], j[ok]
        if len(i):
            d[i, j] = cost[i - 1, j - 1] + np.minimum(d[i - 1, j - 1], np.minimum(d[i - 1, j], d[i, j - 1]) + penalty)
    return d


def path_of(d: np.ndarray, cost: np.ndarray, penalty: float = 0.0) -> list[tuple[int, int]]:
    """From the end back: diagonal first, then up, then left."""
    i, j = d.shape[0] - 1, d.shape[1] - 1
    if not math.isfinite(d[i, j]):
        raise UnreachableError("no path in the window")
    out = []
    while i > 0 and j > 0:
        out.append((i - 1, j - 1))
        rest = d[i, j] - cost[i - 1, j - 1]
        if abs(d[i - 1, j - 1] - rest) <= EPS:
            i, j = i - 1, j - 1
        elif abs(d[i - 1, j] + penalty - rest) <= EPS:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def local_costs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows by norms and products; what rounding leaves below 0 is 0."""
    if x.ndim != 2 or y.ndim != 2 or x.shape[1] != y.shape[1]:
        raise ShapeError("dimensions differ")
    c = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T
    if (c < -1e-9 * max(1.0, float(np.abs(c).max(initial=0.0)))).any():
        raise NumericPolicyError("negative cost")
    return np.maximum(c, 0.0)


_OUT = "pair_id string, distance double, path array<struct<i: int, j: int>>, accumulated array<array<double>>, local_cost array<array<double>>"


def align(
    pairs: DataFrame,
    kind: str = "series",
    window: int | None = None,
    penalty: float = 0.0,
    path: bool = False,
    accumulated: bool = False,
    local_cost: bool = False,
    cost: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
    check_finite: bool = True,
) -> DataFrame:
    """Alignments of pairs, in Arrow batches.

    kind: series (a, b arrays), cost (an array of rows), features (x, y arrays
    of rows).  cost maps a column vector and a row vector of samples to costs;
    the default is the absolute difference.
    """
    _checked(window, penalty)

    def costs(r) -> np.ndarray:
        if kind == "series":
            a, b = np.asarray(r.a, float), np.asarray(r.b, float)
            if not len(a) or not len(b):
                raise ShapeError("an empty series")
            if check_finite and not (np.isfinite(a).all() and np.isfinite(b).all()):
                raise NumericPolicyError("NaN or infinity")
            return cost(a[:, None], b[None, :]) if cost else np.abs(a[:, None] - b[None, :])
        if kind == "cost":
            c = np.array([list(v) for v in r.cost], float)
            if c.ndim != 2 or not c.size:
                raise ShapeError("costs")
            if not np.isfinite(c).all() or (c < 0).any():
                raise NumericPolicyError("cost")
            return c
        return local_costs(np.array([list(v) for v in r.x], float), np.array([list(v) for v in r.y], float))

    def of(batches):
        for p in batches:
            out = []
            for r in p.itertuples(index=False):
                c = costs(r)
                d = table_of(c, window, penalty)
                steps = [{"i": i, "j": j} for i, j in path_of(d, c, penalty)] if path else None
                out.append((r.pair_id, float(d[-1, -1]), steps, [list(v) for v in d] if accumulated else None, [list(v) for v in c] if local_cost else None))
            yield pd.DataFrame(out, columns=["pair_id", "distance", "path", "accumulated", "local_cost"])

    return pairs.mapInPandas(of, _OUT)


MEMORY = ("none", "two_rows", "full")


def is_finite(distance: Column) -> Column:
    """Did an alignment find a way inside its window?"""
    return ~(distance.isNull() | F.isnan(distance) | (distance == INF))


@dataclass(frozen=True)
class Options:
    """What one pair's alignment takes; a path needs the full table in memory."""

    window: int | None = None
    penalty: float = 0.0
    path: bool = False
    memory: str = "two_rows"

    def validate(self) -> Options:
        _checked(self.window, self.penalty)
        if self.memory not in MEMORY:
            raise NumericPolicyError("memory mode")
        if self.path and self.memory != "full":
            raise NumericPolicyError("a path needs the full table")
        return self


def dtw(a: list[float], b: list[float], options: Options = Options()) -> tuple[float, list[tuple[int, int]] | None]:
    """(distance, path or None) of one pair on the driver, by absolute differences."""
    o = options.validate()
    x, y = np.asarray(a, float), np.asarray(b, float)
    if not len(x) or not len(y):
        raise ShapeError("an empty series")
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        raise NumericPolicyError("NaN or infinity")
    cost = np.abs(x[:, None] - y[None, :])
    d = table_of(cost, o.window, o.penalty)
    return float(d[-1, -1]), path_of(d, cost, o.penalty) if o.path else None
