"""Lattices of integer cells (x, y, value): islands and the cheapest bridges between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import components as contract
from ..plans.iterate import cut, first_by
from .errors import GraphInputError, ShapeError, UnreachableError
from .graph import Caps, PropertyGraph

#: Neighbours clockwise from north.
FOUR = ((0, -1), (1, 0), (0, 1), (-1, 0))
EIGHT = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))


@dataclass
class Grid:
    cells: DataFrame
    width: int
    height: int
    threshold: int = 1
    connect: int = 4

    @classmethod
    def of(cls, spark: SparkSession, values: list[list[int]], threshold: int = 1, connect: int = 4) -> Grid:
        if not values or not values[0]:
            raise ShapeError("an empty grid")
        if len({len(r) for r in values}) > 1:
            raise ShapeError("ragged rows")
        if connect not in (4, 8):
            raise GraphInputError("connectivity")
        rows = spark.createDataFrame(list(enumerate(values)), "y int, r array<int>")
        return cls(rows.select(F.posexplode("r").alias("x", "value"), "y").select("x", "y", "value"), len(values[0]), len(values), threshold, connect)

    def in_bounds(self, x: int, y: int) -> bool:
        return 0 <= x < self.width and 0 <= y < self.height

    def coordinate(self, index: int) -> tuple[int, int]:
        return index % self.width, index // self.width

    def neighbor_offsets(self) -> tuple:
        return FOUR if self.connect == 4 else EIGHT

    def _steps(self) -> DataFrame:
        """(k, x, y, value, nk, nx, ny, nvalue): cells with their neighbours; an equi-join on the neighbour's place."""
        c = self.cells.withColumn("k", F.col("y").cast("long") * self.width + F.col("x"))
        around = F.array(*[F.struct((F.col("x") + dx).alias("nx"), (F.col("y") + dy).alias("ny")) for dx, dy in self.neighbor_offsets()])
        e = c.select("k", "x", "y", "value", F.explode(around).alias("o")).select("k", "x", "y", "value", "o.nx", "o.ny")
        to = c.select(F.col("k").alias("nk"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("value").alias("nvalue"))
        return e.join(to, ["nx", "ny"])

    def to_graph(self) -> PropertyGraph:
        """Every cell a vertex "x,y" with its numbers as metadata; neighbours by undirected edges of weight 1."""
        name = lambda x, y: F.concat_ws(",", x, y)
        meta = F.create_map(F.lit("x"), F.col("x").cast("string"), F.lit("y"), F.col("y").cast("string"), F.lit("value"), F.col("value").cast("string"))
        v = self.cells.select(name("x", "y").alias("id"), meta.alias("metadata"))
        e = self._steps().where("k < nk").select(name("x", "y").alias("src"), name("nx", "ny").alias("dst"), F.lit(1.0).alias("weight"))
        g = PropertyGraph.from_edges(e, check=False, weighted=True)
        return PropertyGraph(v, g.edges, Caps(weighted=True), g.next_id)

    def connected_components(self) -> DataFrame:
        """(value, component, cells): regions of one value at or above the threshold; named by their first cell in row order."""
        land = self.cells.where(F.col("value") >= self.threshold).withColumn("k", F.col("y").cast("long") * self.width + F.col("x"))
        links = self._steps().where((F.col("value") == F.col("nvalue")) & (F.col("value") >= self.threshold) & (F.col("k") < F.col("nk")))
        c = contract(land.select(F.col("k").alias("id")), links.select(F.col("k").alias("u"), F.col("nk").alias("v")))
        j = land.join(c, F.col("k") == F.col("id"))
        return j.groupBy("value", "component").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("cells"))

    def expand_island(self, src: DataFrame, dst: DataFrame) -> tuple[list[tuple[int, int]], int]:
        """The cells of a cheapest way from src to dst (x, y) and its cost: entering a cell below the threshold costs 1.

        Rounds of strict improvement from all of src at once; the way back
        takes the first predecessor in row order that explains each cost.
        """
        key = (F.col("y").cast("long") * self.width + F.col("x")).alias("k")
        a, b = cut(src.select(key).distinct()), cut(dst.select(key).distinct())
        if not a.limit(1).count() or not b.limit(1).count():
            raise GraphInputError("an empty island")
        arcs = cut(self._steps().select(F.col("k").alias("s"), F.col("nk").alias("t"), F.when(F.col("nvalue") < self.threshold, 1).otherwise(0).alias("w")))
        best = frontier = cut(a.select("k", F.lit(0).alias("cost"), F.lit(0).alias("hops")))
        while True:
            cand = frontier.join(arcs, F.col("k") == F.col("s")).select(F.col("t").alias("k"), F.struct((F.col("cost") + F.col("w")).alias("cost"), (F.col("hops") + 1).alias("hops")).alias("c"))
            cand = cand.groupBy("k").agg(F.min("c").alias("c")).select("k", F.col("c.cost").alias("nc"), F.col("c.hops").alias("nh"))
            better = cut(cand.join(best, "k", "left").where("cost is null or nc < cost or (nc = cost and nh < hops)").select("k", F.col("nc").alias("cost"), F.col("nh").alias("hops")))
            if not better.limit(1).count():
                break
            best = cut(best.join(better, "k", "left_anti").unionByName(better))
            frontier = better
        ends = best.join(b, "k").orderBy("cost", "hops", "k").limit(1).collect()
        if not ends:
            raise UnreachableError("no way")
        tight = best.alias("p").join(arcs, F.col("p.k") == F.col("s")).join(best.select(F.col("k").alias("q"), F.col("cost").alias("qc"), F.col("hops").alias("qh")), F.col("t") == F.col("q"))
        tight = tight.where((F.col("p.cost") + F.col("w") == F.col("qc")) & (F.col("p.hops") + 1 == F.col("qh")))
        back = cut(first_by(tight.select(F.col("q").alias("id"), F.col("p.k").alias("parent")), ["id"], ["parent"]).select(F.col("id").cast("string").alias("id"), F.col("parent").cast("string").alias("parent")))
        from .traverse import walk

        path = [self.coordinate(int(v)) for v in walk(back, str(ends[0]["k"]))]
        return path, ends[0]["cost"]
