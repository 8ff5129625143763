"""Traversals and shortest paths as rounds of joins and aggregations."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import components as contract
from ..plans.iterate import Scratch, cut, first_by, numbered
from .errors import GraphInputError, LimitError, NotFoundError, NumericPolicyError, TraversalStopped, UnreachableError
from .graph import PropertyGraph


Hook = Callable[[str, int], None]


@dataclass
class BFSResult:
    """visited (id, ord, depth, parent), the start, and how many neighbours the filter turned away."""

    visited: DataFrame
    start: str
    skipped: int

    def path_to(self, dst: str) -> list[str]:
        at = self.visited.where(F.col("id") == dst).limit(1).collect()
        if not at:
            raise UnreachableError(dst)
        path = walk(self.visited.select("id", "parent"), dst, at[0]["depth"])
        if path[0] != self.start:
            raise UnreachableError(dst)
        return path


def walk(parents: DataFrame, dst: str, most: int | None = None) -> list[str]:
    """From dst along (id, parent) to a root, returned root first.

    Pointer doubling: after k rounds every vertex knows its ancestor 2^k steps
    up, so the chain is cut out of the forest in a logarithmic number of jobs.
    """
    up = cut(parents.where("parent is not null").select("id", "parent"))
    have = up.sparkSession.createDataFrame([(dst, 0)], "id string, step long")
    have = cut(have)
    jump, length = up, 1
    while True:
        more = cut(have.join(jump, "id").select(F.col("parent").alias("id"), (F.col("step") + length).alias("step")))
        if not more.limit(1).count():
            break
        have = cut(have.unionByName(more).dropDuplicates(["id", "step"]))
        if most is not None and have.count() > most + 1:
            raise GraphInputError("parents form a cycle")
        a, b = jump.alias("a"), jump.alias("b")
        jump = cut(a.join(b, F.col("a.parent") == F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.parent").alias("parent")))
        length *= 2
    return [r["id"] for r in have.orderBy(F.desc("step")).collect()]


def bfs(
    g: PropertyGraph,
    start: str,
    max_depth: int = -1,
    keep: Column | None = None,
    full: bool = False,
    on_level: Callable[[int, DataFrame], None] | None = None,
    on_enqueue: Hook | None = None,
    on_dequeue: Hook | None = None,
    on_visit: Hook | None = None,
    cancelled: Callable[[], bool] | None = None,
) -> BFSResult:
    """Hop by hop from start; neighbours in the order of their IDs, as a queue would take them.

    keep: a predicate on ``curr`` and ``nbr``, tested before a neighbour counts
    as visited; pairs that fail are counted.  max_depth is inclusive, -1 means
    no limit.  full restarts from the least unvisited vertex until none is
    left.  on_level gets every level's frame and may raise to stop.

    on_enqueue, on_dequeue and on_visit get (id, depth) of every vertex in the
    order in which a queue would meet them: a level is streamed to the driver
    for them once its neighbours are known.  What they raise stops the
    traversal, as does cancelled, which is asked before every level.
    """
    if g.caps.weighted:
        raise GraphInputError("a weighted graph; use its unweighted view")
    if max_depth < -1:
        raise GraphInputError("depth limit")
    if not g.has_vertex(start):
        raise NotFoundError(start)
    spark = g.spark
    arcs = g.arcs().select(F.col("src").alias("curr"), F.col("dst").alias("nbr")).distinct()
    arcs = cut(arcs.repartition("curr"))
    schema = "id string, ord long, depth int, parent string"
    visited = spark.createDataFrame([], schema)
    skipped = total = 0
    root: str | None = start

    def stopped(e: Exception, levels: list[DataFrame]) -> TraversalStopped:
        return TraversalStopped(str(e), BFSResult(_union([visited, *levels]), start, skipped))

    def told(level: DataFrame, new: DataFrame | None, depth: int) -> None:
        if not (on_enqueue or on_dequeue or on_visit):
            return
        found: dict[str, list[str]] = {}
        for r in new.orderBy("ord").toLocalIterator() if new is not None and on_enqueue else ():
            found.setdefault(r["parent"], []).append(r["id"])
        for r in level.orderBy("ord").toLocalIterator():
            if on_enqueue and r["depth"] == 0:
                on_enqueue(r["id"], 0)
            if on_dequeue:
                on_dequeue(r["id"], depth)
            if on_visit:
                on_visit(r["id"], depth)
            for x in found.get(r["id"], ()):
                on_enqueue(x, depth + 1)

    while root is not None:
        frontier = spark.createDataFrame([(root, total, 0, None)], schema)
        levels = [frontier]
        total += 1
        depth = 0
        seen = visited.select("id").unionByName(frontier.select("id"))
        while True:
            if cancelled and cancelled():
                raise stopped(LimitError("cancelled"), levels)
            if on_level:
                try:
                    on_level(depth, frontier)
                except Exception as e:
                    raise stopped(e, levels) from e
            if 0 <= max_depth <= depth:
                try:
                    told(frontier, None, depth)
                except Exception as e:
                    raise stopped(e, levels) from e
                break
            step = frontier.select(F.col("id").alias("curr"), F.col("ord").alias("rank")).join(arcs, "curr")
            if keep is not None:
                step = step.withColumn("ok", F.coalesce(keep, F.lit(False)))
                step = cut(step)
                skipped += step.where("not ok").count()
                step = step.where("ok")
            new = step.join(seen, F.col("nbr") == F.col("id"), "left_anti")
            new = new.groupBy("nbr").agg(F.min(F.struct("rank", "curr")).alias("p")).select(F.col("nbr").alias("id"), F.col("p.rank").alias("rank"), F.col("p.curr").alias("parent"))
            depth += 1
            level = numbered(new, "rank", "id", start=total)
            level = cut(level.select("id", "ord", F.lit(depth).alias("depth"), "parent"))
            n = level.count()
            try:
                told(frontier, level, depth - 1)
            except Exception as e:
                raise stopped(e, levels) from e
            if not n:
                break
            total += n
            levels.append(level)
            frontier = level
            seen = cut(seen.unionByName(level.select("id")))
        visited = cut(_union([visited, *levels]))
        root = None
        if full:
            left = cut(g.vertices.select("id").join(visited.select("id"), "id", "left_anti"))
            # Vertices without a way out that come before the next with one are roots of their own: all at once.
            busy = left.join(arcs.select(F.col("curr").alias("id")).distinct(), "id", "left_semi").agg(F.min("id")).first()[0]
            alone = left if busy is None else left.where(F.col("id") < busy)
            if not (on_level or on_enqueue or on_dequeue or on_visit):
                more = numbered(alone, "id", start=total)
                visited = cut(visited.unionByName(more.select("id", "ord", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"))))
                total = visited.count()
                root = busy
            else:
                root = left.agg(F.min("id")).first()[0]
    return BFSResult(visited, start, skipped)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def hop_depths(arcs: DataFrame, start: DataFrame, max_depth: int = -1) -> DataFrame:
    """(id, depth) from all of start (id) over arcs (src, dst): the order-free form of a traversal."""
    own = Scratch()
    seen = own.cut(start.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    arcs = own.cut(arcs.select("src", "dst").distinct())
    while max_depth < 0 or depth < max_depth:
        depth += 1
        new = frontier.join(arcs, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        new = own.cut(new.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if not new.limit(1).count():
            break
        seen = own.cut(seen.unionByName(new))
        frontier = new
        own.keep(seen, new, arcs)
    own.keep(seen)
    return seen


def components(g: PropertyGraph) -> DataFrame:
    """(id, component): weak components, direction ignored, each named by its least vertex."""
    return contract(g.vertices.select("id"), g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))


def component_members(g: PropertyGraph) -> DataFrame:
    """(component, members) with members in order."""
    return components(g).groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("members"))


@dataclass
class SSSPResult:
    """distances (id, dist) of every vertex, +inf where none is known, and parents (id, prev) if tracked."""

    distances: DataFrame
    source: str
    parents: DataFrame | None = None

    def distance_to(self, target: str) -> float:
        got = self.distances.where(F.col("id") == target).limit(1).collect()
        if not got:
            raise NotFoundError(target)
        return got[0]["dist"]

    def has_path_to(self, target: str) -> bool:
        return math.isfinite(self.distance_to(target))

    def path_to(self, target: str) -> list[str]:
        if self.parents is None:
            raise GraphInputError("paths were not tracked")
        if not self.has_path_to(target):
            raise UnreachableError(target)
        return walk(self.parents.select("id", F.col("prev").alias("parent")), target)


def shortest_paths(
    g: PropertyGraph,
    source: str,
    track: bool = False,
    max_distance: float = math.inf,
    wall: float = math.inf,
    max_rounds: int | None = None,
    cancelled: Callable[[], bool] | None = None,
) -> SSSPResult:
    """Distances from source over non-negative weights, by rounds of strict improvement.

    Candidates beyond max_distance are dropped, edges with a weight of at
    least ``wall`` are not walked.  Every edge's weight is checked first, even
    where it cannot be reached.  A parent is the first, by (distance, id), of
    those whose arc explains the distance exactly.
    """
    if math.isnan(max_distance) or max_distance < 0:
        raise NumericPolicyError("maximal distance")
    if math.isnan(wall) or wall <= 0:
        raise NumericPolicyError("wall")
    if not g.caps.weighted:
        raise GraphInputError("an unweighted graph")
    if not g.has_vertex(source):
        raise NotFoundError(source)
    if g.edges.where("weight < 0 or isnan(weight)").limit(1).count():
        raise NumericPolicyError("negative weight")
    arcs = g.arcs().groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    if math.isfinite(wall):
        arcs = arcs.where(F.col("weight") < wall)
    own = Scratch()
    arcs = own.cut(arcs.repartition("src"))
    best = own.cut(g.spark.createDataFrame([(source, 0.0)], "id string, dist double"))
    frontier, rounds = best, 0
    while True:
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise LimitError(f"{max_rounds} rounds")
        if cancelled and cancelled():
            raise LimitError("cancelled")
        cand = frontier.join(arcs, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("dist") + F.col("weight")).alias("cand"))
        if math.isfinite(max_distance):
            cand = cand.where(F.col("cand") <= max_distance)
        cand = cand.groupBy("id").agg(F.min("cand").alias("cand"))
        better = own.cut(cand.join(best, "id", "left").where("dist is null or cand < dist").select("id", F.col("cand").alias("dist")))
        if not better.limit(1).count():
            break
        best = own.cut(best.join(better, "id", "left_anti").unionByName(better))
        frontier = better
        own.keep(arcs, best, better)
    if best.where("dist = double('infinity')").limit(1).count():
        raise NumericPolicyError("distance overflow")
    dist = own.cut(g.vertices.select("id").join(best, "id", "left").select("id", F.coalesce("dist", F.lit(float("inf"))).alias("dist")))
    parents = None
    if track:
        tight = best.alias("b").join(arcs, F.col("b.id") == arcs["src"]).select(F.col("b.id").alias("u"), F.col("b.dist").alias("du"), "dst", "weight")
        tight = tight.join(best.select(F.col("id").alias("v"), F.col("dist").alias("dv")), F.col("dst") == F.col("v"))
        tight = tight.where((F.col("du") + F.col("weight") == F.col("dv")) & (F.col("v") != source) & (F.col("u") != F.col("v")))
        first = first_by(tight, ["v"], ["du", "u"]).select(F.col("v").alias("id"), F.col("u").alias("prev"))
        parents = own.cut(g.vertices.select("id").join(first, "id", "left"))
    own.keep(dist, parents)
    return SSSPResult(dist, source, parents)


def shortest_path(g: PropertyGraph, source: str, target: str, **kw) -> tuple[list[str], float]:
    r = shortest_paths(g, source, track=True, **kw)
    d = r.distance_to(target)
    return r.path_to(target), d
