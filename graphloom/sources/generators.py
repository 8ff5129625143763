"""Graphs and signals from rules and seeds, built as ranges and joins.

A shape is a function of (spark, options) to (vertices, edges); ``build`` runs
several on one graph.  Random ones depend on their seed only, not on how
ranges are partitioned.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import naming
from ..operators.errors import GraphInputError
from ..operators.graph import PropertyGraph
from ..plans.iterate import running_sum


@dataclass(frozen=True)
class Options:
    ids: naming.IDScheme = naming.decimal_ids
    weight: naming.WeightFn = field(default_factory=naming.constant_weight)
    seed: int = 1
    left: str = "L"
    right: str = "R"
    directed: bool = False
    weighted: bool = False
    rand: random.Random | None = None  # where given, the seed is drawn from it

    def __post_init__(self):
        if self.rand is not None:
            object.__setattr__(self, "seed", self.rand.randrange(1, 2**31))


Shape = Callable[[SparkSession, Options], tuple[DataFrame, DataFrame]]


def uniform(*parts) -> Column:
    """A number in [0, 1) that depends on its parts only: 52 bits of the digest of their text, which any engine can make."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _framed(o: Options, vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbers to IDs; edges (a, b) get weights."""
    w = o.weight(o.seed) if o.weighted else F.lit(0.0)
    e = edges.select(o.ids(F.col("a")).alias("src"), o.ids(F.col("b")).alias("dst")).withColumn("weight", w)
    return vertices.select(o.ids(F.col("id")).alias("id")), e


def _need(n: int, least: int) -> None:
    if n < least:
        raise GraphInputError(f"fewer than {least} vertices")


def build(spark: SparkSession, *shapes: Shape | None, caps: dict | None = None, **options) -> PropertyGraph:
    """One graph of all shapes; vertices that shapes share are one."""
    if any(s is None for s in shapes):
        raise GraphInputError("no shape")
    c = {"directed": False, "weighted": False, "multi": True, "loops": True, **(caps or {})}
    o = Options(directed=c["directed"], weighted=c["weighted"], **options)
    v = e = None
    for s in shapes:
        sv, se = s(spark, o)
        v = sv if v is None else v.unionByName(sv)
        e = se if e is None else e.unionByName(se)
    if v is None:
        return PropertyGraph.empty(spark, **c)
    return PropertyGraph.from_edges(e, v, check=False, **c)


def extend(g: PropertyGraph, *shapes: Shape | None, **options) -> PropertyGraph:
    """A graph with shapes added: vertices that are there already are shared, edge IDs go on from the graph's."""
    if any(s is None for s in shapes):
        raise GraphInputError("no shape")
    o = Options(directed=g.caps.directed, weighted=g.caps.weighted, **options)
    for s in shapes:
        v, e = s(g.spark, o)
        g = g.add_vertices(v).add_edges(e, check=False)
    return g


def path(n: int) -> Shape:
    _need(n, 2)
    return lambda spark, o: _framed(o, spark.range(n), spark.range(1, n).select((F.col("id") - 1).alias("a"), F.col("id").alias("b")))


def cycle(n: int) -> Shape:
    _need(n, 3)
    return lambda spark, o: _framed(o, spark.range(n), spark.range(n).select(F.col("id").alias("a"), F.pmod(F.col("id") + 1, F.lit(n)).alias("b")))


def complete(n: int) -> Shape:
    """Pairs i < j; a directed graph gets the way back with the same weight."""
    _need(n, 1)

    def make(spark, o):
        pairs = spark.range(n).select(F.col("id").alias("a")).withColumn("b", F.explode(F.expr(f"if(a + 1 < {n}, sequence(a + 1, bigint({n - 1})), cast(array() as array<bigint>))")))
        v, e = _framed(o, spark.range(n), pairs)
        if o.directed:
            e = e.withColumn("_w", F.array(F.struct("src", "dst", "weight"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))).select(F.explode("_w").alias("x")).select("x.*")
        return v, e

    return make


def complete_bipartite(n1: int, n2: int) -> Shape:
    _need(min(n1, n2), 1)

    def make(spark, o):
        left, right = naming.prefixed_ids(o.left or "L"), naming.prefixed_ids(o.right or "R")
        pairs = spark.range(n1).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(n2 - 1))).alias("b"))
        w = o.weight(o.seed) if o.weighted else F.lit(0.0)
        e = pairs.select(left(F.col("a")).alias("src"), right(F.col("b")).alias("dst")).withColumn("weight", w)
        v = spark.range(n1).select(left(F.col("id")).alias("id")).unionByName(spark.range(n2).select(right(F.col("id")).alias("id")))
        if o.directed:
            e = e.select(F.explode(F.array(F.struct("src", "dst", "weight"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))).alias("x")).select("x.*")
        return v, e

    return make


def _spokes(spark: SparkSession, o: Options, rim: DataFrame) -> tuple[DataFrame, DataFrame]:
    w = o.weight(o.seed + 1) if o.weighted else F.lit(0.0)
    e = rim.select(F.lit("Center").alias("src"), o.ids(F.col("id")).alias("dst")).withColumn("weight", w)
    return spark.createDataFrame([("Center",)], "id string"), e


def star(n: int) -> Shape:
    _need(n, 2)

    def make(spark, o):
        v, e = _spokes(spark, o, spark.range(1, n))
        return v.unionByName(spark.range(1, n).select(o.ids(F.col("id")).alias("id"))), e

    return make


def wheel(n: int) -> Shape:
    _need(n, 3)

    def make(spark, o):
        v, e = cycle(n)(spark, o)
        cv, ce = _spokes(spark, o, spark.range(n))
        return v.unionByName(cv), e.unionByName(ce)

    return make


def grid(rows: int, cols: int) -> Shape:
    """IDs "row,column"; edges to the right and down."""
    _need(min(rows, cols), 1)

    def make(spark, o):
        name = lambda r, c: F.concat_ws(",", r.cast("string"), c.cast("string"))
        cell = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("r"), F.pmod("id", F.lit(cols)).alias("c"))
        to = F.array(F.struct(F.col("r").alias("r"), (F.col("c") + 1).alias("c")), F.struct((F.col("r") + 1).alias("r"), F.col("c").alias("c")))
        e = cell.select("r", "c", F.explode(to).alias("t")).where((F.col("t.r") < rows) & (F.col("t.c") < cols))
        w = o.weight(o.seed) if o.weighted else F.lit(0.0)
        e = e.select(name(F.col("r"), F.col("c")).alias("src"), name(F.col("t.r"), F.col("t.c")).alias("dst")).withColumn("weight", w)
        return cell.select(name(F.col("r"), F.col("c")).alias("id")), e

    return make


def random_sparse(n: int, p: float) -> Shape:
    """Every pair with probability p; ordered pairs and loops where directed.

    Instead of tossing a coin for each pair, each vertex draws the gaps between
    its neighbours from the geometric distribution, so the work follows the
    edges and not the square of the vertices.
    """
    _need(n, 1)
    if not 0 <= p <= 1:
        raise GraphInputError("probability")

    def make(spark, o):
        v = spark.range(n)
        seed = o.seed

        def draw(batches):
            import pandas as pd

            for b in batches:
                a, c = [], []
                for i in b["id"].tolist():
                    rng = random.Random(seed * 1_000_003 + i)
                    j = -1 if o.directed else i
                    while True:
                        if p >= 1:
                            j += 1
                        elif p <= 0:
                            break
                        else:
                            j += 1 + int(math.log(1 - rng.random()) / math.log(1 - p))
                        if j >= n:
                            break
                        a.append(i)
                        c.append(j)
                yield pd.DataFrame({"a": a, "b": c}, dtype="int64")

        return _framed(o, v, v.mapInPandas(draw, "a long, b long"))

    return make


def random_regular(n: int, d: int, attempts: int = 100) -> Shape:
    """d-regular without loops or parallel edges, by matching stubs and mending clashes; undirected only."""
    _need(n, 1)
    if d < 0 or d >= n or n * d % 2:
        raise GraphInputError("degree")

    def make(spark, o):
        if o.directed:
            raise GraphInputError("a directed graph")
        rng = random.Random(o.seed)
        for _ in range(attempts):
            stubs = [v for v in range(n) for _ in range(d)]
            rng.shuffle(stubs)
            pairs = [(min(a, b), max(a, b)) for a, b in zip(stubs[::2], stubs[1::2], strict=True)]
            for _ in range(50):
                seen: set = set()
                bad = [i for i, e in enumerate(pairs) if e[0] == e[1] or e in seen or seen.add(e)]
                if not bad:
                    e = spark.createDataFrame(pairs, "a long, b long") if pairs else spark.createDataFrame([], "a long, b long")
                    return _framed(o, spark.range(n), e)
                for i in bad:
                    j = rng.randrange(len(pairs))
                    (a, b), (c, f) = pairs[i], pairs[j]
                    pairs[i], pairs[j] = (min(a, f), max(a, f)), (min(b, c), max(b, c))
        raise GraphInputError("no regular graph was found")

    return make


def _solid(name: str) -> tuple[int, list[tuple[int, int]]]:
    """Vertices and edges of a Platonic solid: its corners' coordinates, nearest pairs joined."""
    g = (1 + 5**0.5) / 2
    signs = list(itertools.product((-1, 1), repeat=3))
    if name == "tetrahedron":
        pts = [s for s in signs if s[0] * s[1] * s[2] > 0]
    elif name == "cube":
        pts = signs
    elif name == "octahedron":
        pts = [tuple(s if k == i else 0 for k in range(3)) for i in range(3) for s in (-1, 1)]
    elif name in ("icosahedron", "dodecahedron"):
        a, b = (1, g) if name == "icosahedron" else (1 / g, g)
        pts = [tuple((0, x * a, y * b)[(k - i) % 3] for k in range(3)) for i in range(3) for x in (-1, 1) for y in (-1, 1)]
        pts += signs if name == "dodecahedron" else []
    else:
        raise GraphInputError(name)
    far = {(i, j): math.dist(pts[i], pts[j]) for i, j in itertools.combinations(range(len(pts)), 2)}
    least = min(far.values())
    return len(pts), [e for e, d in far.items() if d < least * 1.01]


PLATONIC = ("tetrahedron", "cube", "octahedron", "dodecahedron", "icosahedron")


def platonic_solid(name: str, with_center: bool = False) -> Shape:
    n, pairs = _solid(name)

    def make(spark, o):
        v, e = _framed(o, spark.range(n), spark.createDataFrame(pairs, "a long, b long"))
        if with_center:
            cv, ce = _spokes(spark, o, spark.range(n))
            v, e = v.unionByName(cv), e.unionByName(ce)
        return v, e

    return make


#: Ring size, hub, chords; a chord that the ring has already counts once.
_OUTER = "0-1 1-3 3-4 4-5 5-7 7-8 8-9 9-11 11-0 2-3 3-5 5-6 6-7 7-9 9-10 10-11 11-1 1-2"
HEXAGRAMS = {
    "default": (6, False, "0-2 2-4 4-0 1-3 3-5 5-1"),
    "medium": (8, False, "0-2 2-3 3-4 4-5 5-6 6-0 1-2 2-4 4-6 6-7 7-0 0-1"),
    "big": (12, True, _OUTER),
    "huge": (12, True, _OUTER + " 1-5 5-9 9-1 3-7 7-11 11-3"),
}


def hexagram(variant: str) -> Shape:
    """A ring with chords, and a hub for the larger ones; a directed graph gets the chords both ways."""
    if variant not in HEXAGRAMS:
        raise GraphInputError(variant)
    n, hub, chords = HEXAGRAMS[variant]
    pairs = [tuple(map(int, c.split("-"))) for c in chords.split()]

    def make(spark, o):
        v, e = (wheel if hub else cycle)(n)(spark, o)
        ring = {(i, (i + 1) % n) for i in range(n)}
        new: list[tuple[int, int]] = []
        for a, b in pairs:
            for x, y in ((a, b), (b, a)) if o.directed else ((a, b),):
                have = ring | set(new)
                if (x, y) not in have and (o.directed or (y, x) not in have):
                    new.append((x, y))
        _, ce = _framed(o, spark.range(n), spark.createDataFrame(new, "a long, b long"))
        return v, e.unionByName(ce)

    return make


#: Strokes of each character on a lattice of 3 columns and 5 rows, numbered from the top left; drawn for this project.
GLYPHS = {
    "A": "12-6-1-8-14 6-8", "0": "0-2-14-12-0", "1": "3-1-13", "2": "0-2-8-6-12-14", "3": "0-2-14-12 6-8", "4": "0-6-8 2-14", "5": "2-0-6-8-14-12", "6": "2-0-12-14-8-6", "7": "0-2-13", "8": "0-2-14-12-0 6-8", "9": "8-6-0-2-14-12",
    "B": "0-1-5-7-6 7-11-13-12-0", "C": "2-0-12-14", "D": "0-1-5-11-13-12-0", "E": "2-0-12-14 6-7", "F": "2-0-12 6-7", "G": "2-0-12-14-8-7", "H": "0-12 2-14 6-8", "I": "0-2 1-13 12-14", "J": "2-14-12-9", "K": "0-12 2-6-14", "L": "0-12-14",
    "M": "12-0-4-2-14", "N": "12-0-14-2", "O": "0-2-14-12-0", "P": "12-0-2-8-6", "Q": "0-2-14-12-0 10-14", "R": "12-0-2-8-6 7-14", "S": "2-0-6-8-14-12", "T": "0-2 1-13", "U": "0-12-14-2", "V": "0-13-2", "W": "0-12-10-14-2", "X": "0-14 2-12", "Y": "0-7-2 7-13", "Z": "0-2-12-14",
}


def _dots(a: int, b: int) -> list[int]:
    """The lattice's nodes on a straight line from a to b."""
    (r, c), (s, d) = divmod(a, 3), divmod(b, 3)
    n = math.gcd(s - r, d - c)
    return [(r + (s - r) * i // n) * 3 + c + (d - c) * i // n for i in range(n + 1)] if n else [a]


def glyph_steps(c: str) -> list[tuple[int, int]]:
    """The lattice steps of a character's strokes."""
    out = []
    for stroke in GLYPHS[c.upper()].split():
        ends = [int(k) for k in stroke.split("-")]
        ks = [ends[0]] + [k for a, b in itertools.pairwise(ends) for k in _dots(a, b)[1:]]
        out += itertools.pairwise(ks)
    return out


def letters(text: str, scope: str = "") -> Shape:
    """The text's characters as skeletons; vertex IDs are scope::position::node.  Blanks only take a position."""
    for c in text:
        if c != " " and c.upper() not in GLYPHS:
            raise GraphInputError(f"no glyph for {c}")

    def make(spark, o):
        name = lambda p, k: "::".join([*([scope] if scope else []), str(p), str(k)])
        pairs, nodes = [], set()
        for p, c in enumerate(text):
            for a, b in glyph_steps(c) if c != " " else ():
                nodes |= {name(p, a), name(p, b)}
                pairs.append((name(p, a), name(p, b)))
        w = o.weight(o.seed) if o.weighted else F.lit(0.0)
        e = spark.createDataFrame(sorted(set(pairs)), "src string, dst string").withColumn("weight", w)
        return spark.createDataFrame([(v,) for v in sorted(nodes)], "id string"), e

    return make


word = letters


def digit(d: int, scope: str = "") -> Shape:
    if not 0 <= d <= 9:
        raise GraphInputError("digit")
    return letters(str(d), scope)


def number(x: float, decimal: bool = False, scope: str = "") -> Shape:
    """The digits of a number, other marks left out."""
    text = repr(float(x)) if decimal else str(int(x))
    return letters("".join(c for c in text if c.isdigit()), scope)


# -- signals ------------------------------------------------------------------
def pulse(spark: SparkSession, n: int, frequency: float = 0.125, duty: float = 0.5, amplitude: float = 1.0, trend: float = 0.0, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """(i, value): a rectangular wave."""
    if n < 0 or frequency < 0 or noise < 0:
        raise ValueError("signal options")
    i = F.col("id").cast("double")
    v = F.when(F.pmod(i * frequency, F.lit(1.0)) < duty, amplitude).otherwise(0.0) + i * trend + (F.randn(seed) * noise if noise else F.lit(0.0))
    return spark.range(n).select(F.col("id").alias("i"), v.alias("value"))


def audio_chirp(spark: SparkSession, n: int, f0: float = 0.02, f1: float = 0.25, amplitude: float = 1.0, trend: float = 0.0, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """(i, value): a sine whose frequency rises evenly; the phase is the sum of all frequencies so far, in closed form."""
    if n < 0 or noise < 0:
        raise ValueError("signal options")
    i, m = F.col("id").cast("double"), max(n - 1, 1)
    phase = 2 * math.pi * (f0 * (i + 1) + (f1 - f0) / m * i * (i + 1) / 2)
    v = F.sin(phase) * amplitude + i * trend + (F.randn(seed) * noise if noise else F.lit(0.0))
    return spark.range(n).select(F.col("id").alias("i"), v.alias("value"))


def ohlc_series(spark: SparkSession, days: int, seed: int = 1, start: float = 100.0, mu: float = 0.0005, vol: float = 0.02, steps: int = 8) -> DataFrame:
    """(day, open, high, low, close): geometric Brownian motion, ``steps`` prices a day.

    Normal numbers come from digests (Box-Muller), so values do not depend on
    partitions; running sums go day by day and then within days.
    """
    if days < 0:
        raise ValueError("days")
    t = spark.range(days * steps).select(F.floor(F.col("id") / steps).alias("day"), F.pmod("id", F.lit(steps)).alias("step"), "id")
    z = F.sqrt(-2 * F.log(1 - uniform(seed, F.col("id"), 1))) * F.cos(2 * math.pi * uniform(seed, F.col("id"), 2))
    dt = 1.0 / steps
    t = t.withColumn("r", (mu - vol * vol / 2) * dt + vol * math.sqrt(dt) * z)
    inner = Window.partitionBy("day").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("within", F.sum("r").over(inner))
    per = t.groupBy("day").agg(F.sum("r").alias("total"), F.max("within").alias("hi"), F.min("within").alias("lo"))
    d = running_sum(per, "day", "total", "base")
    price = lambda x: F.lit(start) * F.exp(x)
    return d.select("day", price(F.col("base")).alias("open"), price(F.col("base") + F.greatest("hi", F.lit(0.0))).alias("high"), price(F.col("base") + F.least("lo", F.lit(0.0))).alias("low"), price(F.col("base") + F.col("total")).alias("close"))
