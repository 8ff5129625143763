"""Property graphs: two frames and a record of capabilities."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import cut, numbered
from .errors import GraphInputError, NotFoundError

VERTEX = "id string, metadata map<string,string>"
EDGE = "edge_id string, src string, dst string, weight double, directed boolean"
_AUTO = r"^e[1-9][0-9]*$"
_MAX_AUTO = "18446744073709551615"


@dataclass(frozen=True)
class Caps:
    """What a graph may hold, fixed at construction and inherited by clones and views."""

    directed: bool = False
    weighted: bool = False
    multi: bool = False
    loops: bool = False
    mixed: bool = False


def _finite(c: str) -> Column:
    return ~(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")))


def is_auto_id(c: str) -> Column:
    """Does an edge ID look like one given automatically: e and a positive 64-bit number without leading zero?"""
    n = F.substring(c, 2, 100)
    fits = (F.length(n) < 20) | ((F.length(n) == 20) & (n <= _MAX_AUTO))
    return F.col(c).rlike(_AUTO) & fits


class PropertyGraph:
    """Vertices (id, metadata) and edges (edge_id, src, dst, weight, directed) under capabilities.

    Frames are immutable: every change returns a new graph.  Order is that of
    bytes of IDs, so e10 stands before e2.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame, caps: Caps = Caps(), next_id: int = 1):
        self.vertices, self.edges, self.caps, self.next_id = vertices, edges, caps, next_id
        self.spark: SparkSession = edges.sparkSession

    # -- construction -----------------------------------------------------
    @classmethod
    def empty(cls, spark: SparkSession, **caps) -> PropertyGraph:
        return cls(spark.createDataFrame([], VERTEX), spark.createDataFrame([], EDGE), Caps(**caps))

    @classmethod
    def mixed(cls, spark: SparkSession, **caps) -> PropertyGraph:
        return cls.empty(spark, **{**caps, "mixed": True})

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | None = None, check: bool = True, **caps) -> PropertyGraph:
        """A graph of an edge frame (src, dst and optionally weight, directed, edge_id) and further vertices (id)."""
        c = Caps(**caps)
        have = set(edges.columns)
        e = edges.select(
            (F.col("edge_id").cast("string") if "edge_id" in have else F.lit(None).cast("string")).alias("edge_id"),
            F.col("src").cast("string").alias("src"),
            F.col("dst").cast("string").alias("dst"),
            (F.col("weight").cast("double") if "weight" in have else F.lit(0.0)).alias("weight"),
            (F.coalesce("directed", F.lit(c.directed)) if "directed" in have else F.lit(c.directed)).alias("directed"),
        )
        next_id = 1
        if "edge_id" not in have:
            e = numbered(e.drop("edge_id"), "src", "dst", "weight", start=1)
            e = e.select(F.concat(F.lit("e"), F.col("ord").cast("string")).alias("edge_id"), "src", "dst", "weight", "directed")
            next_id = e.count() + 1
        ends = e.select(F.explode(F.array("src", "dst")).alias("id"))
        if vertices is not None:
            ends = ends.unionByName(vertices.select(F.col("id").cast("string").alias("id")))
        v = ends.distinct().withColumn("metadata", F.create_map().cast("map<string,string>"))
        g = cls(v, e, c, next_id)
        if check:
            g.validate()
        return g

    def validate(self) -> PropertyGraph:
        """Raise what an edge by edge construction would, from one aggregate and one count of pairs."""
        e, c = self.edges, self.caps
        r = e.agg(
            F.count_if((F.col("src") == "") | (F.col("dst") == "") | F.col("src").isNull() | F.col("dst").isNull()).alias("ids"),
            F.count_if(~_finite("weight") | F.col("weight").isNull()).alias("finite"),
            F.count_if(F.col("weight") != 0).alias("weights"),
            F.count_if(F.col("src") == F.col("dst")).alias("loops"),
            F.count_if(F.col("directed") != c.directed).alias("mixed"),
        ).first()
        for bad, allowed, what in (
            (r["ids"], False, "empty vertex ID"),
            (r["finite"], False, "weight that is not finite"),
            (r["weights"], c.weighted, "weight on an unweighted graph"),
            (r["loops"], c.loops, "loop"),
            (r["mixed"], c.mixed, "edge of other directedness"),
        ):
            if bad and not allowed:
                raise GraphInputError(what)
        if not c.multi:
            arcs = self.arcs().groupBy("src", "dst").agg(F.count_distinct("edge_id").alias("n"))
            if arcs.where("n > 1").limit(1).count():
                raise GraphInputError("parallel edges")
        if e.groupBy("edge_id").count().where("count > 1").limit(1).count():
            raise GraphInputError("duplicate edge ID")
        return self

    def add_vertices(self, rows: DataFrame) -> PropertyGraph:
        """Vertices (id, optionally metadata) that are not there yet."""
        new = rows.select(F.col("id").cast("string").alias("id"), (F.col("metadata") if "metadata" in rows.columns else F.create_map().cast("map<string,string>")).alias("metadata"))
        if new.where("id is null or id = ''").limit(1).count():
            raise GraphInputError("empty vertex ID")
        new = new.dropDuplicates(["id"]).join(self.vertices, "id", "left_anti")
        return self._with(vertices=self.vertices.unionByName(new))

    def add_vertex(self, vid: str) -> PropertyGraph:
        return self.add_vertices(self.spark.createDataFrame([(vid,)], "id string"))

    def add_edges(self, rows: DataFrame, check: bool = True) -> PropertyGraph:
        """A batch of edges (src, dst, optionally weight, directed, edge_id, seq); IDs are given in the order of seq."""
        have = set(rows.columns)
        d = F.lit(self.caps.directed)
        new = rows.select(
            F.col("src").cast("string").alias("src"),
            F.col("dst").cast("string").alias("dst"),
            (F.col("weight").cast("double") if "weight" in have else F.lit(0.0)).alias("weight"),
            (F.coalesce("directed", d) if "directed" in have else d).alias("directed"),
            (F.col("edge_id").cast("string") if "edge_id" in have else F.lit(None).cast("string")).alias("edge_id"),
            (F.col("seq") if "seq" in have else F.monotonically_increasing_id()).alias("seq"),
        )
        new = cut(new)
        named = new.where("edge_id is not null")
        # A graph made of named edges has not counted the IDs that look automatic.
        own = named if self.next_id > 1 else named.select("edge_id").unionByName(self.edges.select("edge_id"))
        top = own.where(is_auto_id("edge_id")).agg(F.max(F.substring("edge_id", 2, 100).cast("decimal(20,0)"))).first()[0]
        first = max(self.next_id, int(top or 0) + 1)
        auto = numbered(new.where("edge_id is null").drop("edge_id"), "seq", start=first)
        n = auto.count()
        auto = auto.select(F.concat(F.lit("e"), F.col("ord").cast("string")).alias("edge_id"), "src", "dst", "weight", "directed")
        e = self.edges.unionByName(named.select("edge_id", "src", "dst", "weight", "directed")).unionByName(auto)
        g = self.add_vertices(new.select(F.explode(F.array("src", "dst")).alias("id")))
        g = PropertyGraph(g.vertices, e, self.caps, first + n)
        return g.validate() if check else g

    def add_edge(self, src: str, dst: str, weight: float = 0.0, edge_id: str | None = None, directed: bool | None = None) -> PropertyGraph:
        if directed is not None and not self.caps.mixed:
            raise GraphInputError("directedness of its own needs mixed edges")
        if edge_id is not None:
            self.validate_edge_id(edge_id)
        return self.add_edges(self.spark.createDataFrame([(src, dst, float(weight), directed, edge_id)], "src string, dst string, weight double, directed boolean, edge_id string"))

    # -- removal and change -------------------------------------------------
    def _with(self, **kw) -> PropertyGraph:
        return PropertyGraph(kw.get("vertices", self.vertices), kw.get("edges", self.edges), kw.get("caps", self.caps), kw.get("next_id", self.next_id))

    def remove_vertex(self, vid: str) -> PropertyGraph:
        if not self.has_vertex(vid):
            raise NotFoundError(vid)
        return self._with(vertices=self.vertices.where(F.col("id") != vid), edges=self.edges.where((F.col("src") != vid) & (F.col("dst") != vid)))

    def remove_edge(self, edge_id: str) -> PropertyGraph:
        self.edge(edge_id)
        return self._with(edges=self.edges.where(F.col("edge_id") != edge_id))

    def remove_edges_where(self, pred: Column) -> tuple[PropertyGraph, int]:
        n = self.edges.where(pred).count()
        return self._with(edges=self.edges.where(~F.coalesce(pred, F.lit(False)))), n

    def set_edge_id(self, old: str, new: str) -> PropertyGraph:
        self.edge(old)
        if new != old:
            self.validate_edge_id(new)
        auto = self.spark.range(1).select(F.lit(new).alias("x")).where(is_auto_id("x")).count()
        renamed = F.when(F.col("edge_id") == old, F.lit(new)).otherwise(F.col("edge_id"))
        return self._with(edges=self.edges.withColumn("edge_id", renamed), next_id=max(self.next_id, int(new[1:]) + 1) if auto else self.next_id)

    def clear(self) -> PropertyGraph:
        return self._with(vertices=self.vertices.limit(0), edges=self.edges.limit(0), next_id=1)

    def clone_empty(self) -> PropertyGraph:
        return self._with(edges=self.edges.limit(0))

    def clone(self) -> PropertyGraph:
        return self._with()

    # -- views ---------------------------------------------------------------
    def unweighted_view(self) -> PropertyGraph:
        return self._with(edges=self.edges.withColumn("weight", F.lit(0.0)), caps=replace(self.caps, weighted=False))

    def induced(self, keep: DataFrame) -> PropertyGraph:
        """The listed vertices (id) and the edges with both ends among them."""
        k = keep.select(F.col("id").cast("string").alias("_k")).distinct()
        e = self.edges.join(k, F.col("src") == F.col("_k"), "left_semi").join(k, F.col("dst") == F.col("_k"), "left_semi")
        return self._with(vertices=self.vertices.join(k, F.col("id") == F.col("_k"), "left_semi"), edges=e)

    # -- lookups ---------------------------------------------------------------
    def arcs(self) -> DataFrame:
        """(src, dst, weight, edge_id): every way an edge can be walked."""
        fwd = self.edges.select("src", "dst", "weight", "edge_id")
        back = self.edges.where("not directed and src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "edge_id")
        return fwd.unionByName(back)

    def ordered_edges(self) -> DataFrame:
        return self.edges.orderBy("edge_id")

    def ordered_vertices(self) -> DataFrame:
        return self.vertices.select("id").orderBy("id")

    def vertices_map(self) -> DataFrame:
        return self.vertices.select("id", "metadata")

    def filter_edges(self, pred: Column) -> DataFrame:
        return self.edges.where(pred).orderBy("edge_id")

    def named_edges(self) -> DataFrame:
        return self.edges.where(~is_auto_id("edge_id"))

    def edge(self, edge_id: str):
        if not edge_id:
            raise GraphInputError("empty edge ID")
        got = self.edges.where(F.col("edge_id") == edge_id).limit(1).collect()
        if not got:
            raise NotFoundError(edge_id)
        return got[0]

    def has_edge(self, src: str, dst: str) -> bool:
        return self.arcs().where((F.col("src") == src) & (F.col("dst") == dst)).limit(1).count() > 0

    def has_vertex(self, vid: str) -> bool:
        return bool(vid) and self.vertices.where(F.col("id") == vid).limit(1).count() > 0

    def validate_edge_id(self, edge_id: str) -> None:
        if not edge_id:
            raise GraphInputError("empty edge ID")
        if self.edges.where(F.col("edge_id") == edge_id).limit(1).count():
            raise GraphInputError("edge ID is taken")

    def has_directed_edges(self) -> bool:
        return bool(self.edges.agg(F.bool_or("directed")).first()[0])

    def neighbors(self, vid: str | None = None) -> DataFrame:
        """(id, edge_id, src, dst, weight, directed): usable edges from a vertex, or from every one, by edge ID."""
        a = self.arcs().select(F.col("src").alias("id"), "edge_id")
        if vid is not None:
            if not self.has_vertex(vid):
                raise NotFoundError(vid)
            a = a.where(F.col("id") == vid)
        return a.join(self.edges, "edge_id").select("id", "edge_id", "src", "dst", "weight", "directed").orderBy("id", "edge_id")

    def neighbor_ids(self, vid: str | None = None) -> DataFrame:
        """(id, neighbor), distinct and in order."""
        a = self.arcs().select(F.col("src").alias("id"), F.col("dst").alias("neighbor"))
        if vid is not None:
            if not self.has_vertex(vid):
                raise NotFoundError(vid)
            a = a.where(F.col("id") == vid)
        return a.distinct().orderBy("id", "neighbor")

    def adjacency_list(self) -> DataFrame:
        """(id, edge_ids): edge IDs that can be walked from each vertex; none for isolated ones."""
        got = self.arcs().groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("edge_id")).alias("edge_ids"))
        return self.vertices.select("id").join(got, "id", "left").withColumn("edge_ids", F.coalesce("edge_ids", F.array().cast("array<string>")))

    # -- counts -----------------------------------------------------------------
    def vertex_count(self) -> int:
        return self.vertices.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def stats(self) -> DataFrame:
        v = self.vertices.agg(F.count(F.lit(1)).alias("vertices"))
        e = self.edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if("directed").alias("directed_edges"), F.count_if(~F.col("directed")).alias("undirected_edges"))
        one = v.join(e, how="cross")  # one row each
        return one.select("*", *[F.lit(x).alias(k) for k, x in asdict(self.caps).items()])

    def degrees(self, vid: str | None = None) -> DataFrame:
        """(id, in_degree, out_degree, undirected): an undirected loop counts twice, a directed one once each way."""
        if vid is not None and not self.has_vertex(vid):
            raise NotFoundError(vid)
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("id"), F.lit(False).alias("out")))).alias("x"), "directed")
        d = ends.select("x.id", "x.out", "directed").groupBy("id").agg(
            F.count_if(F.col("directed") & ~F.col("out")).alias("in_degree"),
            F.count_if(F.col("directed") & F.col("out")).alias("out_degree"),
            F.count_if(~F.col("directed")).alias("undirected"),
        )
        v = self.vertices.select("id")
        return (v if vid is None else v.where(F.col("id") == vid)).join(d, "id", "left").na.fill(0)
