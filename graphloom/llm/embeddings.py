"""Embedding near-dedup on a robust-pruned flat graph.

Identical vectors of a label are one point with a weight.  Points of a label
are dealt to overlapping cluster shards: centroids are picked from a bounded
sample of the label (SAMPLE points, by hash), at most CENTRES in all, so that
what tasks carry is bounded, and every point is indexed in the shards of its
OVERLAP nearest centroids; a label of at most SHARD points is one shard.  A
shard that grows beyond twice SHARD points is split by hash, and its parts are
then compared with one another.  Each shard's graph takes every member's
nearest members as candidates and keeps those that robust pruning leaves; the
adjacency lists of all shards are united per point and go back to the shards
that hold both ends, so edges found in one shard serve the others.

Search: every point is a query in the shards of its PROBES nearest centroids.
It walks greedily along the graph with a beam, from the shard's medoid and
from those of its own neighbours (and itself) that the shard holds; once
the beam has settled, it expands every node within the radius until no new
one comes up.  Each pair found is verified by its cosine in double precision.
A pair is counted in the first shard that query and point have in common, so
counts need no pairs to be gathered: a shard returns a count per query and a
spanning forest of its links.

Recall is audited for each label on about AUDIT of its points, picked by hash,
against all points of the label in chunks; nothing of it is gathered on the
driver but the least recall.  If that is below GOAL, beam and probes are
doubled and the search runs again; once every shard is probed and that is
still not enough, members are compared without the graph, which is exact.

Defined results: a vector that is null, zero, or holds nulls or non-finite
components links with nothing, and so does one whose label is null; lengths
that differ within a label never link; a cosine equal to the radius links;
very long vectors are compared whole; rows that repeat a vec_id are vectors
of their own; a null vec_id names no component; recall is null where a label's
audit met no link; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, pick, release, table
from .simhash import _labels

COSINE = 0.93
SHARD = 1500
OVERLAP = 2
PROBES = 3
DEGREE = 24
CANDIDATES = 64
ALPHA = 1.2
BEAM = 24
SAMPLE = 4000
AUDIT = 64
GOAL = 0.97
CENTRES = 100_000
CHUNK = 50_000
_BLOCK = 256


def robust_prune(own: np.ndarray, x: np.ndarray, cand: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Of each own vector's candidates in x (-1: none) those that no nearer kept one is alpha times closer to; -1 fills up."""
    v = x[np.maximum(cand, 0)]
    far = 1 - np.einsum("nd,ncd->nc", own, v)
    far[cand < 0] = np.inf
    alive = np.isfinite(far)
    out = np.full((len(own), degree), -1)
    rows = np.arange(len(own))
    for k in range(degree):
        best = np.where(alive, far, np.inf).argmin(axis=1)
        ok = alive[rows, best]
        if not ok.any():
            break
        out[ok, k] = cand[rows[ok], best[ok]]
        between = 1 - np.einsum("nd,ncd->nc", v[rows, best], v)
        alive &= ~((alpha * between <= far) & ok[:, None])
        alive[rows, best] = False
    return out


def build(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency, as ``lists_of`` gives it, of unit vectors."""
    n = len(x)
    if n < 2:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
    c = min(CANDIDATES, n - 1)
    rng = np.random.default_rng(seed)
    graph = []
    for i in range(0, n, _BLOCK):
        s = x[i : i + _BLOCK] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        near = np.argpartition(-s, c - 1, axis=1)[:, :c]
        # Some far ones too, so that the graph hangs together.
        cand = np.concatenate([near, rng.integers(0, n, (len(s), 8))], axis=1)
        cand[cand == np.arange(i, i + len(s))[:, None]] = -1
        graph.append(robust_prune(x[i : i + _BLOCK], x, cand))
    g = np.concatenate(graph)
    # Edges are followed both ways: a hub that everyone's pruning keeps leads back to all of them.
    src = np.repeat(np.arange(n), g.shape[1])
    dst = g.ravel()
    ok = dst >= 0
    return lists_of(n, np.concatenate([src[ok], dst[ok]]), np.concatenate([dst[ok], src[ok]]))


def lists_of(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct edges as (where each node's begin, ends)."""
    pair = np.unique(src.astype(np.int64) * n + dst)
    return np.searchsorted(pair, np.arange(n + 1, dtype=np.int64) * n), pair % max(n, 1)


def search(x: np.ndarray, graph: tuple[np.ndarray, np.ndarray], q: np.ndarray, enter: tuple[np.ndarray, np.ndarray], radius: float, beam: int):
    """(query, node) of the nodes that a range-expanding greedy walk finds with a product of at least radius.

    enter: (query, node) pairs where walks begin.
    """
    n, m = len(x), len(q)
    begin, ends = graph
    rows = np.arange(m)
    score = np.full((m, n), -np.inf, np.float32)
    score[enter] = np.einsum("nd,nd->n", q[enter[0]], x[enter[1]])
    seen = score > -np.inf
    open_score = score.copy()
    best_of = -np.partition(-score, min(beam, n) - 1, axis=1)[:, : min(beam, n)]
    if best_of.shape[1] < beam:
        best_of = np.concatenate([best_of, np.full((m, beam - best_of.shape[1]), -np.inf, np.float32)], axis=1)
    active = rows
    while len(active):
        top = open_score[active].argmax(axis=1)
        s = open_score[active, top]
        # Go on while the next node could enter the beam, or lies within the radius.
        go = (s > -np.inf) & ((s >= best_of[active].min(axis=1)) | (s >= radius))
        active, top = active[go], top[go]
        if not len(active):
            break
        open_score[active, top] = -np.inf
        size = begin[top + 1] - begin[top]
        a = np.repeat(active, size)
        b = ends[np.repeat(begin[top] - (np.cumsum(size) - size), size) + np.arange(len(a))]
        ok = ~seen[a, b]
        a, b = a[ok], b[ok]
        if len(a):
            seen[a, b] = True
            v = np.einsum("nd,nd->n", q[a], x[b])
            score[a, b] = v
            open_score[a, b] = v
            # The best of what is new to each query go into its beam.
            by = np.lexsort((-v, a))
            a, v = a[by], v[by]
            nth = np.arange(len(a)) - np.searchsorted(a, a)
            few = nth < beam
            got = np.full((m, beam), -np.inf, np.float32)
            got[a[few], nth[few]] = v[few]
            both = np.concatenate([best_of[active], got[active]], axis=1)
            best_of[active] = -np.partition(-both, beam - 1, axis=1)[:, :beam]
    return np.nonzero(score >= radius)


def _unit(v) -> np.ndarray | None:
    if v is None or not len(v):
        return None
    x = np.array([np.nan if c is None else c for c in v], dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if not top:
        return None
    x = x / top
    return x / np.sqrt((x * x).sum())


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    flat = col.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _points(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, points): each row's point, and distinct usable (label, unit vector) with id, weight and least vec_id."""
    d = pick(vectors, "vec_id", "embedding", "label").withColumn("embedding", F.col("embedding").cast("array<double>"))
    ok = (
        "label is not null and embedding is not null and size(embedding) > 0 and exists(embedding, c -> c <> 0)"
        " and forall(embedding, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))"
    )
    d = d.withColumn("ok", F.expr(f"coalesce({ok}, false)"))
    rows = cut(d.withColumn("label", F.when(F.col("ok"), F.col("label").cast("string"))).withColumn("embedding", F.when(F.col("ok"), F.col("embedding"))).withColumn("dims", F.size("embedding")).withColumn("digest", F.when(F.col("ok"), F.md5(F.to_json(F.struct("label", "embedding"))))))
    points = (
        rows.where("ok")
        .groupBy("label", "dims", "digest")
        .agg(F.first("embedding").alias("v"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    )
    return rows, cut(points.withColumn("id", F.monotonically_increasing_id()))


def _sizes(points: DataFrame) -> DataFrame:
    """(label, dims, n, first): how many points each label has, and the least id, which names its only shard."""
    return cut(points.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")))


def _centroids(points: DataFrame, sizes: DataFrame, shard: int, sample: int) -> dict:
    """Per (label, dims) of more than a shard, unit centroids; from at most about ``sample`` points of each."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    size = max(shard, -(-total // CENTRES))
    large = sizes.where(F.col("n") > size).withColumn("k", F.ceil(F.col("n") / size))
    picked = points.select("label", "dims", "v", "digest").join(large.select("label", "dims", "n", "k"), ["label", "dims"])
    rate = F.least(F.lit(1.0), F.least(F.lit(sample), 40 * F.col("k")) / F.col("n"))
    picked = picked.where(F.pmod(F.xxhash64("digest"), F.lit(1_000_000)) < F.ceil(rate * 1_000_000))
    by: dict = {}
    for r in picked.collect():
        by.setdefault((r["label"], r["dims"], r["k"]), []).append((r["digest"], r["v"]))
    out = {}
    for (label, dims, k), got in by.items():
        x = np.array([_unit(v) for _, v in sorted(got)])
        k = min(len(x), k)
        c = x[np.linspace(0, len(x) - 1, k).astype(int)]
        for _ in range(8):
            near = (x @ c.T).argmax(axis=1)
            c = np.array([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(k)])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        out[label, dims] = c
    return out


def _dealt(points: DataFrame, sizes: DataFrame, centroids: dict, probes: int) -> DataFrame:
    """points with their shards, nearest first: those after the first OVERLAP are probed only."""
    base, at = {}, 0
    for k in sorted(centroids):
        base[k] = at
        at += len(centroids[k])

    def of(batches):
        for b in batches:
            lab, dims, vec, first = (b.column(c).to_pylist() for c in ("label", "dims", "v", "first"))
            shards, units = [], []
            for k, d, v, f in zip(lab, dims, vec, first, strict=True):
                u = _unit(v)
                c = centroids.get((k, d))
                shards.append([-1 - f] if c is None else (np.argsort(-(c @ u), kind="stable")[: max(probes, OVERLAP)] + base[k, d]).tolist())
                units.append(u.tolist())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("weight"), pa.array(units, pa.list_(pa.float64())), pa.array(shards, pa.list_(pa.int64()))], ["id", "weight", "u", "shards"])

    named = points.join(sizes.select("label", "dims", "first"), ["label", "dims"])
    return named.select("id", "weight", "label", "dims", "v", "first").mapInArrow(of, "id long, weight long, u array<double>, shards array<bigint>")


def _placed(dealt: DataFrame, shard: int) -> DataFrame:
    """dealt by (shard, sub): one row for each part of each probed shard, member where the part indexes the point."""
    rows = dealt.select("id", "weight", "u", "shards", F.posexplode("shards").alias("nth", "shard"))
    crowded = cut(
        dealt.select(F.explode(F.slice("shards", 1, OVERLAP)).alias("shard"))
        .groupBy("shard")
        .agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("parts"))
        .where("parts > 2")
    )
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = rows.join(crowded, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own)
    rows = rows.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("member", (F.col("nth") < OVERLAP) & (F.col("sub") == F.col("own"))).drop("parts", "own", "nth")


def _graphs(placed: DataFrame) -> DataFrame:
    """(id, near): the united adjacency lists."""

    def grow(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        begin, ends = build(_matrix(t.column("u"))[order].astype(np.float32))
        near = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids[ends]))
        return pa.table({"id": ids, "near": near})

    lists = placed.where("member").select("shard", "sub", "id", "u").groupBy("shard", "sub").applyInArrow(grow, "id long, near array<long>")
    return lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def _found(placed: DataFrame, lists: DataFrame, radius: float, beam: int, exact_pass: bool = False) -> DataFrame:
    """(kind, a, b): counts (0: point, weight of what it links to) and forest edges (1: point, point)."""
    rows = placed.join(lists.withColumnRenamed("id", "at"), F.col("id") == F.col("at")).drop("at")

    def look(t: pa.Table) -> pa.Table:
        ids, member = t.column("id").to_numpy(), t.column("member").to_numpy(zero_copy_only=False)
        here = t.column("shard")[0].as_py()
        order = np.lexsort((ids, ~member))  # members come first
        ids, weight = ids[order], t.column("weight").to_numpy()[order]
        n = int(member.sum())
        counts = np.zeros(len(ids), np.int64)
        lab = np.arange(len(ids))
        if n:
            exact = _matrix(t.column("u"))[order]
            x = exact.astype(np.float32)
            shards = _matrix(t.column("shards"))[order]
            near = t.column("near").combine_chunks().take(pa.array(order))
            owner = np.repeat(np.arange(len(ids)), near.value_lengths().to_numpy())
            to = near.flatten().to_numpy()
            at = np.minimum(np.searchsorted(ids[:n], to), n - 1)
            held = ids[:n][at] == to
            owner, at = owner[held], at[held]  # of every query: its neighbours among the members
            graph = lists_of(n, owner[owner < n], at[owner < n])
            members = x[:n]
            medoid = int((members @ members.mean(axis=0)).argmax())
            for i in range(0, len(ids), _BLOCK):
                m = min(_BLOCK, len(ids) - i)
                lo, hi = np.searchsorted(owner, [i, i + m])
                own = np.arange(i, max(i, min(i + m, n)))
                enter = (np.concatenate([np.arange(m), owner[lo:hi] - i, own - i]), np.concatenate([np.full(m, medoid), at[lo:hi], own]))
                if exact_pass:
                    q, p = np.nonzero(x[i : i + m] @ members.T >= radius - 1e-4)
                else:
                    q, p = search(members, graph, x[i : i + m], enter, radius - 1e-4, beam)
                q = q + i
                keep = (q != p) & (ids[q] != ids[p])
                q, p = q[keep], p[keep]
                keep = np.einsum("nd,nd->n", exact[q], exact[p]) >= radius
                q, p = q[keep], p[keep]
                lab = _labels(len(ids), q, p, lab)
                # Only the first shard, in the query's order, that indexes the point counts it.
                both = (shards[q][:, :, None] == shards[p][:, None, :OVERLAP]).any(axis=2)
                first = shards[q, both.argmax(axis=1)] == here
                np.add.at(counts, q[first], weight[p[first]])
        tied = np.flatnonzero(lab != np.arange(len(ids)))
        some = np.flatnonzero(counts)
        kind = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(tied), np.int32)])
        return pa.table({"kind": kind, "a": np.concatenate([ids[some], ids[tied]]), "b": np.concatenate([counts[some], ids[lab[tied]]])})

    return rows.groupBy("shard", "sub").applyInArrow(look, "kind int, a long, b long")


def _audit(points: DataFrame, sizes: DataFrame, found: DataFrame, radius: float, most: int) -> DataFrame:
    """(label, dims, recall): the share of the exact links of about ``most`` points of each label that were found."""
    chunks = F.ceil(F.col("n") / CHUNK)
    p = points.select("id", "weight", "label", "dims", "v", "digest").join(sizes.select("label", "dims", "n"), ["label", "dims"])
    rate = F.least(F.lit(1.0), F.lit(most) / F.col("n"))
    asked = p.where(F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(1_000_000)) < F.ceil(rate * 1_000_000))
    asked = asked.select(F.col("label").alias("q0"), F.col("dims").alias("q1"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("q2"), F.col("id").alias("qid"), F.col("v").alias("qv"))
    p = p.select("label", "dims", F.pmod(F.xxhash64("id"), chunks).alias("chunk"), "id", "weight", "v")

    def count(ours: pa.Table, queries: pa.Table) -> pa.Table:
        out_i, out_n = [], []
        if ours.num_rows and queries.num_rows:
            ids, w = ours.column("id").to_numpy(), ours.column("weight").to_numpy()
            x = np.array([_unit(v) for v in ours.column("v").to_pylist()])
            for i, v in zip(queries.column("qid").to_pylist(), queries.column("qv").to_pylist(), strict=True):
                hit = (x @ _unit(v) >= radius) & (ids != i)
                if hit.any():
                    out_i.append(i)
                    out_n.append(int(w[hit].sum()))
        return pa.table({"id": pa.array(out_i, pa.int64()), "n": pa.array(out_n, pa.int64())})

    truth = p.groupBy("label", "dims", "chunk").cogroup(asked.groupBy("q0", "q1", "q2")).applyInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    got = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("got"))
    r = truth.join(got, "id", "left").join(points.select("id", "label", "dims"), "id")
    return cut(r.groupBy("label", "dims").agg((F.sum(F.least("n", F.coalesce("got", F.lit(0)))) / F.sum("n")).alias("recall")))


def embedding_groups(vectors: DataFrame, radius: float = COSINE, shard: int = SHARD, probes: int = PROBES, beam: int = BEAM, goal: float = GOAL, audit: int = AUDIT) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept, recall (as audited for its label, null without a link)."""
    rows, points = _points(vectors)
    sizes = _sizes(points)
    centroids = _centroids(points, sizes, shard, SAMPLE)
    most = max([len(c) for c in centroids.values()], default=1)
    exact = False
    while True:
        dealt = cut(_dealt(points, sizes, centroids, probes))
        placed = _placed(dealt, shard)
        lists = cut(_graphs(placed))
        found = cut(_found(placed, lists, radius, beam, exact))
        audited = _audit(points, sizes, found, radius, audit)
        least = audited.agg(F.min("recall")).first()[0]
        if exact or least is None or least >= goal:
            break
        release(dealt), release(lists), release(found), release(audited)
        exact = probes >= most and beam >= 8 * BEAM
        probes, beam = (most, beam) if exact else (min(most, 2 * probes), 2 * beam)
    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("far"))
    comp = components(found.where("kind = 1").select("a", "b"))
    p = points.select("id", "label", "dims", "digest", "weight", "least")
    p = p.join(counts, F.col("id") == F.col("a"), "left").join(comp, F.col("id") == F.col("node"), "left")
    p = p.join(audited, ["label", "dims"], "left")
    p = cut(p.select("digest", "least", "recall", (F.col("weight") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("root")))
    named = cut(p.groupBy("root").agg(F.min("least").alias("component_id")))
    p = cut(p.join(named, "root").select(F.col("digest").alias("of"), "n_links", "component_id", "recall"))
    j = rows.select("vec_id", "digest").join(p, F.col("digest") == F.col("of"), "left")
    component = F.when(F.col("of").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return j.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
        "recall",
    )


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_embeddings": op3_embeddings}
ORACLES: dict[str, str] = {}
