"""SimHash near-dedup by a self-join of binary tries.

Fingerprints are made per text in Arrow batches and then deduplicated, so a
group of copies is one key from there on.  Of ``bits`` + 1 parts of the 64
bits, two fingerprints that differ in at most ``bits`` bits agree in at least
one whole part.  Hence ``bits`` + 1 tries are joined with themselves, each on
the key rotated so that another part comes first: the traversal walks pairs
of nodes together, adds up differing bits and drops a pair of nodes at once
when the budget is exceeded, which is zero within the first part and ``bits``
after it.

The tries' subtrees below the first part are dealt to tasks of about BLOCK
keys; every key goes to one task for each trie, so what is shuffled is in
proportion to the number of distinct fingerprints.  A crowded subtree is
split into chunks of at most BLOCK keys, and each pair of chunks is a task.
A task yields a spanning forest of the links it finds, not the links, and
stops descending where both nodes already lie in one component, so a dense
group of thousands of near copies costs neither its square in rows nor in
time.  Components are then found over those forests by rounds of star
contraction.

A key is copied once for each chunk of its subtree, which for evenly spread
fingerprints is about n / 2^13 / BLOCK chunks: 8 at 10^9 keys, 75 at 10^10.

Defined results: a null or wordless text has fingerprint zero and links like
any other; a bit that exactly half of the shingles set is 0; very long texts
are read whole, their hashes a part at a time; equal rows share a component; a null doc_id is carried but never
names a component (a component of such rows only has a null id); an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, pick, table, without

SHINGLE = 4
BITS = 4
SEED = 42
BLOCK = 16_384
_STEP = 1 << 17
_HASHES = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text, unsigned."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    k = min(shingle, n)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.empty(n, np.int64)
    starts[0] = 0
    starts[1:] = ends[:-1] + 1
    spans = list(zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))
    ones = np.zeros(64, np.int64)
    of = xxhash.xxh64_intdigest
    for i in range(0, len(spans), _HASHES):
        h = np.array([of(joined[s:e], SEED) for s, e in spans[i : i + _HASHES]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    on = np.packbits(2 * ones > len(spans), bitorder="little")
    return int(on.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def of(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(of, "doc_id long, fp long")


def _labels(n: int, u: np.ndarray, v: np.ndarray, lab: np.ndarray) -> np.ndarray:
    """lab, each node's least known companion, after the links u-v."""
    while True:
        a, b = lab[u], lab[v]
        m = a != b
        if not m.any():
            return lab
        u, v, a, b = u[m], v[m], a[m], b[m]
        up = np.arange(n)
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while True:
            q = up[up]
            if (q == up).all():
                break
            up = q
        lab = up[lab]


def _runs(x: np.ndarray) -> np.ndarray:
    """For each place the end of the run of equal values that holds it."""
    n = len(x)
    ends = np.append(np.flatnonzero(x[1:] != x[:-1]) + 1, n)
    return ends[np.searchsorted(ends, np.arange(n), side="right")]


def trie_links(a: np.ndarray, b: np.ndarray | None, free: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (key, key), of the links between keys of a and b (None: within a).

    Keys are uint64.  Linked keys agree in the first ``free`` bits and differ
    in at most ``bits`` of all.
    """
    alone = b is None
    a = np.unique(a)
    b = a if alone else np.unique(b)
    if not len(a) or not len(b):
        return a[:0], a[:0]
    shift = 0 if alone else len(a)
    keys = a if alone else np.concatenate([a, b])
    lab = np.arange(len(keys))
    run_a = run_b = None
    one = np.uint64(1)
    # Pairs of subtrees below equal first parts; above them a node meets itself only.
    down = np.uint64(64 - free)
    ha, hb = (a >> down, b >> down) if free else (np.zeros(len(a), np.uint64), np.zeros(len(b), np.uint64))
    top = np.intersect1d(ha, hb)
    ends = [np.searchsorted(h, top, side=s) for h in (ha, hb) for s in ("left", "right")]
    stack = [(free, np.array([*ends, np.zeros(len(top), np.int64)]).astype(np.int64))]
    while stack:
        depth, f = stack.pop()
        if run_a is not None:
            al, ah, bl, bh, _ = f
            same = (run_a[al] >= ah) & (run_b[bl] >= bh) & (lab[al] == lab[bl + shift])
            if alone:
                same &= (al != bl) | (ah - al > 1)
            f = f[:, ~same]
        if not f.shape[1]:
            continue
        if f.shape[1] > _STEP:
            cut_at = f.shape[1] // 2
            stack += [(depth, f[:, cut_at:]), (depth, f[:, :cut_at])]
            continue
        al, ah, bl, bh, diff = f
        cells = (ah - al) * (bh - bl)
        leaf = (cells <= 16) | (depth >= 64)
        if leaf.any():
            la, lb, w, c = al[leaf], bl[leaf], (bh - bl)[leaf], cells[leaf]
            at = np.repeat(np.cumsum(c) - c, c)
            off = np.arange(int(c.sum())) - at
            w = np.repeat(w, c)
            x, y = np.repeat(la, c) + off // w, np.repeat(lb, c) + off % w
            d = a[x] ^ b[y]
            ok = np.bitwise_count(d) <= bits
            if alone:
                ok &= x < y
            if ok.any():
                new = _labels(len(keys), x[ok], y[ok] + shift, lab)
                if new is not lab:
                    lab = new
                    run_a, run_b = _runs(lab[: len(a)]), _runs(lab[shift:])
        f = f[:, ~leaf]
        if not f.shape[1]:
            continue
        al, ah, bl, bh, diff = f
        bit = one << np.uint64(63 - depth)
        high = ~(bit | (bit - one)) if depth else np.uint64(0)
        am = np.clip(np.searchsorted(a, (a[al] & high) | bit), al, ah)
        bm = np.clip(np.searchsorted(b, (b[bl] & high) | bit), bl, bh)
        kids = [np.stack([al, am, bl, bm, diff]), np.stack([am, ah, bm, bh, diff])]
        m = diff < bits
        kids.append(np.stack([al, am, bm, bh, diff + 1])[:, m])
        if alone:
            m = m & (al != bl)
        kids.append(np.stack([am, ah, bl, bm, diff + 1])[:, m])
        nxt = np.concatenate(kids, axis=1)
        stack.append((depth + 1, nxt[:, (nxt[0] < nxt[1]) & (nxt[2] < nxt[3])]))
    tied = np.flatnonzero(lab != np.arange(len(keys)))
    return keys[tied], keys[lab[tied]]


def parts_of(bits: int) -> list[tuple[int, int]]:
    """(first bit from the top, length) of bits + 1 parts of 64 bits."""
    n = bits + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(n)]


def turn(x: np.ndarray, by: int) -> np.ndarray:
    """Rotate to the left."""
    by %= 64
    return x if not by else (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def link_fingerprints(fps: DataFrame, n: int, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): a forest that spans the links between the n distinct longs fp."""
    ways = parts_of(bits)
    tasks = max(1, -(-n // block))
    one = lambda o, at, size: F.struct(
        F.lit(o).alias("o"),
        F.expr(f"shiftleft(fp, {at}) | shiftrightunsigned(fp, {64 - at})" if at else "fp").alias("key"),
        F.expr(f"shiftrightunsigned(shiftleft(fp, {at}), {64 - size})").alias("cell"),
    )
    keys = fps.select(F.explode(F.array(*[one(o, at, size) for o, (at, size) in enumerate(ways)])).alias("k")).select("k.*")
    # At most a few times 2^13 subtrees, whatever n is.
    crowded = cut(keys.groupBy("o", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks")).where("chunks > 1"))
    placed = keys.join(F.broadcast(crowded), ["o", "cell"], "left")
    slot = F.pmod(F.xxhash64("cell"), F.lit(tasks)).cast("int")
    alone = F.array(F.struct(F.lit(-1).cast("long").alias("cell"), slot.alias("lo"), slot.alias("hi"), F.lit(0).alias("side")))
    own = F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")
    placed = placed.withColumn("own", own)
    shared = F.expr("transform(sequence(0, chunks - 1), e -> struct(cell as cell, least(own, e) as lo, greatest(own, e) as hi, if(own > e, 1, 0) as side))")
    placed = placed.select("o", "key", F.explode(F.when(F.col("chunks").isNull(), alone).otherwise(shared)).alias("t")).select("o", "key", "t.*")

    def join(t: pa.Table) -> pa.Table:
        at, size = ways[t.column("o")[0].as_py()]
        k = t.column("key").to_numpy().view(np.uint64)
        side = t.column("side").to_numpy()
        x, y = k[side == 0], k[side == 1]
        got = [turn(g, 64 - at) for g in trie_links(x, y if len(y) else None, size, bits)]
        return pa.table({"a": pa.array(got[0].view(np.int64)), "b": pa.array(got[1].view(np.int64))})

    return placed.groupBy("o", "cell", "lo", "hi").applyInArrow(join, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (least doc_id of the component)."""
    f = cut(fingerprints(docs, shingle))
    reps = cut(f.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = link_fingerprints(reps.select("fp"), reps.count(), bits, block)
    comp = components(links)
    rooted = reps.join(comp, reps["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    to = cut(rooted.join(named, "root").select(F.col("fp").alias("to_fp"), "component_id"))
    return f.join(to, F.col("fp") == F.col("to_fp")).select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash_groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, near: int = 500_000) -> DataFrame:
    """The rows of docs that name their group, with doc_id, text, lang, source and n_chars only.

    Of rows with equal doc_id all or none stay; rows of null doc_id stay.
    """
    d = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    g = simhash_groups(d, shingle, bits)
    return without(d, F.col("doc_id"), g.where("doc_id <> component_id").select("doc_id"), near)


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
