"""Mixing sources to target weights by iterative proportional fitting.

Documents are grouped into cells (source, language, topic) with their tokens
summed, pre-aggregated before the shuffle, so a source that holds a third of
all rows is a handful of cells.  The cells' weights are raked until their
sums over each dimension match the targets; a document's probability is the
raked share of its cell over its natural share, scaled so that the expected
tokens meet the budget and capped at 1.  A document is sampled if a uniform
number made from its id and text by hashing lies below its probability.

Cells are counted first.  Up to LOCAL_CELLS are raked on the driver and
broadcast; beyond that the same sweeps run as aggregations and joins.

Where the table has no topic, topics are fitted on all documents: they are
vectors of their words' logarithmic counts in WIDTH hashed places, weighed by
how few of them hold a place, and k-means on their angles makes TOPICS centres
in at most ROUNDS rounds.  Every document then has the topic of the nearest
centre.  The vectors are written once, only with the places that hold words,
and each round reads them again; what rounds add up are whole numbers, so that
the centres do not depend on how rows are dealt out.

Defined results: null sources and languages are a category of their own; a
null or empty text has no tokens and topic 0, and its cell takes part with
the share that its tokens give (a cell without tokens has probability 0);
very long texts are read whole; of equally near centres the first counts;
targets without tokens are left out and the others scaled to sum to 1; a
dimension without any usable target keeps its natural shares; rows of equal id
and text are sampled alike; an empty table gives an empty result; columns that
are not named are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pick, release, table

TOPICS = 8
ROUNDS = 20
WIDTH = 1024
#: What a vector holds: places, ascending, with their logarithmic counts.
ENTRY = np.dtype([("at", "<u2"), ("x", "<f4")])
#: A vector's parts are added up in steps of 1 / UNIT.
UNIT = 1 << 26
TEMPER = 0.7
SHARE = 0.5
SWEEPS = 200
LOCAL_CELLS = 50_000
DIMS = ("source", "lang", "topic")


def _words(text: str | bytes | None) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text or b"").lower().split()


def vector(words: list[bytes]) -> np.ndarray:
    """Logarithmic counts of words in hashed places."""
    seen = Counter(words)
    at = np.fromiter((zlib.crc32(w) % WIDTH for w in seen), np.int64, len(seen))
    return np.bincount(at, np.log1p(np.fromiter(seen.values(), float, len(seen))), WIDTH).astype(np.float32)


def entries(words: list[bytes]) -> bytes:
    """The same without the places that hold nothing."""
    x = vector(words)
    at = x.nonzero()[0]
    e = np.empty(len(at), ENTRY)
    e["at"], e["x"] = at, x[at]
    return e.tobytes()


def entries_udf():
    """Entries and tokens of texts; a batch's words would fill a worker, so they are held for one text at a time."""

    @F.arrow_udf("x binary, tokens long")
    def of(texts: pa.Array) -> pa.Array:
        x, tokens = [], []
        for t in texts.cast(pa.binary()):
            words = _words(t.as_py())
            x.append(entries(words))
            tokens.append(len(words))
        return pa.StructArray.from_arrays([pa.array(x, pa.binary()), pa.array(tokens, pa.int64())], ["x", "tokens"])

    return of


def _pieces(col: pa.Array, rows: int = 500):
    """(entries, where each row of them starts) of vectors with words, a few rows at a time."""
    if not len(col):
        return
    col = col.cast(pa.binary())
    ends = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, 4 * col.offset)
    for i in range(0, len(col), rows):
        part = ends[i : i + rows + 1]
        yield np.frombuffer(col.buffers()[2], ENTRY, (part[-1] - part[0]) // ENTRY.itemsize, part[0]), (part[:-1] - part[0]) // ENTRY.itemsize


def _weighed(e: np.ndarray, starts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Entries' values in vectors of length 1."""
    w = e["x"] * idf[e["at"]]
    return w / np.repeat(np.sqrt(np.add.reduceat(w * w, starts)), np.diff(starts, append=len(e)))


def _products(e: np.ndarray, starts: np.ndarray, w: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of rows and centres; a row's are the same whichever rows stand beside it."""
    return np.array([np.add.reduceat(k.take(e["at"]) * w, starts) for k in c]).T


def _summed(vectors: DataFrame, of, slots: int) -> np.ndarray:
    """Whole numbers, added up by slot; of makes each piece's from its entries and starts."""

    def run(batches):
        all_of = np.zeros(slots, np.int64)
        for b in batches:
            for e, starts in _pieces(b.column("x")):
                all_of += of(e, starts).astype(np.int64)
        at = all_of.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(all_of[at])], ["slot", "n"])

    got = vectors.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(slots, np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def _farthest(vectors: DataFrame, idf: np.ndarray, c: np.ndarray) -> tuple[float, np.ndarray]:
    """The vector whose greatest product with c is least, and that product; of equal ones the first in byte order."""

    def run(batches):
        best = None
        for b in batches:
            i = 0
            for e, starts in _pieces(b.column("x")):
                near = _products(e, starts, _weighed(e, starts, idf), c).max(axis=1)
                low = float(near.min())
                if best is None or low <= best[0]:
                    x = min(b.column("x")[i + int(k)].as_py() for k in (near == low).nonzero()[0])
                    best = min(best or (low, x), (low, x))
                i += len(starts)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], pa.binary())], ["s", "x"])

    s, x = vectors.mapInArrow(run, "s double, x binary").agg(F.min(F.struct("s", "x")).alias("m")).first()[0]
    e = np.frombuffer(bytes(x), ENTRY)
    u = np.zeros(len(idf))
    u[e["at"]] = _weighed(e, np.zeros(1, np.int64), idf)
    return s, u


def _fit(vectors: DataFrame, topics: int = TOPICS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray] | None:
    """(weights of places, unit centres) of all vectors (x); None without words."""
    vectors = vectors.select("x").where("octet_length(x) > 0")
    held = _summed(vectors, lambda e, starts: np.append(np.bincount(e["at"], minlength=WIDTH), len(starts)), WIDTH + 1)
    if not held[-1]:
        return None
    idf = np.log((held[-1] + 1) / (held[:-1] + 1)) + 0.01

    def sums(c: np.ndarray) -> np.ndarray:
        """The sum of the vectors that each centre is nearest to."""

        def of(e, starts):
            w = _weighed(e, starts, idf)
            near = _products(e, starts, w, c).argmax(axis=1)
            return np.bincount(np.repeat(near, np.diff(starts, append=len(e))) * WIDTH + e["at"], np.rint(w * UNIT), len(c) * WIDTH)

        return _summed(vectors, of, len(c) * WIDTH).reshape(len(c), WIDTH) / UNIT

    # To begin with: the mean's farthest vector, then each time the one farthest from all before, while directions differ.
    c = np.array([_farthest(vectors, idf, sums(np.zeros((1, WIDTH))))[1]])
    while len(c) < topics:
        s, u = _farthest(vectors, idf, c)
        if s > 1 - 1e-9:
            break
        c = np.array([*c, u])
    for _ in range(rounds):
        new = sums(c)
        long = np.linalg.norm(new, axis=1, keepdims=True)
        new = np.where(long > 0, new / np.maximum(long, 1e-12), c)
        if np.abs(new - c).max() < 1e-9:
            break
        c = new
    return idf, c


def fit_topics(docs: DataFrame, topics: int = TOPICS) -> tuple[np.ndarray, np.ndarray] | None:
    """The topics of all docs (text): weights of places and unit centres; None without words."""
    vectors = cut(docs.select(entries_udf()("text")["x"].alias("x")))
    model = _fit(vectors, topics)
    release(vectors)
    return model


def topic_of(text: str | None, model: tuple[np.ndarray, np.ndarray] | None) -> tuple[int, int]:
    """(topic, tokens)."""
    words = _words(text)
    if not words or model is None:
        return 0, len(words)
    idf, c = model
    e, first = np.frombuffer(entries(words), ENTRY), np.zeros(1, np.int64)
    return int(_products(e, first, _weighed(e, first, idf), c).argmax()), len(words)


def topics_udf(model: tuple[np.ndarray, np.ndarray] | None):

    @F.pandas_udf("topic int, tokens long")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([topic_of(t, model) for t in texts], columns=["topic", "tokens"])

    return of


def nearest_udf(model: tuple[np.ndarray, np.ndarray] | None):
    """The topics of vectors, as ``topic_of`` gives them for their texts."""

    @F.arrow_udf("int")
    def of(x: pa.Array) -> pa.Array:
        out = np.zeros(len(x), np.int32)
        some = np.array([len(v) > 0 for v in x.to_pylist()], bool)
        if model is not None and some.any():
            idf, c = model
            near = [_products(e, starts, _weighed(e, starts, idf), c).argmax(axis=1) for e, starts in _pieces(x.filter(pa.array(some)))]
            out[some] = np.concatenate(near)
        return pa.array(out)

    return of


def rake(cells: list[tuple], targets: list[dict], sweeps: int = SWEEPS, tol: float = 1e-10) -> np.ndarray:
    """Weights of cells (one key per dimension, then tokens) whose marginal sums meet the targets.

    Each target maps the dimension's keys to shares; sweeps scale every
    dimension in turn.  Where the cells' pattern of zeros does not allow the
    targets, the last sweep's weights are returned (the last dimension then
    fits and the others come as near as they do).
    """
    w = np.array([c[-1] for c in cells], float)
    if not w.sum():
        return w
    w /= w.sum()
    codes, aims = [], []
    for d, t in enumerate(targets):
        keys = sorted({c[d] for c in cells})
        at = {k: i for i, k in enumerate(keys)}
        code = np.array([at[c[d]] for c in cells])
        here = np.bincount(code, w, len(keys))
        aim = np.array([t.get(k, 0.0) for k in keys]) * (here > 0)
        codes.append(code)
        aims.append(aim / aim.sum() if aim.sum() else here)
    for _ in range(sweeps):
        old = w
        for code, aim in zip(codes, aims, strict=True):
            now = np.bincount(code, w, len(aim))
            w = w * np.divide(aim, now, out=np.zeros_like(aim), where=now > 0)[code]
        if np.abs(w - old).max() < tol:
            break
    return w


def tempered(tokens: dict, temper: float = TEMPER) -> dict:
    """Shares in proportion to the tokens' power ``temper``: small categories gain, large ones lose."""
    p = {k: float(v) ** temper if v else 0.0 for k, v in tokens.items()}
    s = sum(p.values())
    return {k: v / s for k, v in p.items()} if s else p


def probabilities(tokens: np.ndarray, weights: np.ndarray, share: float) -> np.ndarray:
    """Per cell min(1, c * raked / natural) with c such that the expected tokens are share of all."""
    total = tokens.sum()
    if not total:
        return np.zeros(len(tokens))
    gain = np.divide(weights * total, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    budget = min(share * total, tokens[gain > 0].sum())
    lo, hi = 0.0, 1.0
    while (tokens * np.minimum(1, hi * gain)).sum() < budget * (1 - 1e-12) and hi < 1e12:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (tokens * np.minimum(1, mid * gain)).sum() < budget else (lo, mid)
    return np.minimum(1, hi * gain)


def _rake_wide(cells: DataFrame, targets: list[dict] | None, temper: float, share: float, sweeps: int) -> DataFrame:
    """The same as aggregations and joins, for more cells than the driver takes."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now = cut(cells.withColumn("w", F.col("tokens") / F.lit(float(max(total, 1)))))
    spark = cells.sparkSession
    aims = []
    for d in range(3):
        if targets is None:
            m = cells.groupBy(f"k{d}").agg(F.sum("tokens").alias("t")).withColumn("raw", F.pow(F.col("t").cast("double"), temper))
        else:
            m = spark.createDataFrame(list(targets[d].items()) or [("", 0.0)], f"k{d} string, raw double").join(cells.where("tokens > 0").select(f"k{d}").distinct(), f"k{d}", "left_semi")
        s = m.agg(F.sum("raw")).first()[0]
        if not s:  # no usable target: the dimension keeps its natural shares
            m = cells.groupBy(f"k{d}").agg(F.sum("tokens").alias("raw"))
            s = float(max(total, 1))
        aims.append(cut(m.select(f"k{d}", (F.col("raw") / s).alias("aim"))))
    for _ in range(sweeps):
        before = now
        step = before.withColumn("old", F.col("w"))
        for d in range(3):
            have = step.groupBy(f"k{d}").agg(F.sum("w").alias("have"))
            scale = have.join(aims[d], f"k{d}", "left").select(f"k{d}", F.when(F.col("have") > 0, F.coalesce("aim", F.lit(0.0)) / F.col("have")).otherwise(0.0).alias("by"))
            step = step.join(scale, f"k{d}").withColumn("w", F.col("w") * F.col("by")).drop("by")
        now = cut(step)
        if (now.agg(F.max(F.abs(F.col("w") - F.col("old")))).first()[0] or 0.0) < 1e-10:
            break
        now = now.drop("old")
    gain = cut(now.select("k0", "k1", "k2", "tokens", F.when(F.col("tokens") > 0, F.col("w") * total / F.col("tokens")).otherwise(0.0).alias("gain")))
    reach = lambda c: gain.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("gain") * c))).first()[0] or 0.0
    budget = min(share * total, gain.where("gain > 0").agg(F.sum("tokens")).first()[0] or 0)
    lo, hi = 0.0, 1.0
    while reach(hi) < budget * (1 - 1e-12) and hi < 1e12:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if reach(mid) < budget else (lo, mid)
    return gain.select("k0", "k1", "k2", F.least(F.lit(1.0), F.col("gain") * hi).alias("probability"))


def _key(c: str):
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))


def _mixed(d: DataFrame, temper: float, share: float, targets: dict | None, seed: int, local_cells: int) -> DataFrame:
    """d (source, lang, topic, tokens, doc_id, th and more) with probability and sampled."""
    d = d.select("*", *[_key(c).alias(f"k{i}") for i, c in enumerate(DIMS)])
    cells = cut(d.groupBy("k0", "k1", "k2").agg(F.sum("tokens").alias("tokens")))
    keyed = None if targets is None else [{("null" if k is None else f"={k}"): v for k, v in targets.get(c, {}).items()} for c in DIMS]
    if cells.count() <= local_cells:
        rows = [tuple(r) for r in cells.collect()]
        tokens = np.array([r[3] for r in rows], float)
        aims = keyed
        if aims is None:
            aims = []
            for i in range(3):
                sums: dict = {}
                for r in rows:
                    sums[r[i]] = sums.get(r[i], 0) + r[3]
                aims.append(tempered(sums, temper))
        p = probabilities(tokens, rake(rows, aims), share) if rows else []
        found = d.sparkSession.createDataFrame([(*r[:3], float(x)) for r, x in zip(rows, p, strict=True)], "k0 string, k1 string, k2 string, probability double")
        out = d.join(F.broadcast(found), ["k0", "k1", "k2"])
    else:
        out = d.join(_rake_wide(cells, keyed, temper, share, SWEEPS), ["k0", "k1", "k2"])
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("th")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return out.withColumn("sampled", u < F.col("probability")).drop("k0", "k1", "k2", "th")


def mix(docs: DataFrame, share: float = SHARE, temper: float = TEMPER, targets: dict | None = None, topic: str | None = None, seed: int = 17, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """One row per row of docs: doc_id, source, lang, topic, tokens, probability, sampled.

    targets: {"source": {value: share}, "lang": ..., "topic": ...}; where none
    are given, each dimension's shares are its natural ones to the power
    ``temper``.  topic names a column to take instead of the derived topic.
    """
    d = pick(docs, "doc_id", "text", "source", "lang", *([topic] if topic else []))
    t = topics_udf(None)("text") if topic else entries_udf()("text")
    made = d.select("doc_id", "source", "lang", F.xxhash64("text").alias("th"), *([topic] if topic else []), t.alias("t"))
    made = made.select("doc_id", "source", "lang", "th", *([F.col(topic).alias("topic")] if topic else ["t.x"]), "t.tokens")
    narrow = cut(made)
    if not topic:
        vectors, model = narrow, _fit(narrow)
        narrow = cut(vectors.select("doc_id", "source", "lang", "th", nearest_udf(model)("x").alias("topic"), "tokens"))
        release(vectors)
    return _mixed(narrow, temper, share, targets, seed, local_cells)


def sample(docs: DataFrame, share: float = SHARE, temper: float = TEMPER, targets: dict | None = None, seed: int = 17) -> DataFrame:
    """The sampled rows of docs: doc_id, text, lang, source and n_chars only, with their topic, tokens and probability."""
    d = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    d = d.select("*", topics_udf(fit_topics(d))("text").alias("t"), F.xxhash64("text").alias("th"))
    d = d.select("doc_id", "text", "lang", "source", "n_chars", "th", "t.topic", "t.tokens")
    return _mixed(d, temper, share, targets, seed, LOCAL_CELLS).where("sampled").drop("sampled")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op2_mixing": op2_mixing}
ORACLES: dict[str, str] = {}
