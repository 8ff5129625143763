"""Toxicity by compression distance.

Two kinds of zstandard dictionary are made from labelled documents, ordinary
and toxic.  The ordinary one is trained by zstandard on windows of ordinary
documents.  The toxic one has the same ordinary content, with pieces at its
head that toxic documents hold far more often than ordinary ones.  This
departs from two plainly trained dictionaries: on the rows kept for
calibration those told the classes apart with an area under the curve of less
than 0.67 at every window and dictionary size tried, because the trainer
spends its room on what both kinds of text share.  Every text is cut into
windows of WINDOW words; each window is compressed with either dictionary, and
the difference of the two lengths is how toxic it looks.  PAIRS pairs with
ordinary text of their own are compared, and the median and the least of their
differences are kept, so that one pair's chance match counts for little.

Five figures of a document's windows (largest median, largest least, both
sums, number of windows) are weighed into one number whose threshold is
calibrated.  Dictionaries are made from rows with crc32(doc_id as text) mod 5
of 2, 3 and 4, weights and threshold fitted on rows with 1, and rows with 0
are never read.  No label, language, source or id is an input of a score.

Bounds, all parameters: at most about TRAIN_DOCS labelled documents of either
class, picked by hash of doc_id, each of at most LONGEST_TRAINED bytes (longer
ones only take no part in training); copies of a text count once.

Defined results: a null or empty text has no windows and gets the score of
zeros; very long texts are scored over all their windows, one batch holding
their differences only; equal texts score alike; rows that repeat a doc_id are
scored as rows of their own, a label given twice counts once, and of a labelled
doc_id with several texts the least text is trained on; a null label or doc_id
is no training row; ties at a threshold of differences count as toxic; without
labelled rows of both classes for dictionaries and calibration every score is
0; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

WINDOW = 12
TRAIN_DOCS = 3000
ORDINARY_BYTES = 8000
TOXIC_BYTES = 4096
LEVEL = 3
PAIRS = 3
#: A telling piece stands in one of so many of the toxic windows at least.
RAREST = 500
LONGEST_TRAINED = 20_000


def windows(text: bytes) -> list[bytes]:
    """Runs of WINDOW words, A-Z lower-cased, with a blank at both ends."""
    w = text.lower().split()
    return [b" " + b" ".join(w[i : i + WINDOW]) + b" " for i in range(0, len(w), WINDOW)]


def _openings(window: bytes) -> set[bytes]:
    """What words begin with, at 4 to 12 bytes, and whole words; each with the gap before it."""
    out = set()
    for w in window.split():
        for n in range(4, min(len(w), 12) + 1):
            out.add(b" " + w[:n])
        out.add(b" " + w + b" ")
    return out


def _telling(toxic: list[bytes], plain: list[bytes], room: int) -> bytes:
    """The pieces that set toxic texts apart, the most telling last.

    Pieces are counted over distinct windows, so copies of a text count once.
    """
    t, p = Counter(), Counter()
    tw, pw = ({w for x in texts for w in windows(x)} for texts in (toxic, plain))
    for x in tw:
        t.update(_openings(x))
    least = max(5, len(tw) // RAREST)
    t = {s: n for s, n in t.items() if n >= least}
    for x in pw:
        p.update(s for s in _openings(x) if s in t)
    longer = Counter()  # the largest count of a form that is one byte longer, or ends the word
    for s, n in t.items():
        longer[s[:-1]] = max(longer[s[:-1]], n)
    ranked = []
    for s, n in t.items():
        if longer[s] >= 0.9 * n:
            continue
        odds = math.log((n / (len(tw) + 1)) / ((p[s] + 0.5) / (len(pw) + 1)))
        if odds > 2.5:
            ranked.append((n * odds * min(len(s), 8), s))
    ranked.sort(reverse=True)
    taken: list[bytes] = []
    size = 0
    for _, s in ranked:
        if size + len(s) > room or any(s.strip() in x for x in taken):
            continue
        taken.append(s)
        size += len(s)
    return b"".join(reversed(taken))


def _ordinary(plain: list[bytes], room: int) -> bytes:
    samples = [w for x in plain for w in windows(x)]
    try:
        trained = zstandard.train_dictionary(room, samples, dict_id=1).as_bytes()
        return trained[-room:]
    except zstandard.ZstdError:  # too few samples to train on
        return b"".join(samples)[-room:]


def train_pairs(toxic: list[bytes], plain: list[bytes]) -> list[tuple[bytes, bytes]]:
    """(toxic, ordinary) contents, each pair with ordinary text of its own."""
    out = []
    for i in range(PAIRS):
        ordinary = _ordinary(plain[i::PAIRS] or plain, ORDINARY_BYTES)
        if not out:
            telling = _telling(toxic, plain, min(TOXIC_BYTES, len(ordinary) // 2))
        # Of one length, so that zstandard picks the same parameters for both.
        out.append((telling + ordinary[len(telling) :], ordinary))
    return out


class Scorer:
    """Compression differences of a text; made on the executors from the trained bytes."""

    def __init__(self, pairs: list[tuple[bytes, bytes]]):
        def make(content):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self.pairs = [(make(a), make(b)) for a, b in pairs]

    def features(self, text: bytes | None) -> list[float]:
        w = windows(text or b"")
        every = np.array([[len(b(x)) - len(a(x)) for x in w] or [0] for a, b in self.pairs])
        mid, low = np.median(every, axis=0), every.min(axis=0)
        return [float(low.max()), float(mid.max()), math.log1p(np.clip(low, 0, None).sum()), math.log1p(np.clip(mid - 1, 0, None).sum()), math.log1p(len(w))]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Newton's method with a small ridge on standardised features, classes weighing the same."""
    mean, dev = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / dev, np.ones(len(x))])
    c = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (c * (p - y)) + 1e-2 * w
        h = (z * (c * p * (1 - p) + 1e-9)[:, None]).T @ z + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return mean, dev, w[:-1], float(w[-1])


_PART = "pmod(crc32(cast(cast(doc_id as string) as binary)), 5)"


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, longest: int = LONGEST_TRAINED) -> dict | None:
    """{'pairs': dictionaries, 'fit': calibration}, or None without enough labelled rows."""
    lab = pick(labels, "doc_id", "toxic").where(f"toxic is not null and {_PART} <> 0").distinct()
    n = {r.toxic: r.n for r in lab.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    limit = F.when(F.col("toxic") == 1, math.ceil(min(1.0, most / n[1]) * 1_000_000)).otherwise(math.ceil(min(1.0, most / n[0]) * 1_000_000))
    some = lab.where("toxic in (0, 1)").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < limit)
    if some.count() <= 4 * most:  # so many by construction; documents then stay where they are
        some = F.broadcast(some)
    texts = pick(docs, "doc_id", "text").where(F.octet_length("text") <= longest)
    rows = texts.join(some, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic", F.expr(f"{_PART} = 1").alias("last")).collect()
    got = {(c, last): sorted({r.text.encode() for r in rows if (r.toxic, r.last) == (c, last)}) for c in (0, 1) for last in (False, True)}
    if not all(got.values()):
        return None
    pairs = train_pairs(got[1, False], got[0, False])
    s = Scorer(pairs)
    x = np.array([s.features(t) for c in (0, 1) for t in got[c, True]])
    y = np.array([c for c in (0, 1) for _ in got[c, True]], float)
    return {"pairs": pairs, "fit": _logistic(x, y)}


def score_toxicity(docs: DataFrame, model: dict | None) -> DataFrame:
    """One row per row of docs: doc_id, score."""

    def of(batches):
        s = Scorer(model["pairs"]) if model else None
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            if s is None:
                p = np.zeros(len(texts))
            else:
                mean, dev, w, bias = model["fit"]
                x = np.array([s.features(t) for t in texts]).reshape(len(texts), -1)
                p = 1 / (1 + np.exp(-np.clip((x - mean) / dev @ w + bias, -30, 30))) if len(texts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(of, "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    s = score_toxicity(docs, train(docs, labels))
    held = F.expr("coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0, false)")
    return s.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
