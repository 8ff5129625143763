"""Quality classifier by weak labels.

Overlapping heuristic labellers vote bad, good or nothing on every text.  The
votes' patterns are counted over all documents (their number is bounded by
three to the number of labellers, whatever the corpus), and expectation-
maximisation over those counts estimates how often each labeller casts each
vote in either class.  The patterns' posteriors are the labels for a logistic
scorer on hashed features, which is trained on about TRAIN_DOCS documents
picked by a hash of id and text and then scores every document.  Picked
documents with equal features are one row with a weight, so copies and empty
texts take the share in the fit that they have in the table, and no more room.

Defined results: a null or empty text is scored like any other (all labellers
abstain, its features are empty); very long texts are measured whole; equal
texts score alike, ids only take part in which documents are picked; rows that
repeat an id are rows of their own, a null doc_id is kept; a score equal to the
threshold keeps its document; an empty table gives an empty result; other
columns are not looked at, and no label column is an input.
"""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pick, release, table

TRAIN_DOCS = 12_000
BUCKETS = 512
EM_ROUNDS = 100
EPOCHS = 400
SALT = 29

_SYMBOLS = b"!#$%&*|~^<>{}[]=_\\@"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_SHAPE = bytes(32 if c in b" \t\n\r\x0b\x0c" else 57 if 48 <= c <= 57 else 65 if 65 <= c <= 90 else c for c in range(256))
_PLAIN = _LOWER + bytes(range(128, 256))
BAD, GOOD, NONE = 0, 1, 2


def _share(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


def _measures(b: bytes) -> dict[str, float]:
    words = b.split()
    n, size = len(words), len(b)
    count = lambda chars: size - len(b.translate(None, chars))
    upper, lower = count(_UPPER), count(_LOWER)
    lines = [x for x in b.split(b"\n") if len(x) >= 20]
    return {
        "n": n,
        "symbols": _share(count(_SYMBOLS), size),
        "upper": _share(upper, upper + lower),
        "repeat": _share(sum(map(eq, words, words[1:])), n),
        "distinct": _share(len(set(words)), n),
        "pipes": _share(b.count(b"|"), n),
        "digits": _share(count(b"0123456789"), size),
        "word": _share(size - n, n),
        "stops": _share(count(b".,;:?"), n),
        "lines": _share(len(set(lines)), len(lines)) if lines else 1.0,
    }


#: Each labeller: a vote from the measures of a text.  Most only speak up against.
LABELLERS = {
    "symbols": lambda m: BAD if m["symbols"] > 0.06 else NONE,
    "shouting": lambda m: BAD if m["upper"] > 0.5 and m["n"] >= 5 else NONE,
    "echo": lambda m: BAD if m["repeat"] > 0.3 and m["n"] >= 8 else NONE,
    "monotone": lambda m: BAD if m["distinct"] < 0.3 and m["n"] <= 2000 and m["n"] >= 20 else NONE,
    "table": lambda m: BAD if m["pipes"] > 0.25 and m["n"] >= 8 else NONE,
    "numbers": lambda m: BAD if m["digits"] > 0.4 else NONE,
    "same_lines": lambda m: BAD if m["lines"] < 0.4 else NONE,
    "prose": lambda m: GOOD if m["symbols"] < 0.02 and m["upper"] < 0.25 and m["repeat"] < 0.1 and 2 <= m["word"] <= 14 else NONE,
    "sentences": lambda m: GOOD if 0.03 <= m["stops"] <= 0.6 and m["symbols"] < 0.03 else NONE,
}


def votes(m: dict[str, float]) -> int:
    """The labellers' votes as digits of base three."""
    out = 0
    for f in LABELLERS.values():
        out = out * 3 + f(m)
    return out


def features(b: bytes, m: dict[str, float], buckets: int = BUCKETS) -> np.ndarray:
    """Hashed shares of pairs in the text's outline (its case, digits, marks and gaps) and of rough measures."""
    x = np.zeros(buckets, np.float32)
    outline = np.frombuffer(b.translate(_SHAPE, _PLAIN), np.uint8).astype(np.int64)
    if len(outline) > 1:
        pair = (outline[:-1] * 2654435761 + outline[1:] * 40503) >> 3
        x += np.bincount(pair % buckets, minlength=buckets).astype(np.float32) / (len(outline) - 1)
    for name in ("repeat", "distinct", "pipes", "symbols", "upper", "lines"):
        x[zlib.crc32(f"{name}:{min(9, int(m[name] * 10))}".encode()) % buckets] += 1
    return x


def em(counts: dict[int, int], rounds: int = EM_ROUNDS) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior of good by pattern, the vote tables [labeller, class, vote], and the share of good."""
    k = len(LABELLERS)
    if not counts:
        return {}, np.full((k, 2, 3), 1 / 3), 0.5
    keys = sorted(counts)
    v = np.array([[key // 3 ** (k - 1 - j) % 3 for j in range(k)] for key in keys])
    w = np.array([counts[key] for key in keys], float)
    onehot = np.eye(3)[v]
    # To begin with: labellers are seldom wrong, and speak up now and then.
    t = np.empty((k, 2, 3))
    t[:, BAD] = (0.3, 0.02, 0.68)
    t[:, GOOD] = (0.01, 0.5, 0.49)
    share = 0.8
    for _ in range(rounds):
        logs = np.einsum("pjv,jcv->pc", onehot, np.log(t)) + np.log([1 - share, share])
        logs -= logs.max(axis=1, keepdims=True)
        post = np.exp(logs)
        post /= post.sum(axis=1, keepdims=True)
        weight = post * w[:, None]
        new = np.einsum("pc,pjv->jcv", weight, onehot) + np.array([0.05, 0.05, 0.05])
        # A prior worth a few documents keeps classes from swapping when one of them is empty.
        new[:, GOOD, BAD] += 0.01
        new /= new.sum(axis=2, keepdims=True)
        share = float(np.clip(weight[:, GOOD].sum() / w.sum(), 1e-3, 1 - 1e-3))
        if np.abs(new - t).max() < 1e-9:
            t = new
            break
        t = new
    return dict(zip(keys, post[:, GOOD].tolist(), strict=True)), t, share


def fit_linear(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, n: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, both classes weighing the same; n: how many documents each row stands for."""
    if not len(y):
        return np.zeros(BUCKETS), 1.0
    n = np.ones(len(y)) if n is None else n
    good = max(float((n * y).sum()), 1e-6)
    bad = max(float((n * (1 - y)).sum()), 1e-6)
    if min(good, bad) < 0.5:
        return np.zeros(x.shape[1]), 4.0 if good > bad else -4.0
    weight = n * (y / good + (1 - y) / bad)
    weight /= weight.sum()
    w, b = np.zeros(x.shape[1]), 0.0
    mean, sq = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for i in range(1, epochs + 1):
        # Products in the features' own precision: a wider factor would copy all of x each time.
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype) + b, -30, 30)))
        d = weight * (p - y)
        g = np.append(d.astype(x.dtype) @ x + 1e-5 * w, d.sum())
        mean = 0.9 * mean + 0.1 * g
        sq = 0.99 * sq + 0.01 * g * g
        step = 0.2 * (mean / (1 - 0.9**i)) / (np.sqrt(sq / (1 - 0.99**i)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _surveyed(docs: DataFrame, rate: float) -> DataFrame:
    """(votes, n, x): documents counted by votes in each batch; x has the features of those that a hash picks."""
    limit = int(rate * 2**32)
    h = F.pmod(F.xxhash64(F.lit(SALT), "doc_id", "text"), F.lit(1 << 32)).alias("h")

    def of(batches):
        for batch in batches:
            seen = Counter()
            for b, h in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("h").to_pylist(), strict=True):
                b = b or b""
                m = _measures(b)
                seen[votes(m), features(b, m).tobytes() if h < limit else None] += 1
            v, x = zip(*seen, strict=True) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(seen.values(), pa.int64()), pa.array(x, pa.binary())], ["votes", "n", "x"])

    return pick(docs, "doc_id", "text").select("text", h).mapInArrow(of, "votes long, n long, x binary")


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> dict:
    """The model: linear weights, and the posteriors by pattern of votes."""
    n = docs.count()
    seen = cut(_surveyed(docs, min(1.0, most / max(1, n))))
    counts = {r.votes: r.n for r in seen.groupBy("votes").agg(F.sum("n").alias("n")).collect()}
    posterior, tables, share = em(counts)
    got = sorted((bytes(r.x), r.votes, r.n) for r in seen.where("x is not null").groupBy("votes", "x").agg(F.sum("n").alias("n")).collect())
    release(seen)
    x = np.frombuffer(b"".join(r[0] for r in got), np.float32).reshape(-1, BUCKETS)
    y = np.array([posterior[r[1]] for r in got])
    w, b = fit_linear(x, y, n=np.array([r[2] for r in got], float))
    return {"weights": w, "bias": b, "posterior": posterior, "accuracy": tables, "share": share}


def scorer(model: dict):
    """A pandas UDF: text to struct(score, weak)."""
    w, bias, posterior = model["weights"], model["bias"], model["posterior"]

    @F.pandas_udf("score double, weak double")
    def score(texts: pd.Series) -> pd.DataFrame:
        out = np.empty((len(texts), 2))
        for i, t in enumerate(texts):
            b = t.encode() if isinstance(t, str) else b""
            m = _measures(b)
            out[i] = 1 / (1 + np.exp(-np.clip(features(b, m) @ w + bias, -30, 30))), posterior.get(votes(m), 0.5)
        return pd.DataFrame(out, columns=["score", "weak"])

    return score


def classify(docs: DataFrame, model: dict | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, score (1: good), weak (the votes' posterior), keep."""
    d = pick(docs, "doc_id", "text")
    model = model or train(d)
    s = d.select("doc_id", scorer(model)("text").alias("s"))
    return s.select("doc_id", "s.score", "s.weak", (F.col("s.score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, model: dict | None = None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score at least threshold, with doc_id, text, lang, source and n_chars only."""
    d = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    model = model or train(d)
    return d.where(scorer(model)("text")["score"] >= threshold)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
