"""The quality classifier against its definition written plainly, a document and a character at a time."""

import math
import random
import zlib

import numpy as np

from graphloom.llm import quality

BLANK = b" \t\n\r\x0b\x0c"


def rows():
    rng = random.Random(6)
    words = ["river", "stone", "walks", "early", "paper", "green", "Quiet", "letters", "of", "the"]
    out = [(1, None), (1, None), (2, ""), (3, "One short line, here."), (None, "A sentence of words. Another one, too."), (4, "word " * 30_000), (5, "É à ü: ça va. " * 5)]
    for i in range(10, 160):
        n = rng.randrange(5, 60)
        kind = i % 5
        w = [rng.choice(words) for _ in range(n)]
        if kind == 0:
            w = [x + rng.choice(["$$$", "###", "%%%"]) for x in w]
        elif kind == 1:
            w = [x.upper() for x in w]
        else:
            w = [x + rng.choice(["", "", ",", "."]) for x in w]
        out.append((i, " ".join(w)))
    return out


def share(a, b):
    return a / b if b else 0.0


def votes_of(text):
    b = (text or "").encode()
    w, size = b.split(), len(b)
    symbols = share(sum(c in b"!#$%&*|~^<>{}[]=_\\@" for c in b), size)
    up, low = sum(65 <= c <= 90 for c in b), sum(97 <= c <= 122 for c in b)
    upper, n = share(up, up + low), len(w)
    repeat = share(sum(w[i] == w[i - 1] for i in range(1, n)), n)
    distinct, pipes = share(len(set(w)), n), share(b.count(b"|"), n)
    digits, long, stops = share(sum(48 <= c <= 57 for c in b), size), share(size - n, n), share(sum(c in b".,;:?" for c in b), n)
    ls = [x for x in b.split(b"\n") if len(x) >= 20]
    lines = share(len(set(ls)), len(ls)) if ls else 1.0
    B, G, N = quality.BAD, quality.GOOD, quality.NONE
    v = [
        B if symbols > 0.06 else N, B if upper > 0.5 and n >= 5 else N, B if repeat > 0.3 and n >= 8 else N, B if distinct < 0.3 and 20 <= n <= 2000 else N,
        B if pipes > 0.25 and n >= 8 else N, B if digits > 0.4 else N, B if lines < 0.4 else N,
        G if symbols < 0.02 and upper < 0.25 and repeat < 0.1 and 2 <= long <= 14 else N, G if 0.03 <= stops <= 0.6 and symbols < 0.03 else N,
    ]
    rough = {"repeat": repeat, "distinct": distinct, "pipes": pipes, "symbols": symbols, "upper": upper, "lines": lines}
    return v, b, rough


def posteriors(all_votes):
    """Expectation-maximisation over documents, one by one."""
    k, share_good = len(all_votes[0]), 0.8
    t = [[[0.3, 0.02, 0.68], [0.01, 0.5, 0.49]] for _ in range(k)]
    for _ in range(100):
        post = []
        for v in all_votes:
            p = [(1 - share_good) * math.prod(t[j][0][v[j]] for j in range(k)), share_good * math.prod(t[j][1][v[j]] for j in range(k))]
            post.append(p[1] / sum(p))
        new = [[[0.05] * 3, [0.05 + (c == quality.BAD) * 0.01 for c in range(3)]] for _ in range(k)]
        for v, p in zip(all_votes, post, strict=True):
            for j in range(k):
                new[j][0][v[j]] += 1 - p
                new[j][1][v[j]] += p
        new = [[[x / sum(r) for x in r] for r in pair] for pair in new]
        share_good = min(max(sum(post) / len(post), 1e-3), 1 - 1e-3)
        done = max(abs(a - b) for x, y in zip(new, t, strict=True) for r, s in zip(x, y, strict=True) for a, b in zip(r, s, strict=True)) < 1e-9
        t = new
        if done:
            break
    return post


def features_of(b, rough):
    x = np.zeros(quality.BUCKETS)
    outline = bytearray()
    for c in b:
        if c in BLANK:
            outline.append(32)
        elif 48 <= c <= 57:
            outline.append(57)
        elif 65 <= c <= 90:
            outline.append(65)
        elif not (97 <= c <= 122 or c >= 128):
            outline.append(c)
    for i in range(len(outline) - 1):
        x[(outline[i] * 2654435761 + outline[i + 1] * 40503 >> 3) % quality.BUCKETS] += 1 / (len(outline) - 1)
    for name, v in rough.items():
        x[zlib.crc32(f"{name}:{min(9, int(v * 10))}".encode()) % quality.BUCKETS] += 1
    return x


def test_query_against_brute_force(spark, tmp_path):
    data = rows()
    d = spark.createDataFrame([(*r, 0.5, "k") for r in data], "doc_id long, text string, score double, Keep string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = quality.op9_quality(spark, str(tmp_path))
    assert got.columns == ["doc_id", "score", "weak", "keep"]
    model = quality.train(d)
    made = [votes_of(t) for _, t in data]
    weak = posteriors([v for v, _, _ in made])
    want = []
    for (i, _), (_, b, rough), p in zip(data, made, weak, strict=True):
        s = 1 / (1 + math.exp(-(float(features_of(b, rough) @ model["weights"]) + model["bias"])))
        want.append((i, s, p, s >= 0.5))
    have = sorted(((r.doc_id, r.score, r.weak, r.keep) for r in got.collect()), key=lambda r: (str(r[0]), r[1]))
    want.sort(key=lambda r: (str(r[0]), r[1]))
    assert [(r[0], r[3]) for r in have] == [(r[0], r[3]) for r in want]
    for a, b in zip(have, want, strict=True):
        assert abs(a[1] - b[1]) < 1e-4 and abs(a[2] - b[2]) < 1e-6


def test_fit_reaches_the_least_loss():
    rng = np.random.default_rng(2)
    x = rng.random((300, 12)).astype(np.float32)
    y = 1 / (1 + np.exp(-(x @ rng.normal(size=12) * 2)))
    w, b = quality.fit_linear(x, y)
    weight = y / y.sum() + (1 - y) / (1 - y).sum()
    weight /= weight.sum()

    def loss(w, b):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + 0.5e-5 * (w * w).sum()

    v, c = np.zeros(12), 0.0
    for _ in range(20_000):
        g = weight * (1 / (1 + np.exp(-(x @ v + c))) - y)
        v, c = v - 2.0 * (x.T @ g + 1e-5 * v), c - 2.0 * g.sum()
    assert loss(w, b) < loss(v, c) + 1e-3
