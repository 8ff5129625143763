"""SimHash groups against a brute-force version."""

import random

import numpy as np
import pytest
import xxhash

from graphloom.llm import simhash

DOCS = "doc_id long, text string"


def brute_fp(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in t + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, bits=4):
    fp = [brute_fp(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= bits:
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, f"{fp[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows, **kw):
    from pyspark.sql import functions as F

    got = simhash.simhash_groups(spark.createDataFrame(rows, DOCS), **kw)
    got = got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id")
    return sorted(map(tuple, got.collect()), key=str)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c d e"), (5, "A B c D e"), (5, "a b c d e"), (6, "xÉ  y"), (7, "one"), (8, "w " * 70000)]
    assert run(spark, rows) == brute_groups(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", 3, 4, "x")], "doc_id long, text string, fp long, root long, TEXT2 string")
    assert simhash.simhash_groups(d).columns == ["doc_id", "fp", "component_id"]


def test_near_copies(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    rows = []
    for g in range(12):
        base = rng.choices(vocab, k=rng.choice([5, 40, 400]))
        for _ in range(rng.choice([1, 6, 15])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    assert run(spark, rows, block=8) == brute_groups(rows)
    assert run(spark, rows) == brute_groups(rows)


@pytest.mark.parametrize("seed", range(4))
def test_trie_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    keys = [int(c) for c in centres]
    for c in centres:
        for _ in range(20):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            keys.append(x)
    k = np.unique(np.array(keys, dtype=np.uint64))

    def classes(pairs):
        up = {int(x): int(x) for x in k}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[root(int(a))] = root(int(b))
        out = {}
        for x in up:
            out.setdefault(root(x), set()).add(x)
        return sorted(map(sorted, out.values()))

    want = classes([(a, b) for a in k for b in k if a < b and int(a ^ b).bit_count() <= 4])

    def every_way(x, y=None):
        out = []
        for at, size in simhash.parts_of(4):
            got = simhash.trie_links(simhash.turn(x, at), None if y is None else simhash.turn(y, at), size, 4)
            out += zip(*(simhash.turn(g, 64 - at) for g in got))
        return out

    assert classes(every_way(k)) == want
    # Two halves against each other and each with itself.
    x, y = k[::2], k[1::2]
    assert classes(every_way(x, y) + every_way(x) + every_way(y)) == want
    # No part has to agree.
    assert classes(zip(*simhash.trie_links(k, None, 0, 4))) == want
