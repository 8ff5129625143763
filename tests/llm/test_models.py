"""Quality, mixing and toxicity: held-out accuracy, brute force, odd rows."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from graphloom.llm import mixing, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_against_labels(spark, docs):
    got = quality.classify(docs).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good = [r.keep for r in got if r.quality == 1]
    bad = [r.keep for r in got if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_em_finds_the_accuracies():
    rng = random.Random(1)
    k = len(quality.LABELLERS)
    counts = {}
    for _ in range(20000):
        good = rng.random() < 0.8
        v = 0
        for j in range(k):
            if good:
                vote = quality.BAD if rng.random() < 0.01 else quality.GOOD if rng.random() < 0.5 else quality.NONE
            else:
                vote = quality.BAD if rng.random() < 0.3 + 0.05 * j else quality.NONE
            v = v * 3 + vote
        counts[v] = counts.get(v, 0) + 1
    _, tables, share = quality.em(counts)
    assert abs(share - 0.8) < 0.03
    for j in range(k):
        assert abs(tables[j, quality.BAD, quality.BAD] - (0.3 + 0.05 * j)) < 0.05


def test_quality_odd_rows(spark):
    d = spark.createDataFrame([(1, None, 2.0), (1, "", 2.0), (None, "Some words, in a sentence.", 1.0)], "doc_id long, text string, score double")
    assert quality.classify(d).count() == 3
    assert quality.classify(d.limit(0)).collect() == []


def test_rake_meets_the_targets():
    rng = random.Random(2)
    cells = [(s, g, t, rng.randrange(1, 50)) for s in "abc" for g in "xy" for t in "123" if rng.random() < 0.9]
    aims = [{"a": 0.5, "b": 0.3, "c": 0.2}, {"x": 0.6, "y": 0.4}, {"1": 0.2, "2": 0.2, "3": 0.6}]
    w = mixing.rake(cells, aims)
    for d, aim in enumerate(aims):
        for k, v in aim.items():
            assert abs(sum(x for c, x in zip(cells, w) if c[d] == k) - v) < 1e-6


def test_probabilities_meet_the_budget():
    tokens = np.array([100.0, 10.0, 1.0, 0.0])
    p = mixing.probabilities(tokens, np.array([0.2, 0.3, 0.5, 0.0]), 0.5)
    assert abs((tokens * p).sum() - 55.5) < 1e-6 and p.max() <= 1 and p[3] == 0


def test_mix_local_and_wide_agree(spark, docs):
    model = mixing.fit_topics(docs.select("doc_id", "text"))
    a = {r.doc_id: r for r in mixing.mix(docs).collect()}
    b = {r.doc_id: r for r in mixing.mix(docs, local_cells=0).collect()}
    assert a.keys() == b.keys()
    for k, r in a.items():
        assert abs(r.probability - b[k].probability) < 1e-4
        assert (r.topic, r.tokens) == mixing.topic_of(docs_text(docs)[k], model)
    tokens = sum(r.tokens for r in a.values())
    assert abs(sum(r.tokens for r in a.values() if r.sampled) / tokens - 0.5) < 0.1


_TEXTS = {}


def docs_text(docs):
    if not _TEXTS:
        _TEXTS.update((r.doc_id, r.text) for r in docs.collect())
    return _TEXTS


def chained(*parts):
    """Spark's hash of an int and longs; nulls are skipped."""
    h = 42
    for size, x in parts:
        if x is not None:
            h = xxhash.xxh64_intdigest((x & (1 << 8 * size) - 1).to_bytes(size, "little"), h)
    return h


def brute_mix(rows, model, share=0.5, temper=0.7, seed=17):
    """(doc_id, topic, tokens, probability, sampled) of rows (doc_id, text, source, lang), one cell and one key at a time."""
    made = [(d, t, s, g, *mixing.topic_of(t, model)) for d, t, s, g in rows]
    cells = {}
    for _, _, s, g, topic, n in made:
        cells[s, g, topic] = cells.get((s, g, topic), 0) + n
    total = sum(cells.values())
    w = {k: n / total for k, n in cells.items()}
    aims = []
    for d in range(3):
        sums = {}
        for k, n in cells.items():
            sums[k[d]] = sums.get(k[d], 0) + n
        raw = {k: n**temper if n else 0.0 for k, n in sums.items()}
        aims.append({k: v / sum(raw.values()) for k, v in raw.items()})
    for _ in range(200):
        for d in range(3):
            have = {}
            for k, v in w.items():
                have[k[d]] = have.get(k[d], 0.0) + v
            w = {k: v * aims[d][k[d]] / have[k[d]] if have[k[d]] else 0.0 for k, v in w.items()}
    gain = {k: w[k] * total / n if n else 0.0 for k, n in cells.items()}
    budget = min(share * total, sum(n for k, n in cells.items() if gain[k] > 0))
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(n * min(1.0, mid * gain[k]) for k, n in cells.items()) < budget else (lo, mid)
    out = []
    for d, t, s, g, topic, n in made:
        p = min(1.0, hi * gain[s, g, topic])
        th = xxhash.xxh64_intdigest((t or "").encode(), 42) if t is not None else 42
        u = chained((4, seed), (8, d), (8, th))
        u = (u - (1 << 64) if u >> 63 else u) % (1 << 53) / float(1 << 53)
        out.append((d, topic, n, p, u < p))
    return out


def same_mix(got, want):
    got, want = sorted(got, key=repr), sorted(want, key=repr)
    assert [(d, t, n) for d, t, n, *_ in got] == [(d, t, n) for d, t, n, *_ in want]
    for (*_, p, s), (*_, q, r) in zip(got, want, strict=True):
        assert abs(p - q) < 1e-6 and s == r


def test_query_mixing_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    vocab = {g: ["%s%d" % (g, i) for i in range(60)] for g in ("sport", "law", "food")}
    rows = [(1, None, None, "en"), (2, "", "s", None), (2, "", "s", None), (None, "sport1 law2", "s", "en"), (3, "food1 " * 50_000, "web", "fr")]
    for i in range(10, 250):
        g = rng.choice(list(vocab))
        rows.append((i, " ".join(rng.choices(vocab[g], k=rng.randrange(1, 80))), "web" if i % 3 else rng.choice(["book", None]), rng.choice(["en", "fr"])))
    d = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, source string, lang string, topic int, TOKENS string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    model = mixing.fit_topics(d.select("doc_id", "text"))
    got = mixing.op2_mixing(spark, str(tmp_path))
    same_mix([(r.doc_id, r.topic, r.tokens, r.probability, r.sampled) for r in got.collect()], brute_mix(rows, model))
    # Documents of one vocabulary share a topic, and others have another.
    mode = {g: [r.topic for r in got.collect() if r.tokens < 100 and any(x[0] == r.doc_id and (x[1] or "").startswith(g) for x in rows)] for g in vocab}
    tops = {g: max(set(v), key=v.count) for g, v in mode.items()}
    assert len(set(tops.values())) == 3


def brute_topics(texts, topics=mixing.TOPICS):
    """(weights of places, centres) of all texts, as dense rows."""
    words = sorted((mixing._words(t) for t in texts if t and t.split()), key=mixing.entries)
    x = np.array([mixing.vector(w) for w in words], float)
    idf = np.log((len(x) + 1) / ((x > 0).sum(axis=0) + 1)) + 0.01
    u = x * idf
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = [u[(u @ u.sum(axis=0)).argmin()]]
    while len(c) < topics:
        c.append(u[(u @ np.array(c).T).max(axis=1).argmin()])
    c = np.array(c)
    for _ in range(20):
        near = (u @ c.T).argmax(axis=1)
        c = np.array([u[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return idf, c


def test_topics_are_fitted_on_all_documents(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["%s%d" % ("abcdefgh"[i % 8], k) for k in range(40)], k=rng.randrange(5, 60))), "web", "en") for i in range(5000)]
    rows += [(5000, "one of its own kind", "web", "en"), (5001, "", "web", "en"), (5002, None, "web", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    model, want = mixing.fit_topics(d), brute_topics([r[1] for r in rows])
    assert np.allclose(model[0], want[0]) and model[1].shape == want[1].shape and np.abs(model[1] - want[1]).max() < 1e-5
    # However the rows are dealt out, the very same numbers come.
    again = mixing.fit_topics(d.repartition(7, "text"))
    assert (model[0] == again[0]).all() and (model[1] == again[1]).all()
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op2_mixing(spark, str(tmp_path)).collect()
    same_mix([(r.doc_id, r.topic, r.tokens, r.probability, r.sampled) for r in got], brute_mix(rows, want))


def test_words_are_held_for_one_text_at_a_time(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(300)) for i in range(1000)] + ["", None]
    batch, of = pa.array(texts), mixing.entries_udf().func
    tracemalloc.start()
    got = of(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6e6
    assert got.to_pylist() == [{"x": mixing.entries(w), "tokens": len(w)} for w in map(mixing._words, texts)]


def test_topics_of_few_directions_and_copies(spark):
    rows = [(1, "a"), (2, "a a"), (3, "b"), (4, "b"), (5, None), (6, " ")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = mixing.fit_topics(d)
    assert len(model[1]) == 2
    at = {i: mixing.topic_of(t, model) for i, t in rows}
    assert at[1][0] == at[2][0] != at[3][0] == at[4][0] and at[5] == at[6] == (0, 0)
    assert mixing.fit_topics(d.where("doc_id > 4")) is None


def test_mix_odd_rows(spark):
    d = spark.createDataFrame([(1, None, None, "en"), (2, "", "s", None), (2, "a b", "s", "en"), (None, "a b", "s", "en")], "doc_id long, text string, source string, lang string")
    got = mixing.mix(d).collect()
    assert len(got) == 4 and all(r.probability == 0 for r in got if not r.tokens)
    assert mixing.mix(d.limit(0)).collect() == []


def test_toxicity_finds_what_the_labels_teach(spark):
    rng = random.Random(3)
    plain = ["river", "mountain", "quietly", "follows", "garden", "table", "window", "reading", "letters", "between", "morning", "harvest"]
    rude = ["blockhead", "nitwit", "scoundrel"]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(plain) + rng.choice(["", "s", "ed", "ing"]) for _ in range(rng.randrange(20, 120))]
        bad = i % 3 == 0
        if bad:
            for _ in range(1 + len(w) // 20):
                w[rng.randrange(len(w))] = rng.choice(rude)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, lab)
    import zlib

    got = {r.doc_id: r.score for r in toxicity.score_toxicity(d, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 3 == 0) for i in held]) > 0.95


def test_toxicity_odd_rows(spark):
    d = spark.createDataFrame([(1, None), (1, ""), (None, "w " * 50000)], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.train(d, lab) is None
    assert [r.score for r in toxicity.score_toxicity(d, None).collect()] == [0.0, 0.0, 0.0]
    assert toxicity.score_toxicity(d.limit(0), None).collect() == []


@pytest.mark.parametrize("targets", [{"source": {"a": 0.7, "b": 0.3}}, {"lang": {"nowhere": 1.0}, "source": {"a": 0.2, "b": 0.8}}])
def test_mix_partial_targets_agree_local_and_wide(spark, targets):
    rows = [(i, " ".join(["w%d" % (i % 5)] * (1 + i % 7)), "ab"[i % 3 == 0], "xy"[i % 2]) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    a = {r.doc_id: r.probability for r in mixing.mix(d, targets=targets).collect()}
    b = {r.doc_id: r.probability for r in mixing.mix(d, targets=targets, local_cells=0).collect()}
    assert a.keys() == b.keys() and max(a.values()) > 0
    assert all(abs(p - b[k]) < 1e-9 for k, p in a.items())


def test_quality_sample_is_bounded_with_many_empty_texts(spark, monkeypatch):
    got = {}

    def fit(x, y, *a, n=None, **kw):
        got.update(rows=len(y), n=np.ones(len(y)) if n is None else n)
        return np.zeros(x.shape[1]), 0.0

    monkeypatch.setattr(quality, "fit_linear", fit)
    rows = [(i, "" if i % 3 == 0 else f"A sentence, number {i}, of words {i * 7919}.") for i in range(3000)]
    quality.train(spark.createDataFrame(rows, "doc_id long, text string"), most=300)
    assert got["rows"] <= 360 and abs(got["n"].sum() - 300) < 60
