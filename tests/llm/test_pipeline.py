"""The pipeline's rows against its stages written plainly, none of them through the library's own operators."""

import math
import random
import zlib

import pytest

import corpus_pipeline
from graphloom.llm import mixing, quality
from tests.llm.test_lines_decontam import LOWER, brute_hits
from tests.llm.test_models import brute_mix, brute_topics
from tests.llm.test_quality_brute import features_of, votes_of
from tests.llm.test_simhash import brute_groups

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train(docs)

    def good(text):
        _, b, rough = votes_of(text)
        return 1 / (1 + math.exp(-(float(features_of(b, rough) @ model["weights"]) + model["bias"]))) >= 0.5

    rows = {d: t for d, t in rows.items() if good(t)}
    holders = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for d, t in rows.items():
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(d)
    gone = {k: max(h) for k, h in holders.items() if len(h) >= 5}
    rows = {d: "\n".join(x for x in t.split("\n") if gone.get(key(x), d) == d) for d, t in rows.items()}
    rows = {d: rows[d] for d, _, c in brute_groups(list(rows.items())) if d == c}
    clean = {r[0] for r in brute_hits(list(rows.items()), items) if not r[5]}
    rows = {d: t for d, t in rows.items() if d in clean}
    meta = {r.doc_id: r for r in docs.collect()}
    left = [(d, t, meta[d].source, meta[d].lang) for d, t in rows.items()]
    topics = mixing.fit_topics(spark.createDataFrame(left, "doc_id long, text string, source string, lang string").select("doc_id", "text"))
    want = {d for d, _, _, _, sampled in brute_mix(left, topics) if sampled}
    got = {r.doc_id: r.text for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d: rows[d] for d in want}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, topic string, rid int, first int, FPS string"
ODD = [
    (1, None, None, None, None, "t", 1, 2, "x"),
    (2, "", "en", "web", 0, "t", 1, 2, "x"),
    (3, "A sentence of ordinary words, here. And another one follows it.", "en", "web", 60, "t", 1, 2, "x"),
    (3, "A sentence of ordinary words, here. And another one follows it.", "en", "web", 60, "t", 1, 2, "x"),
    (None, "Some other words that nobody else has written down before.", "en", None, 58, "t", 1, 2, "x"),
    (4, "long words " * 40_000, "fr", "web", 440_000, "t", 1, 2, "x"),
]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_other_columns(spark, name, stage):
    docs = spark.createDataFrame(ODD, SCHEMA)
    out = stage(spark, docs, SF)
    assert out.columns[:5] == COLUMNS and (name == "mixing" or out.columns == COLUMNS)
    have = {(r[0], r[1]) for r in ODD}
    assert {(r.doc_id, r.text) for r in out.collect()} <= have
    if name not in ("quality_classifier", "mixing"):
        assert {(r.doc_id, r.text) for r in out.collect()} >= {(r[0], r[1]) for r in ODD if r[0] in (None, 4) or r[1] and r[0] == 3}
    assert stage(spark, docs.limit(0), SF).collect() == []


def test_mixing_stage_fits_topics_on_all_documents(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choices(["%s%d" % ("abcdefgh"[i % 8], k) for k in range(40)], k=rng.randrange(5, 60))), "en", "web", 1) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_mix([(d, t, s, g) for d, t, g, s, _ in rows], brute_topics([r[1] for r in rows]))
    got = corpus_pipeline.mixing_stage(spark, docs, SF).collect()
    assert {r.doc_id: (r.topic, r.tokens) for r in got} == {d: (t, n) for d, t, n, _, sampled in want if sampled}


def test_mixing_stage_weighs_words_by_all_documents(spark, monkeypatch):
    models = []
    udf = mixing.topics_udf
    monkeypatch.setattr(mixing, "topics_udf", lambda model: models.append(model) or udf(model))
    texts = [f"all {'even' if i % 2 == 0 else 'odd'}" + " rare" * (i % 1000 == 0) for i in range(5000)]
    docs = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    corpus_pipeline.mixing_stage(spark, docs, SF).collect()
    weights = models[0][0]
    for word, held in {"all": 5000, "even": 2500, "odd": 2500, "rare": 5, "nowhere": 0}.items():
        assert weights[zlib.crc32(word.encode()) % mixing.WIDTH] == pytest.approx(math.log(5001 / (held + 1)) + 0.01, abs=1e-9)


def test_both_ways_of_leaving_out_agree(spark):
    from graphloom.llm import decontam, simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    ids = lambda f: sorted(r.doc_id for r in f.collect())
    kept = ids(simhash.keep_one(docs))
    assert kept == ids(simhash.keep_one(docs, near=0)) and len(kept) < docs.count()
    clean = ids(decontam.keep_clean(docs, items))
    assert clean == ids(decontam.keep_clean(docs, items, near=0)) and len(clean) < docs.count()
