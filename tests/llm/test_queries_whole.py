"""op3, op4 and op6 called as queries: every column against a version written plainly, on odd rows too."""

import hashlib
import random
import re
import time
import zlib

import numpy as np

from graphloom.llm import embeddings, pii, toxicity
from tests.llm.test_pii_pages_embeddings import brute_groups


def test_embeddings_query_and_exact_pass(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = []
    for label in (0, 1, 2):
        for _ in range(8):
            centre = rng.normal(size=12)
            rows += [(len(rows), [float(x) for x in centre + rng.normal(size=12) * 0.2], label) for _ in range(rng.choice([1, 4, 9]))]
    rows = [(i, v, label) for i, (_, v, label) in enumerate(rows)] + [(700, [1.0] * 12, None), (701, None, 2), (None, rows[0][1], 0)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, digest string, ID int")
    d.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = embeddings.op3_embeddings(spark, str(tmp_path))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept", "recall"]
    want = brute_groups(rows)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()), key=repr) == want
    assert {r.recall for r in got.collect()} <= {1.0, None}
    assert [r.recall for r in got.collect() if r.vec_id in (700, 701)] == [None, None]
    # A goal out of reach ends in the pass without the graph, which misses nothing.
    exact = embeddings.embedding_groups(d, shard=6, probes=1, beam=1, goal=2.0)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in exact.collect()), key=repr) == want


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def base(t):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        s = re.sub("[^0-9]", "", m[0])
        if 12 <= len(s) <= 19 and luhn(s) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    order = ("email", "ip", "card", "phone")
    return sorted(out, key=lambda x: (x[1], order.index(x[0])))


def text_of(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_pii_query_finds_what_contexts_show(spark, tmp_path):
    rng = random.Random(11)
    words = "the order was sent today and we will answer soon about delivery of your parcel".split()
    fill = lambda n: " ".join(rng.choices(words, k=n))
    rows, unseen = [], {}
    for i in range(120):
        phone = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        mail = f"{rng.choice(words)}.{i}@mail{i % 7}.example.com"
        kind = i % 4
        if kind == 0:
            t = f"{fill(6)} please call {phone} {fill(4)}"
        elif kind == 1:
            t = f"{fill(6)}\nwrite to {mail}, {fill(4)}"
        elif kind == 2:  # identifiers that no fixed pattern knows, in contexts that the others induce
            new = f"ext-{rng.randrange(10**6, 10**7)}"
            t = f"{fill(5)} please call {new} {fill(3)}"
            unseen[i] = ("phone", t.index(new), t.index(new) + len(new))
        else:
            t = f"{fill(5)} item no. A{rng.randrange(10**6, 10**7)} {fill(3)}"  # looks like one, in a context of its own
        rows.append((i, t))
    odd = [(None, None), (500, ""), (501, "1.2.3." + "0" * 5000), (502, "a" * 200_000 + " 1 write to x@y.zz"), (503, "ip 1.2.3.4, card 4111 1111 1111 1111; é 4111111111111112"), (503, "ip 1.2.3.4, card 4111 1111 1111 1111; é 4111111111111112"), (504, "+1" + "(" * 50_000 + "2"), (505, "1a" * 50_000)]
    spark.createDataFrame([(*r, 3, "k") for r in rows + odd], "doc_id long, text string, rid int, Kind string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = pii.op4_pii(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    want, order = [], ("email", "ip", "card", "phone")
    for i, t in rows + odd:
        b = base(t or "")
        added = [unseen[i]] if i in unseen else []
        spans = sorted(b + added, key=lambda x: (x[1], order.index(x[0])))
        want.append((i, *(sum(k == x for k, _, _ in b) for x in order), hashlib.sha256(text_of(b).encode()).hexdigest(), text_of(spans), len(added)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert time.time() - began < 120


def test_toxicity_query(spark, tmp_path):
    rng = random.Random(3)
    plain = ["river", "mountain", "quietly", "follows", "garden", "table", "window", "reading", "letters", "between", "morning", "harvest"]
    rude = ["blockhead", "nitwit", "scoundrel"]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(plain) + rng.choice(["", "s", "ed", "ing"]) for _ in range(rng.randrange(20, 120))]
        if i % 3 == 0:
            for _ in range(2 + len(w) // 20):
                w[rng.randrange(len(w))] = rng.choice(rude)
        rows.append((i, " ".join(w), "en", "web", 9))
        labels.append((i, int(i % 3 == 0)))
    odd = [(1000, None, None, None, 1), (1001, "", "en", "web", 1), (None, "You nitwit", "en", "web", 1), (1002, "river garden " * 60_000, "en", "web", 1), (0, rows[0][1], "fr", "book", 1)]
    spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, TOXIC int").write.parquet(f"{tmp_path}/documents.parquet")
    lab = spark.createDataFrame([*labels, (1000, None), (None, 1), (1, 0), (1, 0)], "doc_id long, toxic int")
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op6_toxicity(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    out = got.collect()
    assert len(out) == len(rows) + len(odd)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    by = {r.doc_id: r for r in out}
    held = [i for i, *_ in rows if by[i].held_out]
    assert np.mean([by[i].predicted == int(i % 3 == 0) for i in held]) > 0.95
    assert by[1000].score == by[1001].score and by[1002].predicted == 0
    assert len({r.score for r in out if r.doc_id == 0}) == 1  # equal texts score alike, whatever language and source
    # Held-out labels are never read: with all of them turned round the scores stay.
    turned = spark.createDataFrame([(i, 1 - t if by[i].held_out else t) for i, t in labels], "doc_id long, toxic int")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    again = {(r.doc_id, r.score) for r in toxicity.score_toxicity(docs, toxicity.train(docs, turned)).collect()}
    assert again == {(r.doc_id, r.score) for r in out}
    assert toxicity.train(docs.limit(0), lab) is None and toxicity.train(docs, lab.limit(0)) is None
