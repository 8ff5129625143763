"""Secret spans against the patterns as Python runs them."""

import hashlib
import random
import re
import string

from graphloom.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def base(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(t) if len(m[0]) >= 32]
    return sorted(out)


def key(rows):
    return sorted(rows, key=repr)


RAND = "qZ8xK2vB9mW4tR7yL1pD6hJ3"
ROWS = [
    (1, None),
    (2, ""),
    (3, "password=short password : 'abcdefgh12' tail"),
    (4, "token=secret : abcdefghij and SECRET==abcdefghijk"),
    (5, "AKIA12 AKIAABCDEFGHIJKL AKIAAKIAAKIAAKIA"),
    (6, "x" + "0a" * 16 + "g" + "f" * 31 + " " + "e" * 40),
    (7, "\U0001f600é api_key:\"0123456789abcdef0123456789abcdef\" K apiKey=zzzzzzzzz"),
    (7, "\U0001f600é api_key:\"0123456789abcdef0123456789abcdef\" K apiKey=zzzzzzzzz"),
    (None, "passwd\" =\"12345678"),
    (8, "ordinary_identifier_of_some_length and " + RAND + " here"),
    (9, ("some plain words here token=abcdefgh\n" * 3000)),
    (10, "token=ab secret=abcdſpassword=ABCDEFGH"),
]


def test_base_and_added(spark):
    prose = [(100 + i, "the quick brown fox jumps over lazy dogs while reading configuration settings " * 4) for i in range(20)]
    d = spark.createDataFrame(ROWS + prose, "doc_id long, text string")
    got = secrets.find_secrets(d).collect()
    assert key((r.doc_id, [tuple(x) for x in r.base]) for r in got) == key((i, base(t)) for i, t in ROWS + prose)
    added = {r.doc_id: [ROWS[9][1][x.start : x.end] for x in r.added] for r in got if r.doc_id == 8}
    assert added == {8: [RAND]}
    for r in got:
        assert not (r.doc_id or 0) >= 100 or not r.added


def test_unseen_random_tokens_are_found(spark):
    """Of random tokens that no fixed pattern holds nearly all are found, and of ordinary identifiers none."""
    rng = random.Random(4)
    letters = string.ascii_letters + string.digits
    words = "reading the quick brown configuration settings while lazy foxes jump over many dogs and parse every message queue handler".split()
    rows, planted = [], {}
    for i in range(300):
        text = " ".join(rng.choices(words, k=30)) + " " + "_".join(rng.choices(words, k=5)) + " src/" + "/".join(rng.choices(words, k=4)) + " "
        if i % 3 == 0:
            planted[i] = "".join(rng.choices(letters, k=rng.randrange(20, 44)))
            text += planted[i] + " "
        rows.append((i, text + " ".join(rng.choices(words, k=10))))
    got = {r.doc_id: [rows[r.doc_id][1][x.start : x.end] for x in r.added] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == [x] for i, x in planted.items()) >= 0.95 * len(planted)
    assert not any(got[i] for i in got if i not in planted)


def test_chunks_of_matches(spark):
    n = 3 * secrets.CHUNK + 5
    text = "".join(f"é token=abcdefg{i:05d}\n" for i in range(n))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = {"table": [0.0] * (len(secrets.ALPHABET) + 1) ** 2, "threshold": float("inf")}
    assert [tuple(x) for x in secrets.find_secrets(d, model).first().base] == base(text)


def test_empty_and_clashing(spark):
    d = spark.createDataFrame([], "doc_id long, text string, base int, rid int, Body string")
    assert secrets.find_secrets(d).collect() == []
    d = spark.createDataFrame([(1, "token=abcdefgh", 1, 2, "x")], "doc_id long, text string, base int, rid int, Body string")
    r = secrets.find_secrets(d).first()
    assert [tuple(x) for x in r.base] == [(0, 0, 14)] and r.doc_id == 1


def test_query_digest(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in secrets.op5_secrets(spark, str(tmp_path)).collect():
        want = [base(t) for i, t in ROWS if i == r.doc_id][0]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
