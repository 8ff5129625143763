"""Line dedup and decontamination against brute force, with the odd rows."""

import hashlib
import random
import re

from graphloom.llm import decontam, lines

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows):
    holders = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            k = x.strip(BLANKS).translate(LOWER)
            if len(k) >= 40 and d is not None:
                holders.setdefault(k, set()).add(d)
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        kept = []
        for x in ls:
            h = holders.get(x.strip(BLANKS).translate(LOWER), ())
            if not (len(h) >= 5 and d != max(h)):
                kept.append(x)
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def documents(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")


def test_lines(spark, tmp_path):
    rng = random.Random(1)
    common = ["The Licence of this text is granted to all who read it, É" + str(i) for i in range(6)]
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, common[0]), (4, common[0] + "\n" + common[0].lower()), (4, "x\n" + common[1])]
    for i in range(10, 40):
        body = [rng.choice([*common, "\t" + common[2] + " \r", "short", "a line of its own that is long enough, number %d" % i]) for _ in range(rng.randrange(1, 9))]
        rows.append((i, "\n".join(body)))
    rows.append((99, "\n".join(common * 400)))
    documents(spark, rows, tmp_path)
    got = lines.op10_line_dedup(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got), key=repr) == brute_lines(rows)
    for r in got:
        runs = [int(x) for x in r.keep_bitmap.split(",")]
        assert len(runs) % 2 and sum(runs[::2]) == r.n_lines - r.n_dropped
    # The bitmap says the same without the text, and so does the way for more frequent lines than a table holds.
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda **kw: sorted(map(repr, lines.line_dedup(docs, with_text=True, **kw).collect()))
    assert key() == key(near=0)
    one = lines.line_dedup(docs, min_docs=1000).collect()
    assert all(list(r.keep_bitmap) == [r.n_lines] for r in one)
    for r in lines.line_dedup(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect():
        assert sum(r.keep_bitmap) == r.n_lines and sum(r.keep_bitmap[1::2]) == r.n_dropped
    cut = lines.cut_lines(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"))
    want = {(d, h) for d, _, _, h in brute_lines(rows)}
    far = lines.cut_lines(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), near=0)
    assert sorted(map(repr, far.collect())) == sorted(map(repr, cut.collect()))
    assert {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in cut.collect()} == want


def test_lines_empty_and_clashing(spark):
    d = spark.createDataFrame([], "doc_id long, text string, body string, pos int, H1 long")
    assert lines.line_dedup(d).collect() == [] and lines.line_dedup(d, near=0).collect() == []
    d = spark.createDataFrame([(1, "a\nb", "x", 1, 2)], "doc_id long, text string, body string, p int, H1 long")
    assert [tuple(r)[:3] for r in lines.line_dedup(d).collect()] == [(1, 2, 0)]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items):
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for i, x in items:
            b = words(x)
            m = min(10, len(b))
            if not m:
                continue
            grams = {tuple(b[j : j + m]) for j in range(len(b) - m + 1)}
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in grams:
                    hit |= set(range(j, j + m))
                    found.add(i)
        names = ",".join(sorted(str(i) for i in found if i is not None))  # an item without an id is one that has no name
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def hits(spark, docs, items, path):
    documents(spark, docs, path)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return sorted((tuple(r) for r in decontam.op8_decontaminate(spark, str(path)).collect()), key=repr)


def test_hits(spark, tmp_path):
    rng = random.Random(2)
    vocab = ["w%d" % i for i in range(12)] + ["É", "é", "Ab"]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, text(rng.choice([10, 12, 30]))) for i in range(12)] + [(20, "w1 w2, w3"), (21, "w5"), (22, "..."), (23, None), (24, items_dup := text(15)), (25, items_dup), (100, "a a a a a a a a a a a a"), (None, items_none := text(11)), (None, "w7 w7 w8")]
    docs = [(1, None), (2, ""), (None, items[0][1]), (3, "a " * 25), (4, "x" + items[1][1]), (5, items[3][1].upper() + "! tail " + items[4][1])]
    for i in range(10, 40):
        j = rng.choice(items[:12])[1].split()
        a = rng.randrange(len(j))
        docs.append((i, text(rng.randrange(30)) + " " + " ".join(j[a : a + rng.randrange(4, 14)]) + "-" + text(5)))
    docs += [(50, " ".join(x for _, x in items if x) * 20), (51, f"so {items_none} there"), (52, "W7 w7 w8"), (None, None), (53, "w5 " * 70_000)]
    assert hits(spark, docs, items, tmp_path) == brute_hits(docs, items)


def test_hits_empty_and_clashing(spark):
    b = spark.createDataFrame([(1, "one two three", 5, "x")], "item_id long, text string, m int, Words string")
    d = spark.createDataFrame([], "doc_id long, text string, rid int, fps int, H long")
    assert decontam.decontaminate(d, b).collect() == []
    d = spark.createDataFrame([(1, "so one, two three", 2, 3, 4)], "doc_id long, text string, rid int, fps int, H long")
    r = decontam.decontaminate(d, b).first()
    assert (r.doc_id, r.n_words, r.n_hit, [tuple(x) for x in r.spans]) == (1, 4, 3, [(1, 4)])


def test_no_items(spark, tmp_path):
    docs = [(1, "some words"), (2, None)]
    assert hits(spark, docs, [], tmp_path) == brute_hits(docs, [])


def test_blocks(spark):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choices("abcdefghij", k=14))) for i in range(10)]
    docs = [(i, " ".join(rng.choices("abcdefghij", k=6)) + " " + items[i % 10][1]) for i in range(20)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    key = lambda f: sorted((r.doc_id, r.n_words, r.n_hit, sorted(x.item_id for x in r["items"])) for r in f.collect())
    whole = key(decontam.decontaminate(d, b))
    assert [(i, n) for i, _, n, _ in whole] == [(i, n) for i, _, n, *_ in sorted(brute_hits(docs, items))]
    for block, near in ((7, 100), (7, 0), (1000, 0)):
        assert key(decontam.decontaminate(d, b, block=block, near=near)) == whole
