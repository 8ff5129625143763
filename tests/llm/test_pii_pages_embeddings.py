"""PII spans against the patterns, HTML fixtures, embeddings against brute force."""

import random
import re

import numpy as np
import pytest

from graphloom.llm import embeddings, pages, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19:
            v = [int(c) for c in reversed(d)]
            if (sum(v[::2]) + sum(sum(divmod(2 * x, 10)) for x in v[1::2])) % 10 == 0:
                out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


@pytest.mark.parametrize("seed", range(300))
def test_base_spans(seed):
    rng = random.Random(seed)
    t = "".join(rng.choices("@@..++0123456789  -()aB_%é\n", k=rng.randrange(60)))
    t += rng.choice(["", " a.b@c.d@e.f.g", " 4111 1111 1111 1111", " 1.2.3.4.5.6.7.8 300.1.1.1", " +1 (555) 010-9999"])
    assert pii.base_spans(t) == brute(t)


def test_long_runs_stay_linear():
    assert pii.base_spans("a" * 300_000 + "@" + "1" * 300_000 + "." * 1000) == []


def test_bootstrapping(spark):
    rows = [(i, f"noise before. contact mail user{i}@host.org and more") for i in range(20)]
    rows += [(100, "please contact mail someone42(at)host now"), (101, "order number part77x99 shipped"), (102, None), (102, ""), (None, "x")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[100].added] == [(20, 0, 37)]
    assert got[101].added == [] and got[102].base == []
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string, base int")).collect() == []


HTML = [
    ("<p>one<p>two<br>three", "one\n\ntwo\nthree"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
    ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
    ("<table><tr><th>Name<th>Q<tr><td>long name<td>1</table>", "Name      | Q\nlong name | 1"),
    ("a<script>x<y</script><style>p{}</style><!-- no -->b", "ab"),
    ("<div hidden>no</div><span style='color:red; display: none'>no</span>yes", "yes"),
    ("<div style='visibility:hidden'><p>no</div>yes", "yes"),
    ("<head><title>t</title></head><body>x  \n y</body>", "x y"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
    ("5 < 6 &amp; 7 &gt; 2", "5 < 6 & 7 > 2"),
    ("<img alt=pic> <input type=hidden value=no>", "pic"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<p>open <b>bold", "open bold"),
    ("", ""),
    (None, ""),
    ("<", "<"),
    ("<div", ""),
]


@pytest.mark.parametrize("html,text", HTML)
def test_html(html, text):
    assert pages.extract(html) == text


def test_html_deep_and_rows(spark):
    assert pages.extract("<div>" * 50_000 + "x") == "x"
    assert pages.extract("<p>" * 50_000 + "x") == "x"
    d = spark.createDataFrame([(1, "<p>a"), (1, None), (None, "b")], "page_id long, html string")
    assert sorted(map(tuple, pages.extract_text(d).collect()), key=repr) == sorted([(1, "a"), (1, ""), (None, "b")], key=repr)
    assert pages.extract_text(d.limit(0)).collect() == []


def brute_groups(rows):
    unit = []
    for _, v, label in rows:
        x = None if v is None or label is None or any(c is None for c in v) else np.array(v, float)
        unit.append(None if x is None or not len(x) or not np.isfinite(x).all() or not x.any() else x / np.linalg.norm(x))
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
                link[i, j] = link[j, i] = unit[i] @ unit[j] >= 0.93
    group = list(range(n))
    for _ in range(n):
        new = [min([group[i], *(group[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
        if new == group:
            break
        group = new
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[group[i]] = min(r[0], least.get(group[i], r[0]))
    return sorted(((r[0], int(link[i].sum()), least.get(group[i]), r[0] is not None and r[0] == least.get(group[i])) for i, r in enumerate(rows)), key=repr)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1):
        for c in range(12):
            centre = rng.normal(size=16)
            for _ in range(rng.choice([1, 3, 12])):
                rows.append((len(rows), [float(x) for x in centre + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.25])], label))
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 1), (903, [1.0] * 16, None), (904, [1.0, None], 0), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0), (906, [2.0, 4.0], 0), (None, rows[0][1], 0), (907, [], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for shard in (1500, 20, 5):
        got = embeddings.embedding_groups(d, shard=shard, goal=1.0)
        assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()), key=repr) == brute_groups(rows)
    assert embeddings.embedding_groups(d.limit(0)).collect() == []


@pytest.mark.parametrize(
    "html,text",
    [
        ("<html><head><title>T</title><p>text", "text"),
        ("<head><meta charset=x><link rel=y>\n plain text", "plain text"),
        ("<head><noscript><link></noscript><script>x</script></head><body>b", "b"),
        ("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> then", "if x=1 then"),
        ("<svg><title>no</title><defs/><g><text>Sales</text><path d='M0'/><text>2024</text></g></svg> after", "Sales 2024 after"),
        ("İstanbul <b>bold</b><script>no</script><p>end", "İstanbul bold\n\nend"),
    ],
)
def test_html_whole_text(html, text):
    assert pages.extract(html) == text
