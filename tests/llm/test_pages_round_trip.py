"""Pages written from a plan of blocks, against the plan's text laid out plainly."""

import random
import time

import pytest

from graphloom.llm import pages

WORDS = ["alpha", "beta", "gamma", "İstanbul", "çay", "x<y", "a&b", "tea"]


def escaped(s):
    return s.replace("&", "&amp;").replace("<", "&lt;")


def sentence(rng):
    return " ".join(rng.choices(WORDS, k=rng.randrange(1, 8)))


def one_block(rng):
    """(html, lines) of a paragraph, heading, list, table, quotation or unseen element."""
    kind = rng.choice(["p", "h2", "ul", "ol", "table", "blockquote", "hidden", "div"])
    if kind in ("p", "h2"):
        s = sentence(rng)
        end = "" if kind == "p" and rng.random() < 0.5 else f"</{kind}>"
        return f"<{kind} class='a>b'>\n  {escaped(s).replace(' ', rng.choice([' ', chr(10), '  ']))}{end}", [s]
    if kind in ("ul", "ol"):
        items = [sentence(rng) for _ in range(rng.randrange(1, 5))]
        start = rng.randrange(1, 9)
        marks = ["- "] * len(items) if kind == "ul" else [f"{start + i}. " for i in range(len(items))]
        head = "<ul>" if kind == "ul" else f"<ol start={start}>"
        return head + "".join(f"<li>{escaped(x)}" for x in items) + f"</{kind}>", [m + x for m, x in zip(marks, items, strict=True)]
    if kind == "table":
        cols = rng.randrange(1, 4)
        rows = [[sentence(rng) for _ in range(cols)] for _ in range(rng.randrange(1, 4))]
        width = [max(len(r[c]) for r in rows) for c in range(cols)]
        html = "<table>" + "".join("<tr>" + "".join(f"<td>{escaped(x)}" for x in r) for r in rows) + "</table>"
        return html, [" | ".join(x.ljust(w) for x, w in zip(r, width, strict=True)).rstrip() for r in rows]
    if kind == "blockquote":
        s = sentence(rng)
        return f"<blockquote>{escaped(s)}</blockquote>", ["  " + s]
    if kind == "hidden":
        return rng.choice(["<script>if (a<b) {}</script>", "<div hidden>no<p>no</div>", "<!-- <p>no -->", "<p style='display: none'>no</p>", "<template>no</template>"]), None
    s = sentence(rng)
    return f"<div>{escaped(s)}</div>", [s]


@pytest.mark.parametrize("seed", range(40))
def test_round_trip(seed):
    rng = random.Random(seed)
    html, out, divs = "<!doctype html><html><head><title>no</title></head><body>", [], True
    for _ in range(rng.randrange(1, 12)):
        h, lines = one_block(rng)
        html += h
        if lines is None:
            continue
        loose = h.startswith("<div>")
        if out and not (loose and divs):
            out.append("")
        out += lines
        divs = loose
    assert pages.extract(html) == "\n".join(out)


@pytest.mark.parametrize(
    "html,text",
    [
        ("<table><tr><td>a<ul><li>x<li>y</ul><td>b</table>", "a   | b\n    |\n- x |\n- y |"),
        ("<table><tr><td>a<td><table><tr><td>in1<td>in2<tr><td>q<td>r</table></table>", "a | in1 | in2\n  | q   | r"),
        ("<table><tr><th colspan=2>head<th>z<tr><td rowspan=2>1<td>22<td>3<tr><td>5<td>6</table>", "head   | z\n1 | 22 | 3\n  | 5  | 6"),
        ("<details><summary>S</summary>no<p>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
        ("<script>a</scripty>b</script >c", "c"),
        ("<a t=\"x>y\">L</a><i b'c>M</i> <b a=\"open>N", "LM N"),
    ],
)
def test_cells_and_ends(html, text):
    assert pages.extract(html) == text


@pytest.mark.parametrize(
    "html",
    [
        "<p><button>" + "<b>" * 40_000 + "<div></div>" * 40_000,
        "<table><tr><td>" * 5_000,
        "<a " + 'x="1" ' * 100_000 + ">",
        "<a " + 'x"1" ' * 100_000 + ">",
        "<table>" + ("<tr>" + "<td colspan=1000 rowspan=60000>x" * 50) * 400,
        "<li>" * 50_000,
        "word " * 400_000,
    ],
)
def test_no_page_takes_long(html):
    began = time.time()
    pages.extract(html)
    assert time.time() - began < 10


def test_spans_hold_in_tables_of_any_size():
    # A wide first row, whose first cell spans all rows below and whose last cell is far off.
    for wide, rows in ((3, 4), (60, 400), (400, 60)):
        html = f"<table><tr><td rowspan={rows}>a" + "<td>b" * (wide - 1) + "<tr><td>c" * (rows - 1) + "</table>"
        assert pages.extract(html) == "\n".join([" | ".join(["a"] + ["b"] * (wide - 1))] + ["  | c"] * (rows - 1))
    # Rows below do not change the lines above.
    head = "<table><tr>" + "<td rowspan=3>x" * 100 + "<tr><td>y<tr><td colspan=2>z<td>w"
    few, many = pages.extract(head).split("\n"), pages.extract(head + "<tr><td>v" * 1000).split("\n")
    assert few == [" | ".join(["x"] * 100 + [" ", " "]).rstrip(" |"), "  | " * 100 + "y", "  | " * 100 + "z | w"]
    assert many == few + ["v"] * 1000


def test_texts_leave_in_batches(spark, monkeypatch):
    monkeypatch.setattr(pages, "BATCH", 10)
    rows = [(i % 7, "<p>" + "word" * (i % 5)) for i in range(50)] + [(None, None)]
    got = pages.extract_text(spark.createDataFrame(rows, "page_id long, html string").coalesce(1)).collect()
    assert [tuple(r) for r in got] == [(i, pages.extract(t)) for i, t in rows]


def test_query(spark, tmp_path):
    rows = [(1, "<p>a</p>", "u", 1), (1, "<p>a</p>", "u", 1), (2, None, "u", 2), (3, "", "u", 3), (None, "t<br>u", None, 4)]
    spark.createDataFrame(rows, "page_id long, html string, url string, text int").write.parquet(f"{tmp_path}/pages.parquet")
    got = pages.op7_html(spark, str(tmp_path))
    assert got.columns == ["page_id", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a", 1), (1, "a", 1), (2, "", 0), (3, "", 0), (None, "t\nu", 3)], key=str)
    assert pages.extract_text(spark.createDataFrame([], "page_id long, html string, HTML2 string")).collect() == []
