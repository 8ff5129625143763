"""HTML extraction by layout-aware rendering.

A tolerant tree builder reads the markup in one pass: it opens and closes
elements by their rules of implied end tags (list items, paragraphs, cells,
rows, options, definition terms), skips what is never shown (scripts, styles,
templates, comments, the head with its title, definitions and annotations in
svg and math, the body of a details element that is not open), and drops
elements that are hidden by attribute or inline style.  The head ends at the
first text or tag that cannot stand in it.  Open elements are known by tag, so
that closing one costs nothing by depth.

The tree is then rendered to text: blocks stand on lines of their own,
headings, paragraphs, lists and tables with an empty line around; list items
carry a bullet or their number and are indented by depth; white space is
collapsed except in pre and textarea.  A table's cells are rendered like
documents of their own, innermost tables first, so lists, lines and tables in
cells keep their shape; the lines of a row's cells stand side by side, padded
to the width of their column, and cells that span columns or rows keep the
others in place.

The builder keeps its own stack and the renderer walks without recursion, so
depth is bounded by memory only.  Very long words do not widen a table's
columns beyond MAX_CELL.  All tables are laid out by one rule, whatever their
size, so where cells span many rows of a wide table the text, mostly blanks,
grows with its rows times its columns.

Defined results: null or empty html gives the empty text; what is not markup
is text; unclosed elements end with the document, an unfinished tag ends it;
very long pages are rendered whole; of an attribute given twice the first
counts; pages that repeat a page_id, and a null page_id, are rows of their
own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

MAX_CELL = 60
#: Texts leave in batches of about so many characters, as a table's may be far longer than its page.
BATCH = 1 << 24

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe noembed noframes xmp textarea title svg math object canvas audio video".split())
OPAQUE = frozenset("script style template iframe noembed noframes svg math object canvas audio video".split())
UNSEEN = frozenset("script style template iframe noembed noframes object canvas audio video head datalist dialog noscript".split())
UNSEEN_FOREIGN = frozenset("defs symbol clippath mask pattern metadata desc annotation annotation-xml".split())
IN_HEAD = frozenset("head html base basefont bgsound link meta title style script noscript template noframes".split())
BLOCK = frozenset("address article aside blockquote body center details dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul caption tr thead tbody tfoot".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir".split())
_CLOSES_P = BLOCK - frozenset("body html option optgroup tr thead tbody tfoot caption legend summary".split())
#: An opening tag ends these open elements, up to the nearest of its bounds.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "body": (("head",), ("html",)),
}
_TABLED = frozenset("table tr tbody thead tfoot body html td th".split())
_SCOPE = frozenset(("table", "td", "th", "caption", "body", "html", "button", "object"))
_NAME = re.compile(r"[A-Za-z][^\x00-\x20/>]*")
#: What follows a tag's name up to its end; only a quote after = opens a value.
_REST = re.compile(r"""(?:[^>"'=]++|=[ \t\n\r\f]*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_BLANK = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element; shut: only its summary shows; spans: columns and rows of a cell; lines: of a table, once rendered."""

    __slots__ = ("tag", "kids", "start", "shut", "spans", "lines")

    def __init__(self, tag: str, start: int = 1, shut: bool = False, spans: tuple[int, int] = (1, 1)):
        self.tag, self.kids, self.start, self.shut, self.spans = tag, [], start, shut, spans
        self.lines: list[str] = []


def _whole(s: str, most: int) -> int:
    """A span's number: at least 1, at most what the standard allows."""
    return min(max(int(s), 1), most) if s.isascii() and s.isdigit() and len(s) < 10 else 1


def parse(html: str) -> Node:
    root = Node("html")
    stack: list[Node] = [root]
    places: dict[str, list[int]] = {}  # where each tag stands in the stack, outermost first
    hidden = 0  # the depth of the stack at which a hidden element was opened, else 0
    low = html.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only, so that places stay
    i, n = 0, len(html)

    def close_to(depth: int) -> None:
        nonlocal hidden
        for x in stack[depth:]:
            places[x.tag].pop()
        del stack[depth:]
        if hidden and depth <= hidden:
            hidden = 0

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def text(s: str) -> None:
        if stack[-1].tag == "head" and s.strip(" \t\n\r\f"):
            close_to(len(stack) - 1)
        if s and not hidden and not stack[-1].shut:
            stack[-1].kids.append(unescape(s))

    while i < n:
        j = html.find("<", i)
        if j < 0:
            text(html[i:])
            break
        text(html[i:j])
        if html.startswith("<!--", j):
            k = html.find("-->", j + 4)
            i = n if k < 0 else k + 3
            continue
        if html.startswith(("<!", "<?"), j):
            k = html.find(">", j)
            i = n if k < 0 else k + 1
            continue
        closing = html.startswith("</", j)
        m = _NAME.match(low, j + 1 + closing)
        if not m:
            text("<")
            i = j + 1
            continue
        tag = m[0]
        rest = _REST.match(html, m.end())
        if not rest:
            break  # an unfinished tag ends the document
        i = rest.end()
        k = i - 1
        if closing:
            if places.get(tag):
                bound = 0 if tag in _TABLED else innermost(("table", "td", "th"))
                if places[tag][-1] > bound:
                    close_to(places[tag][-1])
            elif tag == "br":
                stack[-1].kids.append(Node("br"))
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            close_to(len(stack) - 1)
        if tag in IMPLIED:
            ends, bounds = IMPLIED[tag]
            bound = innermost(bounds)
            over = [at[x] for e in ends if (at := places.get(e)) and (x := bisect_right(at, bound)) < len(at)]
            if over:
                close_to(min(over))
        if tag in _CLOSES_P and places.get("p") and places["p"][-1] > innermost(_SCOPE):
            close_to(places["p"][-1])
        body = html[m.end() : k]
        attrs = {}
        if body.strip(" \t\n\r\f/"):
            for a in _ATTR.finditer(body):
                attrs.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
        foreign = bool(places.get("svg") or places.get("math"))
        unseen = tag in UNSEEN or (foreign and tag in UNSEEN_FOREIGN) or "hidden" in attrs or bool(_HIDDEN_STYLE.search(attrs.get("style", ""))) or (tag == "input" and attrs.get("type", "").lower() == "hidden")
        if tag == "dialog" and "open" in attrs:
            unseen = "hidden" in attrs
        unseen = unseen or (stack[-1].shut and tag != "summary")
        if tag == "br" or tag == "hr":
            if not hidden and not unseen:
                stack[-1].kids.append(Node(tag))
            continue
        if tag in VOID:
            shown = attrs.get("alt", "") if tag == "img" else attrs.get("value", "") if tag == "input" and attrs.get("type", "text").lower() in ("text", "button", "submit", "reset", "search", "email", "url", "tel", "number", "") else ""
            if shown and not hidden and not unseen:
                stack[-1].kids.append(shown)
            continue
        if (foreign or tag in ("svg", "math")) and body.endswith("/"):
            continue
        if tag in RAW and tag not in ("svg", "math", "object", "noscript", "canvas", "audio", "video"):
            end = re.compile(rf"</{tag}(?=[ \t\n\r\f/>])").search(low, i)
            inner, i = (html[i:], n) if not end else (html[i : end.start()], (html.find(">", end.start()) + 1) or n)
            if tag in ("textarea", "xmp") and not hidden and not unseen:
                node = Node("pre")
                node.kids.append(unescape(inner) if tag == "textarea" else inner)
                stack[-1].kids.append(node)
            continue
        if tag in ("html", "body") and len(stack) == 1 and not unseen:
            continue
        if foreign and tag == "text" and not hidden and not unseen:
            stack[-1].kids.append(" ")
        start = 1
        if tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", attrs.get("start", "")):
            start = int(attrs["start"])
        spans = (_whole(attrs.get("colspan", ""), 1000), _whole(attrs.get("rowspan", ""), 65534)) if tag in ("td", "th") else (1, 1)
        node = Node(tag, start, tag == "details" and "open" not in attrs, spans)
        if not hidden and not unseen:
            stack[-1].kids.append(node)
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
        if unseen and not hidden:
            hidden = len(stack) - 1
    return root


class _Out:
    """Lines of text with collapsed blanks and at most one empty line between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False  # a blank is due before the next text
        self.empty = False  # an empty line is due before the next line
        self.prefix = ""  # of the next line only
        self.indent = ""

    def words(self, s: str) -> None:
        parts = _BLANK.split(s)
        if len(parts) == 1:
            if parts[0]:
                self._put(parts[0])
            return
        if parts[0]:
            self._put(parts[0])
        mid = [p for p in parts[1:] if p]
        if mid:
            self.gap = bool(self.now) or self.gap
            self._put(" ".join(mid))
        self.gap = (not parts[-1]) or self.gap
        if parts[-1]:
            self.gap = False

    def _put(self, s: str) -> None:
        if self.gap and self.now:
            self.now.append(" ")
        self.gap = False
        self.now.append(s)

    def line(self) -> None:
        if self.now:
            self._emit(self.indent + self.prefix + "".join(self.now))
            self.indent_used()
        self.now, self.gap = [], False

    def indent_used(self) -> None:
        if self.prefix:
            self.indent += " " * len(self.prefix)
            self.prefix = ""

    def _emit(self, s: str) -> None:
        if self.empty and self.lines:
            self.lines.append("")
        self.empty = False
        self.lines.append(s)

    def raw(self, s: str) -> None:
        self.line()
        for x in s.replace("\r\n", "\n").replace("\r", "\n").strip("\n").split("\n"):
            self._emit(self.indent + self.prefix + x.rstrip())
            self.indent_used()

    def space(self) -> None:
        self.line()
        self.empty = True


def _flat(node: Node) -> str:
    """A node's text on one line."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.tag in BLOCK or x.tag in ("br", "td", "th"):
            out.append(" ")
        todo.append(" " if x.tag in BLOCK else "")
        todo += reversed(x.kids)
    return _BLANK.sub(" ", "".join(out)).strip(" ")


def _text_of(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append("\n")
        else:
            todo += reversed(x.kids)
    return "".join(out)


def _rows(tab: Node) -> tuple[list[str], list[list[tuple[list[str], int, int]]]]:
    """A table's captions and other loose text, and its rows of cells (lines, columns and rows spanned)."""
    loose, rows = [], []
    todo: list = list(reversed(tab.kids))
    cell = lambda c: (_block(c), *c.spans)
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                loose.append(_BLANK.sub(" ", x).strip())
        elif x.tag == "tr":
            rows.append([cell(c) for c in x.kids if isinstance(c, Node) and c.tag in ("td", "th")])
            other = [_flat(c) if isinstance(c, Node) else _BLANK.sub(" ", c).strip() for c in x.kids if not (isinstance(c, Node) and c.tag in ("td", "th"))]
            loose += [o for o in other if o]
        elif x.tag in ("tbody", "thead", "tfoot", "colgroup"):
            todo += reversed(x.kids)
        elif x.tag in ("td", "th"):
            rows.append([cell(x)])
        else:
            t = _flat(x)
            if t:
                loose.append(t)
    return loose, rows


def _aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of rows whose columns stand below one another; rows without text are left out.

    A cell spans no further than columns of cells go.
    """
    most = max(map(len, rows), default=0)
    placed, taken = [], np.zeros(most, np.int64)  # taken: of a column, the row at which it is free again
    for y, r in enumerate(rows):
        at, line = 0, []
        for lines, across, down in r:
            if at < most and taken[at] > y:
                free = taken[at:] <= y
                at = at + int(free.argmax()) if free.any() else most
            across = max(1, min(across, most - at))
            line.append((at, across, lines))
            if down > 1 and at < most:
                taken[at : at + across] = y + down
            at += across
        placed.append(line)
    width = [0] * max((line[-1][0] + line[-1][1] for line in placed if line), default=0)
    for line in placed:
        for at, across, lines in line:
            if across == 1:
                width[at] = max(width[at], min(MAX_CELL, max(map(len, lines), default=0)))
    blank = "".join(" " * w + " | " for w in width)  # a line without text
    start = list(accumulate((w + 3 for w in width), initial=0))  # where in it each column begins
    out = []
    for line in placed:
        if not any(lines for _, _, lines in line):
            continue
        for i in range(max(len(lines) for _, _, lines in line)):
            now, to = [], 0
            for at, across, lines in line:
                now.append(blank[start[to] : start[at]])
                now.append((lines[i] if i < len(lines) else "").ljust(start[at + across] - start[at] - 3) + " | ")
                to = at + across
            out.append("".join(now)[:-3].rstrip())
    return out


def render(root: Node) -> str:
    tables, todo = [], [root]
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            if x.tag == "table":
                tables.append(x)
            todo += x.kids
    for t in reversed(tables):  # inner ones come after those around them
        loose, rows = _rows(t)
        t.lines = loose + _aligned(rows)
    return "\n".join(_block(root))


def _block(root: Node) -> list[str]:
    """An element's lines; the tables in it have theirs already."""
    out = _Out()
    lists: list[list] = []  # [tag, next number]
    todo: list = [("open", k) for k in reversed(root.kids)]
    while todo:
        what, x = todo.pop()
        if what == "call":
            x()
            continue
        if isinstance(x, str):
            out.words(x)
            continue
        tag = x.tag
        if tag == "br":
            if out.now:
                out.line()
            else:
                out.empty = bool(out.lines)
            continue
        if tag == "hr":
            out.space()
            continue
        if tag == "pre":
            out.space()
            t = _text_of(x)
            if t.strip():
                out.raw(t)
            out.space()
            continue
        if tag == "table":
            out.space()
            for s in x.lines:
                out.raw(s)
            x.lines = []
            out.space()
            continue
        before, after = out.indent, out.prefix
        if tag in ("ul", "ol", "menu", "dir"):
            nested = bool(lists)
            out.line() if nested else out.space()
            lists.append([tag, x.start])
            todo.append(("call", lambda nested=nested: (lists.pop(), out.line() if nested else out.space())))
        elif tag == "li":
            out.line()
            mark = "- "
            if lists and lists[-1][0] == "ol":
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            out.prefix = mark

            def done(before=before):
                out.line()
                out.prefix, out.indent = "", before

            todo.append(("call", done))
        elif tag == "dd":
            out.line()
            out.indent += "  "

            def out_dd(before=before):
                out.line()
                out.indent = before

            todo.append(("call", out_dd))
        elif tag == "blockquote":
            out.space()
            out.indent += "  "

            def out_quote(before=before):
                out.space()
                out.indent = before

            todo.append(("call", out_quote))
        elif tag == "q":
            out.words('"')
            todo.append(("call", lambda: out.now.append('"') if out.now else out.words('"')))
        elif tag in SPACED:
            if out.prefix and not out.now:
                pass  # the first block of a list item stands beside its mark
            else:
                out.space()
            todo.append(("call", out.space))
        elif tag in BLOCK:
            out.line()
            todo.append(("call", out.line))
        del after
        todo += [("open", k) for k in reversed(x.kids)]
    out.line()
    return out.lines


def extract(html: str | None) -> str:
    return render(parse(html)) if html else ""


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, text."""

    def of(batches):
        for b in batches:
            texts, size, first = [], 0, 0
            for i, t in enumerate(b.column("html").to_pylist(), 1):
                texts.append(extract(t))
                size += len(texts[-1])
                if size > BATCH or i == len(b):
                    yield pa.RecordBatch.from_arrays([b.column("page_id").slice(first, i - first), pa.array(texts, pa.string())], ["page_id", "text"])
                    texts, size, first = [], 0, i

    p = pick(pages, "page_id", "html").select(F.col("page_id").cast("long").alias("page_id"), "html")
    return p.mapInArrow(of, "page_id long, text string")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op7_html": op7_html}
ORACLES: dict[str, str] = {}
