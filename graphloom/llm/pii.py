"""Personal data: fixed patterns, and contexts bootstrapped from them.

One pass over the texts finds the fixed patterns' spans, and every other token
that looks like an identifier (at least MIN_TOKEN characters with a digit or an
@ between blanks, stripped of marks at its ends; however long).  Both kinds of
mention are instances, known by a digest of their string; a mention stands in
two lexical patterns: the two words before it on its line, and the word before
with the word after.  Words are lower-cased and stripped of marks; a pattern
longer than LONG_PATTERN characters is known by its digest.

Spans of the fixed patterns are the seeds.  Spark then scores the graph of
patterns and instances in turn: a pattern's confidence for a kind is the mean
confidence of its instances for that kind, shrunk by SHRINK unseen failures;
an instance that is no seed has the confidence of its best pattern.  After
ROUNDS rounds, patterns with confidence of at least CONFIDENT and at least
SUPPORT distinct seed instances add their other mentions as spans of that
kind.

Defined results: a null or empty text has no spans; very long texts, lines and
tokens are scanned whole and in linear time; rows that repeat a doc_id are
scanned as rows of their own; copies of a text count once in scores, because
instances are distinct strings; a mention claimed by several patterns takes
the kind of the most confident, and of equals the kind listed first; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pick, table

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
CONFIDENT = 0.8
SUPPORT = 5
SHRINK = 1.0
MIN_TOKEN = 6
LONG_PATTERN = 200

#: Fixed values.  The e-mail pattern is split at the @; the parts before a match's end cannot be taken twice.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: A token with a digit or an @; tried at the beginnings of tokens only, so that no token is read twice.
_HINTED = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_ENDS = "\"'.,;:!?()[]{}<>*|"
_HINT = re.compile(r"[0-9@]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _small(digits: str) -> bool:
    """At most 255, given without leading zeros."""
    return len(digits) <= 3 and int(digits or 0) <= 255


def _emails(t: str):
    last = 0
    for m in _DOMAIN.finditer(t):
        a = m.start()
        while a > last and t[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            last = m.end()
            yield a, last


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = []
    if "@" in t:
        out += [(a, 0, b) for a, b in _emails(t)]
    if _HINT.search(t):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(t) if all(_small(p.lstrip("0")) for p in m[0].split("."))]
        for m in _CARD.finditer(t):
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and _luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in t:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(t) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    out.sort()
    return out


def _digest(s: str) -> str:
    return blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def mentions(t: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[str]]]:
    """(start, kind or -1, end, instance, patterns) of seeds and of other tokens that look like identifiers."""
    out = []
    if not _HINT.search(t):
        return out
    found = [(a, k, b) for a, k, b in base]
    taken = sorted((a, b) for a, _, b in base)
    i = reach = 0
    for m in _HINTED.finditer(t):
        a, b = m.span()
        if b - a < MIN_TOKEN:
            continue
        while a < b and t[a] in _ENDS:
            a += 1
        while b > a and t[b - 1] in _ENDS:
            b -= 1
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if b - a >= MIN_TOKEN and reach <= a:
            found.append((a, -1, b))
    if not found:
        return out
    words = [m.span() for m in _TOKEN.finditer(t)]
    begins = [a for a, _ in words]

    def word(a: int, b: int) -> str:
        return t[a:b].lower().strip(_ENDS + "=#-")

    def short(p: str) -> str:
        return p if len(p) <= LONG_PATTERN else _digest(p)

    for a, k, b in found:
        at = bisect_left(begins, a)
        before = []
        if at and words[at - 1][1] > a:  # the mention begins inside a word
            at -= 1
            before.append(word(words[at][0], a))
        end = a if not before else words[at][0]
        while at and len(before) < 2:
            x, y = words[at - 1]
            if "\n" in t[y:end]:
                break
            before.append(word(x, y))
            at, end = at - 1, x
        after = bisect_left(begins, b)
        nxt = word(*words[after]) if after < len(words) and "\n" not in t[words[after - 1][1] : words[after][0]] else ""
        patterns = [short(" ".join(reversed(before)))] if any(before) else []
        if before and before[0]:
            patterns.append(short(f"{before[0]} _ {nxt}"))
        if patterns:
            out.append((a, k, b, _digest(t[a:b]), patterns))
    return out


_SPANS = "array<struct<start: int, kind: int, end: int>>"
_MENTIONS = "array<struct<start: int, kind: int, end: int, instance: string, patterns: array<string>>>"


def _scanned(docs: DataFrame) -> DataFrame:
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    seen = pa.struct([*span, ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])

    def of(batches):
        for b in batches:
            base, found = [], []
            for t in b.column("text").to_pylist():
                s = base_spans(t or "")
                base.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in s])
                found.append([dict(zip(("start", "kind", "end", "instance", "patterns"), x, strict=True)) for x in mentions(t or "", s)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(seen))], ["doc_id", "base", "mentions"])

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(of, f"doc_id long, base {_SPANS}, mentions {_MENTIONS}")


def score_patterns(mentioned: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence, support) from mentions (kind, instance, pattern)."""
    edges = cut(mentioned.groupBy("pattern", "instance").agg(F.max("kind").alias("seed")))
    seeds = edges.where("seed >= 0").select("pattern", F.col("seed").alias("kind")).distinct()
    pairs = seeds  # only kinds that a seed has shown for a pattern can be scored for it
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("all"))
    known = edges.where("seed >= 0").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count(F.lit(1)).alias("support"))
    stats = cut(pairs.join(known, ["pattern", "kind"]).join(size, "pattern"))
    score = cut(stats.withColumn("confidence", F.col("support") / (F.col("all") + SHRINK)))
    open_edges = cut(edges.where("seed < 0").join(stats.select("pattern").distinct(), "pattern", "left_semi").select("pattern", "instance"))
    for _ in range(rounds - 1):
        # What is no seed is worth what its best pattern says of it.
        worth = open_edges.join(score, "pattern").groupBy("instance", "kind").agg(F.max("confidence").alias("worth"))
        more = open_edges.join(worth, "instance").groupBy("pattern", "kind").agg(F.sum("worth").alias("more"))
        score = cut(
            stats.join(more, ["pattern", "kind"], "left").select("pattern", "kind", "all", "support", ((F.col("support") + F.coalesce("more", F.lit(0.0))) / (F.col("all") + SHRINK)).alias("confidence"))
        )
    return score.select("pattern", "kind", "confidence", "support")


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """One row per row of docs: doc_id, base and added, arrays of (start, kind, end); kind indexes KINDS."""
    s = cut(_scanned(docs).withColumn("rid", F.monotonically_increasing_id()))
    m = s.where("size(mentions) > 0").select("rid", F.explode("mentions").alias("m")).select("rid", "m.*")
    m = m.select("rid", "start", "kind", "end", "instance", F.explode("patterns").alias("pattern"))
    scores = score_patterns(m.select("kind", "instance", "pattern"), rounds)
    sure = scores.where((F.col("confidence") >= confident) & (F.col("support") >= support))
    claim = lambda: F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("best")
    best = cut(sure.groupBy("pattern").agg(claim()).select("pattern", "best.confidence", F.expr("-best.k").alias("as")))
    hits = m.where("kind < 0").join(best, "pattern").select("rid", "start", "end", "confidence", F.col("as").alias("kind"))
    hits = hits.groupBy("rid", "start", "end").agg(claim()).select("rid", F.struct("start", F.expr("-best.k").alias("kind"), "end").alias("span"))
    added = hits.groupBy("rid").agg(F.sort_array(F.collect_set("span")).alias("added"))
    none = F.array().cast(_SPANS)
    return s.join(added.withColumnRenamed("rid", "at"), F.col("rid") == F.col("at"), "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = find_personal_data(table(spark, sf_dir, "documents"))
    name = "element_at(array('email', 'ip', 'card', 'phone'), x.kind + 1)"
    text = lambda c: F.expr(f"array_join(transform({c}, x -> concat_ws(':', {name}, string(x.start), string(x.end))), ',')")
    n = lambda k: F.expr(f"bigint(size(filter(base, x -> x.kind = {k})))")
    return s.select(
        "doc_id",
        *[n(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(text("base"), 256).alias("base_sha256"),
        text("sort_array(concat(base, added))").alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


QUERIES = {"op4_pii": op4_pii}
ORACLES: dict[str, str] = {}
