"""Line dedup: range-partitioned line hashes, keep bitmaps instead of text.

Every line of at least ``min_chars`` code points (after its blank ends are
stripped and A-Z lower-cased) is hashed to 128 bits.  The hashes are dealt out
by range of (hash, document) and sorted by (hash, document, position), so a
hash that a third of all documents hold spans many tasks while each
document's first occurrence can still be streamed off one sorted run.  The
counts of those firsts are pre-aggregated before they meet by hash.

What is returned is a run-length keep bitmap per document; the text itself is
only read where the caller wants the kept text.  Up to NEAR frequent hashes
travel to the documents as a table inside the expression, and no text is
shuffled; beyond that their occurrences go back to the documents as positions
through a join.  Both ways give the same rows.

Defined results: a null or empty text is one empty line and is kept; very long
texts and lines are taken whole; of a frequent line the holder is the largest
doc_id, and in it every occurrence stays; rows that repeat a doc_id count as
one document; a row with a null doc_id never counts as a document and loses
every line that others make frequent; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, cut, digest, parts, pick, release, table

MIN_CHARS = 40
MIN_DOCS = 5
NEAR = 50_000
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _bodies(docs: DataFrame) -> DataFrame:
    d = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    t1, t2 = digest(F.col("body"))
    return d.select("doc_id", t1.alias("t1"), t2.alias("t2"), "body")


def frequent_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
    """(occurrences, frequent): where each long line stands, and the hashes found in min_docs documents."""
    d = _bodies(docs)
    lines = d.select("doc_id", "t1", "t2", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("key", F.btrim("line", F.lit(BLANKS))).where(F.char_length("key") >= min_chars)
    h1, h2 = digest(ascii_lower(F.col("key")))
    # The positions are written, for the join that may come; they are narrow.
    occ = cut(lines.select("doc_id", "t1", "t2", "pos", h1.alias("h1"), h2.alias("h2")))
    dealt = (
        occ.where("doc_id is not null")
        .select("h1", "h2", "doc_id", "pos")
        .repartitionByRange(parts(docs.sparkSession), "h1", "h2", "doc_id")
        .sortWithinPartitions("h1", "h2", "doc_id", "pos")
    )
    order = Window.partitionBy("h1", "h2", "doc_id").orderBy("pos")
    firsts = dealt.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    frequent = cut(
        firsts.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("holder"))
        .where(F.col("n_docs") >= min_docs)
    )
    return occ, frequent


def _runs(p: str) -> list:
    """Of sorted positions p: how many, and the first and last of each run."""
    return [
        F.size(p).alias("n_drop"),
        F.expr(f"filter({p}, (x, i) -> i = 0 or {p}[i - 1] <> x - 1)").alias("first"),
        F.expr(f"filter({p}, (x, i) -> i = size({p}) - 1 or {p}[i + 1] <> x + 1)").alias("last"),
    ]


def _held(rows: list[tuple[int, int, int]]) -> str:
    """SQL for: which document holds the line with hashes h.a and h.b, null if it is none of rows.

    rows (h1, h2, holder) lie one after the other by the low bits of h1; starts says where each group begins.
    """
    mask = (1 << len(rows).bit_length() + 1) - 1
    groups: dict[int, list] = {}
    for r in rows:
        groups.setdefault(r[0] & mask, []).append(r)
    starts, data = [0], []
    for g in range(mask + 1):
        data += groups.get(g, ())
        starts.append(len(data))
    lit = lambda x: "cast(split('" + ",".join(map(str, x)) + "', ',') as array<bigint>)"
    s, a, b, d = lit(starts), *(lit([r[i] for r in data] or [0]) for i in range(3))
    at, end = f"int({s}[int(h.a & {mask})])", f"int({s}[int(h.a & {mask}) + 1])"
    find = f"filter(sequence({at}, {end} - 1), i -> {a}[i] = h.a and {b}[i] = h.b)"
    return f"if(h is null or {at} = {end}, null, get(transform({find}, i -> {d}[i]), 0))"


def _with_drops(rows: DataFrame, docs: DataFrame, min_chars: int, min_docs: int, near: int) -> DataFrame:
    """rows (doc_id, body and more) with the lines that go: n_drop, first and last, all null where none goes."""
    occ, frequent = frequent_lines(docs, min_chars, min_docs)
    n = frequent.count()
    if n <= near and dict(docs.dtypes)[pick(docs, "doc_id").columns[0]] in _WHOLE:
        found = [tuple(r) for r in frequent.select("h1", "h2", F.col("holder").cast("long")).collect()]
        release(occ), release(frequent)

        def hashes(key):
            h1, h2 = digest(key)
            return F.when(key.isNotNull(), F.struct(h1.alias("a"), h2.alias("b")))

        # A step at a time, so that no line is stripped or lower-cased twice.
        keys = F.transform(F.split("body", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))
        keys = F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, ascii_lower(k)))
        d = rows.withColumn("hs", F.transform(keys, hashes))
        holder = F.expr(f"transform(hs, h -> {_held(found)})") if found else F.expr("transform(hs, h -> bigint(null))")
        d = d.withColumn("hold", holder).drop("hs")
        gone = "filter(sequence(0, size(hold) - 1), i -> hold[i] is not null and (doc_id is null or hold[i] <> doc_id))"
        d = d.withColumn("p", F.expr(gone)).drop("hold").withColumn("p", F.when(F.size("p") > 0, F.col("p")))
        runs = [F.when(F.col("p").isNotNull(), c) for c in _runs("p")]
        return d.select(*rows.columns, *[c.alias(x) for c, x in zip(runs, ("n_drop", "first", "last"), strict=True)])
    hit = occ.join(frequent, ["h1", "h2"]).where("doc_id is null or doc_id <> holder")
    pos = hit.groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    drops = pos.select(F.col("doc_id").alias("r_id"), F.col("t1").alias("r1"), F.col("t2").alias("r2"), *_runs("p"))
    t1, t2 = digest(F.col("body"))
    on = F.col("doc_id").eqNullSafe(F.col("r_id")) & (t1 == F.col("r1")) & (t2 == F.col("r2"))
    return rows.join(drops.hint("shuffle_hash"), on, "left").select(*rows.columns, "n_drop", "first", "last")


_RUNS = """concat(
  flatten(transform(first, (f, i) -> array(f - if(i = 0, 0, last[i - 1] + 1), last[i] - f + 1))),
  array(n_lines - if(size(last) > 0, last[size(last) - 1] + 1, 0)))"""



def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, with_text: bool = False, near: int = NEAR) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped and keep_bitmap.

    keep_bitmap is run-length coded: lengths of runs of kept and dropped lines
    in turn, kept first and last (so it may begin or end with 0).  with_text
    adds ``kept``, the lines that stay, joined by \\n.
    """
    d = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    none = F.array().cast("array<int>")
    j = (
        _with_drops(d, docs, min_chars, min_docs, near)
        .withColumn("n_lines", F.size(F.split("body", "\n", -1)))
        .withColumn("first", F.coalesce("first", none))
        .withColumn("last", F.coalesce("last", none))
        .withColumn("keep_bitmap", F.expr(_RUNS))
        .withColumn("n_dropped", F.coalesce("n_drop", F.lit(0)).cast("long"))
        .withColumn("n_lines", F.col("n_lines").cast("long"))
    )
    out = ["doc_id", "n_lines", "n_dropped", "keep_bitmap"]
    if with_text:
        j = j.withColumn("kept", F.when(F.col("n_drop").isNull(), F.col("body")).otherwise(_kept("body")))
        out.append("kept")
    return j.select(*out)


def _kept(body: str):
    """The lines of body outside the runs first to last."""
    lines = f"split({body}, '\n', -1)"
    return F.expr(
        f"array_join(flatten(transform(array({lines}), l -> flatten(transform(sequence(0, size(first)), i -> slice(l,"
        " if(i = 0, 0, last[i - 1] + 1) + 1,"
        " if(i = size(first), size(l), first[i]) - if(i = 0, 0, last[i - 1] + 1)))))), '\n')"
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = line_dedup(table(spark, sf_dir, "documents"), with_text=True)
    return r.select("doc_id", "n_lines", "n_dropped", F.array_join("keep_bitmap", ",").alias("keep_bitmap"), F.sha2("kept", 256).alias("kept_sha256"))


def cut_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, near: int = NEAR) -> DataFrame:
    """docs with the frequent lines cut out of text and n_chars set anew; a row that loses all lines stays, empty.

    Only doc_id, text, lang, source and n_chars are returned.  Rows of equal
    doc_id and text are told apart by nothing else, so their other columns
    come from the row itself.
    """
    rest = pick(docs, "doc_id", "text", "lang", "source", "n_chars").withColumn("body", F.coalesce("text", F.lit("")))
    j = _with_drops(rest, docs, min_chars, min_docs, near).withColumn("kept", F.when(F.col("n_drop").isNotNull(), _kept("body")))
    text = F.when(F.col("n_drop").isNull(), F.col("text")).otherwise(F.col("kept"))
    n = F.when(F.col("n_drop").isNull(), F.col("n_chars")).otherwise(F.char_length("kept").cast("long"))
    return j.select("doc_id", text.alias("text"), "lang", "source", n.alias("n_chars"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLES = {
    "op10_line_dedup": r"""
WITH l AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), f AS (
  SELECT k, max(doc_id) AS holder FROM l WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT l.doc_id, l.pos, l.line, f.k IS NOT NULL AND l.doc_id <> f.holder AS gone
  FROM l LEFT JOIN f ON l.k = f.k
), r AS (
  SELECT doc_id, gone, min(pos) AS p, count(*) AS n
  FROM (SELECT doc_id, pos, gone, pos - row_number() OVER (PARTITION BY doc_id, gone ORDER BY pos) AS g FROM m) GROUP BY doc_id, gone, g
), b AS (
  SELECT doc_id, CASE WHEN arg_min(gone, p) THEN '0,' ELSE '' END || string_agg(n, ',' ORDER BY p) || CASE WHEN arg_max(gone, p) THEN ',0' ELSE '' END AS bitmap
  FROM r GROUP BY doc_id
)
SELECT m.doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped, any_value(b.bitmap) AS keep_bitmap,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m JOIN b ON m.doc_id = b.doc_id GROUP BY m.doc_id
"""
}
