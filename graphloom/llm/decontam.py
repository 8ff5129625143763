"""Benchmark decontamination by winnowing.

Words of documents and items are hashed, every k consecutive word hashes make
a k-gram hash, and of each ``window - k + 1`` consecutive k-grams the least
hash is kept (the rightmost of equals).  A span of ``window`` words shared by
a document and an item holds the same k-grams on both sides, so both sides
keep the same one of them: no shared span is missed.  Kept k-grams meet by
hash; each meeting is verified on the words themselves and extended up to
``window - k`` words each way, which covers every shared window that holds
the k-gram.

Items shorter than a window are one window of their own length; for each
length that occurs, runs of that many words are hashed and verified in the
same way.

A bitmap of the benchmark's hashes of all lengths, 16 bits for each, is tried
first, so that only runs which may meet one are looked at further; documents
are split and hashed once for each BLOCK of the benchmark's hashes, most often
once in all.  Where a block has at most NEAR hashes its words are broadcast;
beyond that the runs left over by the bitmap are dealt out by hash.  Whole
texts never cross a shuffle.

Defined results: a null or wordless text has no words and no hits; an item
without words has no window; items with a null item_id count for hits, are one
item together and have no name in the list; rows that repeat an item_id count
as one item, rows that repeat a doc_id stay apart; very long texts are looked
at whole; of equal least hashes the rightmost is kept on both sides; an empty
table on either side gives no hits; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, pick, table, without

WINDOW = 10
K = 5
BLOCK = 500_000
NEAR = 100_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: All fingerprints.  Not the bare column: Spark would copy what makes it into a filter below the explode.
_ALL = f"slice(fps, 1, {2**31 - 1})"


def words_of(text: Column) -> Column:
    """Maximal runs of digits, a-z and non-ASCII characters, A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP), "")


def _gram(k: int, x: str = "i", of: str = "wh") -> str:
    return "xxhash64(" + ", ".join(f"{of}[{x} + {j}]" for j in range(k)) + ")"


def _cells(index: DataFrame, n: int) -> tuple[str, int]:
    """SQL for a bitmap of the index's hashes as array<bigint>, and the bits of a cell number; its size follows n <= BLOCK."""
    bits = max(4, (16 * n).bit_length() - 6)
    rows = (
        index.select(F.expr(f"shiftrightunsigned(ih, {64 - bits})").alias("cell"), F.expr("shiftleft(1L, int(ih & 63))").alias("bit"))
        .groupBy("cell")
        .agg(F.bit_or("bit").alias("bit"))
        .collect()
    )
    cells = ["0"] * (1 << bits)
    for cell, bit in rows:
        cells[cell] = str(bit)
    return f"cast(split('{','.join(cells)}', ',') as array<bigint>)", bits


def _cut_out(m: int | str, k: int, left: int) -> str:
    """SQL for a function of p: the run of k words at p with up to left words around it."""
    a, b = f"greatest(0, p - {left})", f"least(n_words, p + {k + left})"
    return f"struct({m} as m, p as p, g[p] as h, slice(words, {a} + 1, {b} - {a}) as ctx, p - {a} as at)"


def _maybe(cells: tuple[str, int] | None) -> str:
    if cells is None:
        return ""
    return f"({cells[0]}[int(shiftrightunsigned(g[p], {64 - cells[1]}))] & shiftleft(1L, int(g[p] & 63))) <> 0"


def _prints(d: DataFrame, k: int, window: int, cells: tuple[str, int] | None = None) -> DataFrame:
    """Adds fps: array of (m, p, h, ctx, at) for kept k-grams, of those only that cells may hold; m is window.

    A position is kept if it is the rightmost least of some run of
    window - k + 1 k-grams; that is only looked into where cells has the hash.
    """
    span = window - k + 1
    d = d.withColumn("g", F.expr(f"if(n_words < {window}, cast(array() as array<bigint>), transform(sequence(0, n_words - {k}), i -> {_gram(k)}))"))
    kept = (
        f"exists(sequence(greatest(0, p - {span - 1}), least(p, size(g) - {span})), i -> "
        f"g[p] = array_min(slice(g, i + 1, {span})) and not array_contains(slice(g, p + 2, i + {span - 1} - p), g[p]))"
    )
    ok = " and ".join(x for x in (_maybe(cells), kept) if x)
    at = f"if(size(g) = 0, cast(array() as array<int>), filter(sequence(0, size(g) - 1), p -> {ok}))"
    return d.withColumn("at", F.expr(at)).withColumn("fps", F.expr(f"transform(at, p -> {_cut_out(window, k, window - k)})")).drop("at", "g")


def _grams(d: DataFrame, m: int, cells: tuple[str, int] | None = None, name: str = "fps") -> DataFrame:
    """Adds name: the same of every run of m words (for items of that length)."""
    d = d.withColumn("g", F.expr(f"if(n_words < {m}, cast(array() as array<bigint>), transform(sequence(0, n_words - {m}), i -> {_gram(m)}))"))
    at = "sequence(0, size(g) - 1)" if cells is None else f"filter(sequence(0, size(g) - 1), p -> {_maybe(cells)})"
    d = d.withColumn("at", F.expr(f"if(size(g) = 0, cast(array() as array<int>), {at})"))
    return d.withColumn(name, F.expr(f"transform(at, p -> {_cut_out(m, m, 0)})")).drop("at", "g")


def _worded(df: DataFrame) -> DataFrame:
    w = df.withColumn("words", words_of(F.col("text"))).drop("text")
    return w.withColumn("n_words", F.size("words")).withColumn("wh", F.expr("transform(words, w -> xxhash64(w))"))


def _index(items: DataFrame) -> DataFrame:
    """(im, ih, ictx, iat, ids): runs of the items with their surroundings, equal ones merged; ids are structs, for a null id to count."""
    return (
        items.select("item_id", F.explode(F.expr(_ALL)).alias("f"))
        .groupBy(F.col("f.m").alias("im"), F.col("f.h").alias("ih"), F.col("f.ctx").alias("ictx"), F.col("f.at").alias("iat"))
        .agg(F.collect_set(F.struct("item_id")).alias("ids"))
    )


def _meet(d: DataFrame, index: DataFrame, k: int, window: int, seed: bool, near: bool) -> DataFrame:
    """(rid, doc_id, n_words, lo, hi, ids): verified runs; a row of nulls for each document if seed."""
    left = window - k
    first = "array(struct(int(0) as m, int(-1) as p, bigint(null) as h, cast(array() as array<string>) as ctx, int(0) as at))"
    fps = F.expr(f"concat({first}, fps)") if seed else F.expr(_ALL)
    e = d.select("rid", "doc_id", "n_words", F.explode(fps).alias("f")).select("rid", "doc_id", "n_words", "f.*")
    rest = ["rid", "doc_id", "n_words", "m", "p", "ctx", "at", "ictx", "iat", "ids"]
    on = (F.col("h") == F.col("ih")) & (F.col("m") == F.col("im"))
    if near:
        j = e.join(F.broadcast(index), on, "left" if seed else "inner").select(*rest)
        j = j.where("p < 0 or ids is not null") if seed else j
    else:
        j = e.where("p >= 0").join(index, on).select(*rest)
        if seed:
            none = index.limit(0).select("ictx", "iat", "ids")
            j = j.unionByName(e.where("p < 0").drop("h").select("*", *[F.lit(None).cast(t).alias(c) for c, t in none.dtypes]))
    run_r = run_l = "0"
    for i in range(left, 0, -1):
        run_r = f"if(get(ctx, at + {k + i - 1}) = get(ictx, iat + {k + i - 1}), 1 + {run_r}, 0)"
        run_l = f"if(at >= {i} and iat >= {i} and get(ctx, at - {i}) = get(ictx, iat - {i}), 1 + {run_l}, 0)"
    long = f"if(slice(ctx, at + 1, {k}) = slice(ictx, iat + 1, {k}), struct(p - {run_l} as lo, p + {k} + {run_r} as hi), struct(0 as lo, 0 as hi))"
    short = "struct(p as lo, if(ctx = ictx, p + m, p) as hi)"
    j = j.select("rid", "doc_id", "n_words", "p", "m", "ids", F.expr(f"if(p < 0, null, if(m = {window}, {long}, {short}))").alias("run"))
    j = j.where("p < 0 or run.hi - run.lo >= m")
    return j.select("rid", "doc_id", "n_words", "run.lo", "run.hi", "ids")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, block: int = BLOCK, near: int = NEAR) -> DataFrame:
    """One row per row of docs: rid, doc_id, n_words, spans (hit word ranges, end exclusive, may overlap), n_hit, items (structs of item_id)."""
    it = cut(_worded(pick(items, "item_id", "text")).where("n_words > 0"))
    index = _index(_prints(it.where(F.col("n_words") >= window), k, window))
    sizes = sorted(r[0] for r in it.where(F.col("n_words") < window).select("n_words").distinct().collect())
    for m in sizes:
        index = index.unionByName(_index(_grams(it.where(F.col("n_words") == m), m)))
    index = cut(index)
    n = index.count()
    blocks = max(1, -(-n // block))
    d = pick(docs, "doc_id", "text").withColumn("rid", F.monotonically_increasing_id())
    if blocks > 1:  # every scan has to see the same rid
        d = cut(d)
    d = _worded(d)
    found = None
    for i in range(blocks):
        part = index if blocks == 1 else index.where(F.pmod(F.col("ih"), F.lit(blocks)) == i)
        size = part.count() if blocks > 1 else n
        cells = _cells(part, size)
        own = _prints(d, k, window, cells)
        for m in sizes:
            own = _grams(own, m, cells, f"fps{m}")
        own = own.withColumn("fps", F.expr(f"concat({', '.join(['fps', *[f'fps{m}' for m in sizes]])})"))
        m = _meet(own, part, k, window, seed=i == 0, near=size <= near)
        found = m if found is None else found.unionByName(m)
    # Runs that overlap are merged in the order of their starts; the hit words are what the merged runs cover.
    g = found.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").cast("long").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("lo").isNotNull(), F.struct("lo", "hi")))).alias("runs"),
        F.array_distinct(F.flatten(F.collect_set("ids"))).alias("items"),
    )
    reach = "aggregate(runs, struct(0 as e, 0 as n), (s, x) -> struct(greatest(s.e, x.hi) as e, s.n + greatest(0, x.hi - greatest(s.e, x.lo)) as n), s -> bigint(s.n))"
    return g.select("rid", "doc_id", "n_words", F.col("runs").alias("spans"), F.expr(reach).alias("n_hit"), "items")


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, near: int = 500_000) -> DataFrame:
    """The rows of docs without a hit, with doc_id, text, lang, source and n_chars only; rows of equal doc_id are told apart by their text."""
    d = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    sum_of = F.md5(F.coalesce("text", F.lit("")))
    hit = decontaminate(d.select(sum_of.alias("doc_id"), "text"), items, window, k)
    return without(d, sum_of, hit.where("n_hit > 0").select("doc_id"), near)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.expr("array_join(array_sort(transform(items, x -> string(x.item_id))), ',')")
    return r.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op8_decontaminate": op8_decontaminate}
_W = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
ORACLES = {
    "op8_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
b AS (SELECT item_id, {_W} AS w FROM benchmark),
bw AS (
  SELECT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, sizes WHERE len(w) >= m)
),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.m = bw.m),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, sha256(string_agg(s, ',' ORDER BY s)) AS h
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, coalesce(its.h, sha256('')) AS items_sha256,
       coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
}
