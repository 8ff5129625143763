"""Secret scan: three fixed patterns and a character Markov model, in SQL functions only.

Each pattern's matches and the text between them are taken apart once per
pattern; a match ends where the lengths of all before it add up to.  Sums run
in chunks of CHUNK matches, so a text of very many matches stays cheap, and a
document's spans are made in its own row without a shuffle.

The model: transition counts between characters of random strings (labelled
positives: hexadecimal, base-64 and upper-case alphanumeric digests of
consecutive numbers) and of ordinary identifiers (labelled negatives: words
without digits of a bounded sample of documents, alone and joined in snake and camel case and as paths).
A run of at least ``MIN_RUN`` identifier characters that no fixed pattern
overlaps is a secret if its mean log-likelihood ratio exceeds the calibrated
threshold: half way between the means of both samples, or the negatives' mean
plus six of their deviations if that is higher, but never more than three
quarters of the way to the positives' mean.  Where the positives' mean is not
the higher one, no run is a secret.  Only the table of transitions (alphabet
squared) and four moments reach the driver.

Defined results: a null or empty text has no spans; very long texts are
scanned whole; runs shorter than ``MIN_RUN`` are never scored; a run whose
ratio equals the threshold is none; rows that repeat a doc_id are scanned as
rows of their own, a null doc_id is kept; an empty table gives an empty result
(the model then has no negatives but a uniform one); other columns are not
looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, parts, pick, release, table

#: Fixed values.
ASSIGN = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
MIN_VALUE = 8
MIN_ACCESS = 16
MIN_RUN = 20
RUN = rf"[A-Za-z0-9+/_-]{{{MIN_RUN},}}"
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
CHUNK = 256
FALSE_ALARMS = 0.001
MISSES = 0.01
SAMPLE_DOCS = 2000
SAMPLE_RANDOM = 3000


def _codes(tok: str) -> str:
    """SQL: a string to the places of its characters in ALPHABET, 0 for others."""
    return f"transform(split({tok}, ''), c -> locate(c, '{ALPHABET}'))"


def _pairs(df: DataFrame) -> DataFrame:
    """(pair, n): transition counts of the strings tok; a pair is first * width + second."""
    w = len(ALPHABET) + 1
    c = df.where("length(tok) > 1").select(F.expr(_codes("tok")).alias("c"))
    one = F.explode(F.expr(f"transform(sequence(0, size(c) - 2), i -> c[i] * {w} + c[i + 1])"))
    return c.select(one.alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def random_strings(spark: SparkSession, n: int = SAMPLE_RANDOM) -> DataFrame:
    d = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    b64 = "rtrim('=', base64(unhex(h)))"
    return d.select(F.expr(f"case id % 3 when 0 then substring(h, 1, 40) when 1 then substring({b64}, 1, 40) else upper(substring(regexp_replace({b64}, '[^A-Za-z0-9]', ''), 1, 24)) end").alias("tok"))


def ordinary_identifiers(docs: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """Words of about ``most`` documents, picked by hash of id and text, alone and joined as identifiers are."""
    rate = min(1.0, most / max(1, docs.count()))
    d = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(math.ceil(rate * 1_000_000)))
    # A bounded number of texts, dealt out, since a few files would keep a few cores busy.
    d = d.select("text").repartition(parts(docs.sparkSession))
    words = d.select(F.expr("filter(split(coalesce(text, ''), '[^A-Za-z0-9]+'), w -> length(w) > 1 and not w rlike '[0-9]')").alias("w"))
    joined = "concat_ws({}, x, get(w, i + 1), get(w, i + 2))"
    one = f"case i % 4 when 0 then {joined.format(chr(39) + '_' + chr(39))} when 1 then {joined.format(chr(39) + '/' + chr(39))} when 2 then {joined.format(chr(39) + '-' + chr(39))} else concat(x, initcap(coalesce(get(w, i + 1), '')), initcap(coalesce(get(w, i + 2), ''))) end"
    both = F.expr(f"concat(w, transform(w, (x, i) -> {one}))")
    return words.select(F.explode(both).alias("tok"))


def train(spark: SparkSession, docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict:
    """{'table': log-likelihood ratios by pair, 'threshold': mean ratio from which a run is random}."""
    w = len(ALPHABET) + 1
    ratio = [0.0] * (w * w)
    pos, neg = random_strings(spark), cut(ordinary_identifiers(docs, sample_docs))
    for sign, sample in ((1, pos), (-1, neg)):
        n = [0.5] * (w * w)
        for pair, count in _pairs(sample).collect():
            n[pair] += count
        for a in range(w):
            total = math.log(sum(n[a * w : (a + 1) * w]))
            for b in range(w):
                ratio[a * w + b] += sign * (math.log(n[a * w + b]) - total)
    model = {"table": ratio, "threshold": 0.0}

    def scores(df: DataFrame, share: float):
        m = df.where(f"length(tok) >= {MIN_RUN}").select(F.expr(score_sql("tok", model)).alias("s"))
        # To two places the scores are few, and the same whatever the order they come in.
        r = m.agg(F.avg("s"), F.percentile(F.round("s", 2), share)).first()
        return r[0] or 0.0, r[1] or 0.0

    (mp, low), (mn, high) = scores(pos, MISSES), scores(neg, 1 - FALSE_ALARMS)
    release(neg)
    model["threshold"] = min((low + high) / 2, low) if mp > mn else math.inf
    return model


def score_sql(tok: str, model: dict) -> str:
    """SQL for a string's mean log-likelihood ratio."""
    w = len(ALPHABET) + 1
    lit = "cast(split('" + ",".join(f"{x:.5f}" for x in model["table"]) + "', ',') as array<double>)"
    return (
        f"aggregate(transform(array({_codes(tok)}), c -> aggregate(sequence(0, size(c) - 2), 0D,"
        f" (s, i) -> s + {lit}[c[i] * {w} + c[i + 1]]) / (size(c) - 1)), 0D, (s, x) -> s + x)"
    )


def _ends(steps: str) -> str:
    """SQL for the running sums of an array of ints, a chunk at a time."""
    add = "(acc, x) -> concat(acc, array(element_at(acc, -1) + x))"
    chunk = f"slice({steps}, b * {CHUNK} + 1, {CHUNK})"
    chunks = f"sequence(0, (size({steps}) - 1) div {CHUNK})"
    base = f"aggregate(transform({chunks}, b -> aggregate({chunk}, 0, (s, x) -> s + x)), array(0), {add})"
    sums = f"flatten(transform(arrays_zip({chunks}, slice({base}, 1, size({chunks}))), z -> transform(array(z.`0`), b -> slice(aggregate({chunk}, array(z.`1`), {add}), 2, {CHUNK}))[0]))"
    return f"if(size({steps}) = 0, cast(array() as array<int>), {sums})"


def _spanned(d: DataFrame, k: int, pattern: str, ok: str, flags: str = "(?s)") -> DataFrame:
    """d with s<k>: array of (start, k, end) of a pattern's matches for which ok, SQL on the match m, holds."""
    own = (flags + pattern).replace("\\", "\\\\").replace("'", "\\'")
    d = d.withColumn("ms", F.expr(f"regexp_extract_all(body, '{own}', 0)"))
    d = d.withColumn("steps", F.expr(f"if(size(ms) = 0, cast(array() as array<int>), zip_with(ms, slice(split(body, '{own}'), 1, size(ms)), (m, g) -> char_length(m) + char_length(g)))"))
    d = d.withColumn("ends", F.expr(_ends("steps")))
    spans = f"transform(filter(arrays_zip(ms, ends), z -> exists(array(z.ms), m -> {ok.format(own=own)})), z -> struct(z.ends - char_length(z.ms) as start, {k} as k, z.ends as end))"
    return d.withColumn(f"s{k}", F.expr(spans)).drop("ms", "steps", "ends")


def find_secrets(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """One row per row of docs: doc_id, base and added, arrays of (start, k, end) by start; k indexes KINDS."""
    spark = docs.sparkSession
    d = pick(docs, "doc_id", "text")
    if model is None:
        model = train(spark, d)
    least = model["threshold"] if math.isfinite(model["threshold"]) else 1e300
    d = d.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    d = _spanned(d, 0, ASSIGN, f"char_length(regexp_extract(m, '{{own}}', 1)) >= {MIN_VALUE}", "(?si)")
    d = _spanned(d, 1, ACCESS, f"char_length(m) >= {MIN_ACCESS}")
    d = _spanned(d, 2, HEX, "true")
    d = _spanned(d, 3, RUN, f"{score_sql('m', model)} > {least}")
    d = d.select("doc_id", F.expr("sort_array(concat(s0, s1, s2))").alias("base"), F.col("s3").alias("runs"))
    apart = "if(size(base) = 0, runs, filter(runs, r -> not exists(base, b -> b.start < r.end and r.start < b.end)))"
    return d.select("doc_id", "base", F.expr(apart).alias("added"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = find_secrets(table(spark, sf_dir, "documents"))
    name = "element_at(array('assign', 'access', 'hex', 'random'), x.k + 1)"
    text = lambda c: F.expr(f"array_join(transform({c}, x -> concat_ws(':', {name}, string(x.start), string(x.end))), ',')")
    n = lambda k: F.expr(f"bigint(size(filter(base, x -> x.k = {k})))")
    return s.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.size("added").cast("long").alias("n_random"),
        F.sha2(text("base"), 256).alias("base_sha256"),
        text("sort_array(concat(base, added))").alias("spans"),
    )


QUERIES = {"op5_secrets": op5_secrets}
ORACLES: dict[str, str] = {}
