"""Registered queries against plain Python over whole tables."""

from collections import Counter, defaultdict

from graphloom.plans import catalog

SF = "/root/testdata/sf0.001"


def test_clip_features_takes_all_columns(spark):
    got = {(r.i, r.j): r.v for r in catalog.QUERIES["clip_features"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    assert got == {(r.vec_id, j): min(max(float(v), -0.1), 0.1) for r in rows for j, v in enumerate(r.embedding)}


def test_toposort_levels_counts_every_level(spark):
    chains = defaultdict(int)
    for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").collect():
        chains[r.o_custkey] += 1
    want = Counter(level for n in chains.values() if n > 1 for level in range(n))
    got = {r.level: r.vertices for r in catalog.QUERIES["toposort_levels"](spark, SF).collect()}
    assert max(want) > 3 and got == dict(want)
