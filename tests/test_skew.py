from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkwright.operators.skew import annotate_groups, frequent_values, heavy_candidates, per_key, skew_join


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, "hot" if rng.random() < 0.4 else (None if rng.random() < 0.05 else f"k{rng.randrange(300)}"), rng.randrange(5)) for i in range(3000)]
    return data, spark.createDataFrame(data, "id long, k string, v int").repartition(5)


def test_per_key(rows):
    data, df = rows
    got = {r["k"]: (r["n"], r["s"], r["is_heavy"]) for r in per_key(df, "k", [F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")], 0.1).collect()}
    n, s = Counter(k for _, k, _ in data if k), Counter()
    for _, k, v in data:
        if k:
            s[k] += v
    assert {k: (x, y) for k, (x, y, _) in got.items()} == {k: (n[k], s[k]) for k in n}
    assert got["hot"][2] and len(got) == len(n)
    with pytest.raises(ValueError):
        per_key(df.withColumnRenamed("v", "is_heavy"), "k", [F.count("id")])


def test_frequent_values(spark, rows):
    data, df = rows
    got = {(r["field_name"], r["key_value"], r["n_rows"]) for r in frequent_values(df, ["k", "v"], 0.03).collect()}
    want = {("k", k, c) for k, c in Counter(k for _, k, _ in data if k).items() if c >= 90} | {("v", str(v), c) for v, c in Counter(v for *_, v in data).items() if c >= 90}
    assert got == want
    assert frequent_values(df.where("id < 0"), ["k"], 0.03).count() == 0
    assert heavy_candidates(spark.createDataFrame([(None,), (None,)], "k string"), ["k"], 0.1) == {"k": []}
    # exactly the share counts
    edge = spark.createDataFrame([(i % 100 if i >= 3 else 1000,) for i in range(100)], "k int")
    assert [r["key_value"] for r in frequent_values(edge, ["k"], 0.03).collect()] == ["1000"]


@pytest.mark.parametrize("most", [10_000, 0])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join(spark, rows, most, how):
    data, df = rows
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), (None, 5)], "k string, w int")
    key = lambda r: tuple(str(x) for x in r)
    got, want = skew_join(df, right, "k", how, 0.1, most), df.join(right, "k", how)
    assert sorted(map(key, got.select(*want.columns).collect())) == sorted(map(key, want.collect()))


def test_skew_join_refuses_clashes(rows):
    _, df = rows
    with pytest.raises(ValueError):
        skew_join(df, df, "k")


def test_annotate_groups(spark):
    data = [(i, "a" if i % 2 else f"b{i % 7}") for i in range(60)] + [(99, "single")]
    df = spark.createDataFrame(data, "id long, k string")
    for total in (61, 10**9):
        got = {(r["id"], r["group_rows"], r["m"]) for r in annotate_groups(df, ["k"], [F.min("id").alias("m")], total).collect()}
        n = Counter(k for _, k in data)
        assert got == {(i, n[k], min(j for j, x in data if x == k)) for i, k in data if n[k] > 1}


def test_skew_join_salts_what_is_too_large_to_broadcast(spark, rows):
    data, df = rows
    right = spark.createDataFrame([("hot", i) for i in range(7)] + [("k1", 8)], "k string, w int")
    got = skew_join(df, right, "k", min_share=0.1, max_broadcast_mb=0)
    plain = df.join(right, "k")
    assert sorted(map(tuple, got.select("id", "w").collect())) == sorted(map(tuple, plain.select("id", "w").collect()))


def test_annotate_heavy_groups(spark, monkeypatch):
    """Groups beyond the limit meet their aggregates by broadcast."""
    df = spark.range(130_000).select("id", F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id") % 1000).alias("k"))
    for by_hash in (False, True):
        got = annotate_groups(df, ["k"], [F.min("id").alias("m")], 130_000, by_hash=by_hash)
        assert got.agg(F.count("*"), F.countDistinct("k")).first()[:] == (130_000, 101)
        assert got.where("k = 1").agg(F.min("m"), F.max("m"), F.max("group_rows")).first()[:] == (0, 0, 117_000)


def test_shares_too_small_for_the_sketch(spark, rows):
    with pytest.raises(ValueError):
        heavy_candidates(rows[1], ["k"], 1e-6)
