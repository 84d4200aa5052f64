from __future__ import annotations

import random

from pyspark.sql import functions as F

from linkwright.functions import pairs as blocks


def _named(spark, n, words, seed):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.choice(words)) for i in range(n)], "__idx long, name string")


def test_counts_of_pairs_of_two_tables(spark):
    words = ["", "a", "smith", "smyth", "smithe", "garcia", None]
    a, b = _named(spark, 60, words, 1), _named(spark, 40, words, 2)
    want = {tuple(r) for r in blocks.jaro_winkler_pairs(a, b, "name", "name").groupBy("level").count().collect()}
    assert {tuple(r) for r in blocks.jaro_winkler_pair_counts(a, b, "name", "name").collect()} == want
    # ten thousand million pairs, more than can be made here
    many = spark.range(100_000).select(F.col("id").alias("__idx"), F.lit("smith").alias("name"))
    assert [tuple(r) for r in blocks.jaro_winkler_pair_counts(many, many, "name", "name").collect()] == [(2, 10**10)]


def test_sums_of_pairs_of_one_table(spark):
    df = _named(spark, 80, ["", "a", "smith", "smyth", "smithe", "garcia", None], 3)
    want = blocks.jaro_winkler_dedup(df, "name").groupBy("level").agg(F.count(F.lit(1)), F.sum(F.col("idx_a") - F.col("idx_b")))
    assert {tuple(r) for r in blocks.jaro_winkler_dedup_sums(df, "name").collect()} == {tuple(r) for r in want.collect()}
    many = spark.range(100_000).select(F.col("id").alias("__idx"), F.lit("smith").alias("name"))
    assert [tuple(r) for r in blocks.jaro_winkler_dedup_sums(many, "name").collect()] == [(2, 100_000 * 99_999 // 2, (100_000**3 - 100_000) // 6)]
    # nobody is left alone as a level without pairs
    assert blocks.jaro_winkler_dedup_sums(many.where("__idx = 0"), "name").count() == 0
