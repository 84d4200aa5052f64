"""The building blocks of a comparison, for pipelines of one's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwright.config import CompareConfig
from linkwright.operators.levels import distinct_levels, exact_levels, fuzzy_levels, value_levels
from linkwright.store import write


def jaro_winkler_pairs(a: DataFrame, b: DataFrame, column_a: str, column_b: str, cfg: CompareConfig = CompareConfig(), idx: str = "__idx") -> DataFrame:
    """``idx_a, idx_b, level`` of all record pairs of two tables that reach level 1 or 2."""
    return fuzzy_levels(a, b, column_a, column_b, cfg, idx)


def jaro_winkler_values(a: DataFrame, b: DataFrame, column_a: str, column_b: str, cfg: CompareConfig = CompareConfig()) -> DataFrame:
    """``v, w, level, similarity`` of the distinct values of two columns."""
    values = lambda df, c: df.where(df[c].isNotNull()).select(df[c].alias("v")).distinct()
    return value_levels(values(a, column_a), values(b, column_b), cfg)


def jaro_winkler_dedup(df: DataFrame, column: str, cfg: CompareConfig = CompareConfig(), idx: str = "__idx") -> DataFrame:
    """``idx_a, idx_b, level`` of the record pairs of one table, ``idx_a > idx_b``."""
    return fuzzy_levels(df, None, column, column, cfg, idx)


def exact_pairs(a: DataFrame, b: DataFrame, column_a: str, column_b: str, idx: str = "__idx") -> DataFrame:
    """``idx_a, idx_b, level`` of the record pairs of two tables with equal values."""
    return exact_levels(a, b, column_a, column_b, idx)


def exact_dedup(df: DataFrame, column: str, idx: str = "__idx") -> DataFrame:
    """``idx_a, idx_b, level`` of the record pairs of one table with equal values, ``idx_a > idx_b``."""
    return exact_levels(df, None, column, column, idx)


def jaro_winkler_pair_counts(a: DataFrame, b: DataFrame, column_a: str, column_b: str, cfg: CompareConfig = CompareConfig()) -> DataFrame:
    """``level, n_pairs``: how many record pairs of two tables reach each level, from the rows of each value."""
    rows = lambda df, c, v, n: df.where(df[c].isNotNull()).groupBy(df[c].alias(v)).agg(F.count(F.lit(1)).alias(n))
    met = distinct_levels(a, b, column_a, column_b, cfg).join(rows(a, column_a, "v", "n_v"), "v").join(rows(b, column_b, "w", "n_w"), "w")
    return met.groupBy("level").agg(F.sum(F.col("n_v").cast("decimal(38,0)") * F.col("n_w")).cast("long").alias("n_pairs"))


def jaro_winkler_dedup_sums(df: DataFrame, column: str, cfg: CompareConfig = CompareConfig(), idx: str = "__idx") -> DataFrame:
    """``level, n_pairs, sum_gap``: the record pairs of one table by level, and the sum of ``idx_a - idx_b``.

    No pair is made: the records of two values in one order have, before each, so many of the other
    value, with a sum of their numbers.
    """
    values = write(distinct_levels(df, None, column, column, cfg), "values").df
    rows = df.where(df[column].isNotNull()).select(df[column].alias("x"), F.col(idx).alias("i"))
    side = lambda pairs, at, n: pairs.join(rows, pairs[at] == rows["x"]).select("v", "w", "level", "i", F.lit(n).alias("side"))
    both = side(values, "v", 0).unionByName(side(values.where("v <> w"), "w", 1))
    before = Window.partitionBy("v", "w").orderBy("i").rangeBetween(Window.unboundedPreceding, -1)
    of = lambda s, x: F.coalesce(F.sum(F.when(F.col("side") == s, x).otherwise(F.lit(0))).over(before), F.lit(0))
    counted = both.select("level", "i", F.expr("v = w or side = 1").alias("first"), *[of(s, x).alias(f"{c}{s}") for s in (0, 1) for c, x in (("n", F.lit(1)), ("s", F.col("i").cast("decimal(20,0)")))])
    n, s = (F.when(F.col("first"), F.col(f"{c}0")).otherwise(F.col(f"{c}1")) for c in "ns")
    sums = counted.select("level", n.alias("n"), (F.col("i").cast("decimal(20,0)") * n.cast("decimal(18,0)") - s).cast("decimal(38,0)").alias("gap"))
    return sums.groupBy("level").agg(F.sum("n").alias("n_pairs"), F.sum("gap").cast("long").alias("sum_gap")).where("n_pairs > 0")
