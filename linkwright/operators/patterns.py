"""Agreement patterns: numbers, table, combination and counts.

A pattern is a mixed-radix number: the first variable's level is the slowest digit. Levels of one
variable exclude each other, hence a pair's pattern is the sum of its levels' weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.config import EXACT_LEVELS, FUZZY_LEVELS


def radices(n_fuzzy: int, n_exact: int) -> list[int]:
    """Levels of each variable, fuzzy ones first."""
    if n_fuzzy + n_exact == 0:
        raise ValueError("no variables are compared")
    return [FUZZY_LEVELS] * n_fuzzy + [EXACT_LEVELS] * n_exact


def strides(levels: Sequence[int]) -> list[int]:
    """The weight of each variable's level in the pattern number."""
    out = [1]
    for n in reversed(levels[1:]):
        out.insert(0, out[0] * n)
    return out


def n_patterns(n_fuzzy: int, n_exact: int) -> int:
    levels = radices(n_fuzzy, n_exact)
    return strides(levels)[0] * levels[0]


def gamma_table(spark: SparkSession, n_fuzzy: int, n_exact: int) -> DataFrame:
    """``pattern_id, gamma``: the levels that make up each pattern."""
    levels = radices(n_fuzzy, n_exact)
    pid = F.col("id")
    digits = [F.pmod(F.expr(f"id div {s}"), F.lit(n)).cast("int") for s, n in zip(strides(levels), levels)]
    return spark.range(n_patterns(n_fuzzy, n_exact)).select(pid.cast("int").alias("pattern_id"), F.array(*digits).alias("gamma"))


def combine(levels: Sequence[DataFrame], n_fuzzy: int, n_exact: int) -> DataFrame:
    """``idx_a, idx_b, pattern_id`` from each variable's ``idx_a, idx_b, level``: one union and one aggregation."""
    weights = strides(radices(n_fuzzy, n_exact))
    parts = [d.select("idx_a", "idx_b", (F.col("level") * w).alias("weight")) for d, w in zip(levels, weights, strict=True)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("idx_a", "idx_b").agg(F.sum("weight").cast("int").alias("pattern_id"))


def add_counts(*counts: DataFrame) -> DataFrame:
    """The sum of several tables of counts, as of blocks compared on their own."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("pattern_id").agg(F.sum("count").alias("count"))
