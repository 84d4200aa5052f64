"""Agreement levels of record pairs, one variable at a time.

Fuzzy levels are found between distinct values. These are packed into blocks, small ones whole and
large ones by classes of lengths; a block meets only blocks whose lengths can still reach the threshold, and
each such pair of blocks is one row for the vectorised kernel. Only value pairs of level 1 or 2
leave it, and they are expanded to records by joins on the values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.config import CompareConfig
from linkwright.functions.jaro_winkler import block_pairs, length_range
from linkwright.store import write

#: Distinct values in a block, and comparisons in a task.
BLOCK_VALUES, TASK_PAIRS = 8192, 32_000_000
#: Values which go over to tasks at once.
ROUND_VALUES = 8_000_000


_CODED = ("code", "n")


def _blocks(values: DataFrame, block_on: Sequence[str], side: str) -> DataFrame:
    """Values packed by block key: ``block_on, len, no, size, values``; ``len`` is a class of lengths, 0 for a block of any length.

    Their codes and numbers of rows are packed as ``code`` and ``n``, if there are any.
    """
    keys = list(block_on)
    counts = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"))
    # without keys there is one row of counts
    sized = values.join(counts, keys) if keys else values.join(F.broadcast(counts), F.lit(True))
    sized = sized.withColumn("len", F.when(F.col("n_values") <= BLOCK_VALUES, 0).otherwise(F.floor(4 * F.log2(F.length("v"))).cast("int") + 1))
    large = sized.where("len > 0").groupBy(*keys, "len").agg(F.count(F.lit(1)).alias("n_len"))
    parts = F.greatest(F.lit(1), F.ceil(F.coalesce("n_len", F.lit(0)) / BLOCK_VALUES))
    split = sized.join(large, [*keys, "len"], "left").withColumn("no", F.pmod(F.xxhash64("v"), parts).cast("int"))
    more = [c for c in _CODED if c in values.columns]
    packed = split.groupBy(*keys, "len", "no").agg(F.collect_list(F.struct("v", *more)).alias("x"))
    packed = packed.select(*keys, "len", "no", F.col("x.v").alias("values"), F.size("x").cast("long").alias("size"), *[F.col(f"x.{c}").alias(c) for c in more])
    return packed.withColumnsRenamed({c: f"{c}_{side}" for c in ("len", "no", "values", "size", *more)})


def _bounds(n: int) -> tuple[int, int]:
    """The least and the greatest length of a class, or a little beyond."""
    return max(1, math.floor(2 ** ((n - 1) / 4))), math.ceil(2 ** (n / 4))


def value_levels(left: DataFrame, right: DataFrame | None, cfg: CompareConfig, block_on: Sequence[str] = ()) -> DataFrame:
    """``block_on, v, w, level, similarity``: pairs of distinct values that reach level 1 or 2.

    ``left`` and ``right`` have ``block_on, v``, distinct and not null. Without ``right`` the values
    of ``left`` are compared with each other: each pair once, ``v > w``, and every value with itself
    at similarity 1.
    """
    return reduce(DataFrame.unionByName, value_rounds(left, right, cfg, block_on))


def value_rounds(left: DataFrame, right: DataFrame | None, cfg: CompareConfig, block_on: Sequence[str] = ()) -> list[DataFrame]:
    """The same in parts, each with some meetings of blocks.

    A block goes over to all that it meets, so that what is moved grows with the product of both sides;
    parts written one after the other need room for ``ROUND_VALUES`` values only. If ``left`` and
    ``right`` have ``code, n``, the parts are ``block_on, v, w, level, n``: codes for values, and
    products of ``n``; without ``right`` in both orders, each value with itself once.
    """
    spark = left.sparkSession
    own, coded = right is None, "code" in left.columns
    more = _CODED if coded else ()
    a = write(_blocks(left.where("length(v) > 0"), block_on, "a"), "packed").df
    b = a.withColumnsRenamed({f"{c}_a": f"{c}_b" for c in ("len", "no", "values", "size", *more)}) if own else write(_blocks(right.where("length(v) > 0"), block_on, "b"), "packed").df
    keys = lambda s: [*block_on, f"len_{s}", f"no_{s}", f"size_{s}"]
    # the classes are at most as many as the longest value has characters
    lengths = lambda df, s: [r[0] for r in df.select(f"len_{s}").distinct().collect()]
    of_b = lengths(b, "b")
    fits = []
    for n in lengths(a, "a"):
        low, high = length_range(_bounds(n)[0], cfg.lower, cfg.p)[0], length_range(_bounds(n)[1], cfg.lower, cfg.p)[1]
        fits += [(n, m) for m in of_b if not n or not m or (low <= _bounds(m)[1] and (high is None or _bounds(m)[0] <= high))]
    pairs = spark.createDataFrame(fits, "len_a int, len_b int")
    # numbers of blocks meet first, the lists come later
    met = a.select(*keys("a")).join(F.broadcast(pairs), "len_a").join(b.select(*keys("b")), [*block_on, "len_b"])
    if own:
        met = met.where("len_a > len_b or (len_a = len_b and no_a >= no_b)")
    met = met.withColumn("same", (F.col("len_a") == F.col("len_b")) & (F.col("no_a") == F.col("no_b")))
    met = write(met.withColumn("h", F.xxhash64(*block_on, "len_a", "no_a", "len_b", "no_b")), "meetings").df
    work, moved = met.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in (F.col("size_a") * F.col("size_b"), F.col("size_a") + F.col("size_b"))]).first()
    rounds = max(1, -(-moved // ROUND_VALUES))
    tasks = max(4 * spark.sparkContext.defaultParallelism, work // rounds // TASK_PAIRS)
    packed = [f"{c}_{s}" for c in more for s in "ab"]
    lists = lambda df, s: df.select(*block_on, f"len_{s}", f"no_{s}", f"values_{s}", *[f"{c}_{s}" for c in more])
    at = lambda s: [*block_on, f"len_{s}", f"no_{s}"]
    schema = ", ".join([*(f"`{c}` {left.schema[c].dataType.simpleString()}" for c in block_on), "v long, w long, level int, n long" if coded else "v string, w string, level int, similarity float"])
    parts = []
    for r in range(rounds):
        full = met.where(F.pmod("h", F.lit(rounds)) == r).join(lists(a, "a"), at("a")).join(lists(b, "b"), at("b"))
        # the rows are few and heavy: spread them over all tasks, by what they are
        spread = full.select(*block_on, "values_a", "values_b", "same", *packed, "h").repartition(tasks, "h").drop("h")
        parts.append(spread.mapInArrow(_kernel(cfg, own, len(block_on)), schema))
    if own:
        v = F.col("code" if coded else "v")
        last = (F.col("n") * F.col("n")).alias("n") if coded else F.lit(1.0).cast("float").alias("similarity")
        parts[-1] = parts[-1].unionByName(left.select(*block_on, v.alias("v"), v.alias("w"), F.lit(2).alias("level"), last))
    return parts


def _kernel(cfg: CompareConfig, own: bool, n_keys: int):  # noqa: ANN202
    lower, upper, p, compat = cfg.lower, cfg.upper, cfg.p, cfg.compat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for row in range(batch.num_rows):
                xs, ys, same = (batch.column(n_keys + i)[row].as_py() for i in range(3))
                i, j, score = block_pairs(xs, ys, p, lower)
                if not own and not compat:
                    one = {y: at for at, y in enumerate(ys) if len(y) == 1}
                    both = np.array([(at, one[x]) for at, x in enumerate(xs) if x in one], np.int64).reshape(-1, 2)
                    i, j, score = np.append(i, both[:, 0]), np.append(j, both[:, 1]), np.append(score, np.ones(len(both), np.float32))
                if own:
                    # each pair once, the greater value first
                    v, w = np.array(xs, object)[i], np.array(ys, object)[j]
                    keep = (v > w if same else v != w).astype(bool)
                    i, j, score = i[keep], j[keep], score[keep]
                level = (score >= np.float32(lower)).astype(np.int32) + (score >= np.float32(upper)).astype(np.int32)
                if len(names) > n_keys + 3:
                    va, vb, na, nb = (batch.column(n_keys + 3 + c)[row].values.to_numpy() for c in range(4))
                    v, w, last, name = va[i], vb[j], na[i] * nb[j], "n"
                    if own:
                        v, w, level, last = np.append(v, w), np.append(w, v), np.append(level, level), np.append(last, last)
                    v, w = pa.array(v), pa.array(w)
                else:
                    v, w, last, name = np.array(xs, object)[i], np.array(ys, object)[j], score.astype(np.float32), "similarity"
                    if own:
                        flip = (v < w).astype(bool)
                        v, w = np.where(flip, w, v), np.where(flip, v, w)
                    v, w = pa.array(v.tolist(), pa.string()), pa.array(w.tolist(), pa.string())
                keys = [pa.array([batch.column(c)[row].as_py()] * len(v), batch.schema.field(c).type) for c in range(n_keys)]
                yield pa.RecordBatch.from_arrays([*keys, v, w, pa.array(level), pa.array(last)], [*names[:n_keys], "v", "w", "level", name])

    return run


def _rows(df: DataFrame, idx: str, column: str, block_on: Sequence[str], names: tuple[str, str]) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(F.col(idx).alias(names[0]), F.col(column).alias(names[1]), *block_on)


def fuzzy_levels(a: DataFrame, b: DataFrame | None, column_a: str, column_b: str, cfg: CompareConfig, idx: str = "__idx", block_on: Sequence[str] = (), values: DataFrame | None = None) -> DataFrame:
    """``idx_a, idx_b, level``: record pairs whose values reach level 1 or 2; nulls reach none.

    Without ``b`` the pairs of ``a`` with ``idx_a > idx_b``; equal values, also empty ones, are then
    of level 2. Between tables an empty string reaches no level. ``values`` are the value pairs, if
    they are known already.
    """
    left = _rows(a, idx, column_a, block_on, ("idx_a", "v"))
    right = _rows(a if b is None else b, idx, column_b, block_on, ("idx_b", "w"))
    if values is None:
        values = distinct_levels(a, b, column_a, column_b, cfg, block_on)
    pairs = values.join(left, [*block_on, "v"]).join(right, [*block_on, "w"])
    if b is not None:
        return pairs.select("idx_a", "idx_b", "level")
    within = pairs.where("v = w and idx_a > idx_b")
    across = pairs.where("v <> w").withColumns({"idx_a": F.greatest("idx_a", "idx_b"), "idx_b": F.least("idx_a", "idx_b")})
    return within.unionByName(across).select("idx_a", "idx_b", "level")


def distinct_levels(a: DataFrame, b: DataFrame | None, column_a: str, column_b: str, cfg: CompareConfig, block_on: Sequence[str] = ()) -> DataFrame:
    """``block_on, v, w, level`` of the distinct values of two columns, or of one column with itself."""
    values = lambda df, c: df.where(F.col(c).isNotNull()).select(*block_on, F.col(c).alias("v")).distinct()
    return value_levels(values(a, column_a), None if b is None else values(b, column_b), cfg, block_on).drop("similarity")


def exact_levels(a: DataFrame, b: DataFrame | None, column_a: str, column_b: str, idx: str = "__idx", block_on: Sequence[str] = ()) -> DataFrame:
    """``idx_a, idx_b, level``: record pairs with equal values, at level 1; null equals nothing, NaN itself."""
    left = _rows(a, idx, column_a, block_on, ("idx_a", "v"))
    right = _rows(a if b is None else b, idx, column_b, block_on, ("idx_b", "v"))
    pairs = left.join(right, [*block_on, "v"])
    if b is None:
        pairs = pairs.where("idx_a > idx_b")
    return pairs.select("idx_a", "idx_b", F.lit(1).alias("level"))
