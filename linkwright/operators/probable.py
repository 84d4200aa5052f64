"""Pairs of tuples with wanted patterns, without comparing all values of every variable.

Where each wanted pattern agrees in two or more of a few variables with few distinct values, only the values of
these are compared all with all. Pairs that agree in two of them are found by words of bits; the strings of
the other variables are compared for these pairs only, as long as a wanted pattern is possible.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.config import CompareConfig
from linkwright.functions.jaro_winkler import Sketches, pair_levels
from linkwright.operators.grid import NULL, TASK_PAIRS, agreeing
from linkwright.store import write

#: Tuples of either side in a block; pairs whose strings are compared at once; rows that make a task worth while.
BLOCK, AT_ONCE, TASK_ROWS = 65_536, 2_000_000, 100_000


def _kernel(coded: Sequence[int], fuzzy: Sequence[int], compared: Sequence[int], weights: Sequence[int], wanted: Sequence[int], radix: Sequence[int], cfg: CompareConfig):  # noqa: ANN202
    size = weights[0] * radix[0]

    def possible(known: Sequence[int]) -> np.ndarray:
        """Whether a sum of the weights of some variables' levels is part of a wanted pattern."""
        out = np.zeros(size, bool)
        for p in wanted:
            out[sum(p // weights[k] % radix[k] * weights[k] for k in known)] = True
        return out

    # whether a wanted pattern with these levels of the coded variables does without the variable
    free = {k: np.zeros(size, bool) for k in compared}
    for p in wanted:
        for k in compared:
            if not p // weights[k] % radix[k]:
                free[k][sum(p // weights[c] % radix[c] * weights[c] for c in coded)] = True

    def judged(found: list, a: pa.Table, b: pa.Table, texts: dict) -> Iterator[pa.RecordBatch]:
        i, j, pattern = (np.concatenate(x) for x in zip(*found))
        known = list(coded)
        for k in compared:
            if not len(i):
                return
            (xs, of_x), (ys, of_y) = texts[k]
            pattern = pattern + pair_levels(xs, ys, of_x[i], of_y[j], cfg.p, cfg.lower, cfg.upper) * weights[k]
            known.append(k)
            at = np.flatnonzero(possible(known)[pattern])
            i, j, pattern = i[at], j[at], pattern[at]
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(a.column("t").to_numpy()[i]), pa.array(b.column("t").to_numpy()[j]), pa.array(pattern.astype(np.int32))], ["ta", "tb", "pattern_id"])

    def group(table: pa.Table) -> Iterator[pa.RecordBatch]:
        kind = table.column("kind").to_numpy()
        a, b = (table.filter(pa.array(kind == side)).combine_chunks() for side in (0, 1))
        if not a.num_rows or not b.num_rows:
            return
        matches = []
        for k in coded:
            if k not in fuzzy:
                matches.append(None)
                continue
            part = table.filter(pa.array(kind == 2 + k)).combine_chunks()
            lists = part.column("w").chunk(0) if part.num_rows else pa.array([], pa.list_(pa.int64()))
            packed = lists.flatten().to_numpy()
            matches.append((np.repeat(part.column("t").to_numpy(), np.asarray(lists.value_lengths(), np.int64)), packed // 2, (packed % 2 + 1).astype(np.int8)))
        codes = [[t.column(f"c{k}").to_numpy() for k in coded] for t in (a, b)]
        first, found, n = possible(coded), [], 0
        texts = {k: (_texts(a.column(f"s{k}")), _texts(b.column(f"s{k}"))) for k in compared}
        sketches = {k: Sketches(xs, ys, cfg.p, cfg.lower).of(of_x, of_y) for k, ((xs, of_x), (ys, of_y)) in texts.items()}
        for i, j, pattern in agreeing(*codes, matches, [weights[k] for k in coded]):
            at = np.flatnonzero(first[pattern])
            for k in compared:
                at = at[free[k][pattern[at]] | sketches[k].near(i[at], j[at])]
            if len(at):
                found.append((i[at], j[at], pattern[at]))
                n += len(at)
            if n >= AT_ONCE:
                yield from judged(found, a, b, texts)
                found, n = [], 0
        if n:
            yield from judged(found, a, b, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [x for x in batches if x.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        at = [table.column(c).to_numpy() for c in ("no", "ba", "bb")]
        order = np.lexsort(at[::-1])
        changed = reduce(np.logical_or, [np.diff(x[order]) != 0 for x in at])
        edges = [0, *(np.flatnonzero(changed) + 1).tolist(), len(order)]
        for begin, end in zip(edges, edges[1:]):
            yield from group(table.take(pa.array(order[begin:end])))

    return run


def _texts(column: pa.ChunkedArray) -> tuple[list[str], np.ndarray]:
    """Distinct strings, an empty one for null, and the number of each row's."""
    encoded = column.combine_chunks().fill_null("").dictionary_encode()
    encoded = encoded.chunk(0) if isinstance(encoded, pa.ChunkedArray) else encoded
    return encoded.dictionary.to_pylist(), encoded.indices.to_numpy().astype(np.int64)


def probable(a: DataFrame, b: DataFrame, matching: Sequence[DataFrame | None], coded: Sequence[int], weights: Sequence[int], radix: Sequence[int], wanted: Sequence[int], cfg: CompareConfig, block_on: Sequence[str] = ()) -> DataFrame:
    """``ta, tb, pattern_id`` of the pairs within ``block_on`` that have a wanted pattern.

    ``a`` and ``b`` have ``block_on, t, x0, x1, ...``: codes for the variables in ``coded``, strings for the
    others. ``matching`` has ``v, w, level`` of the codes of each fuzzy one of these, None for the exact ones.
    """
    parallelism, keys = a.sparkSession.sparkContext.defaultParallelism, list(block_on)
    fuzzy = [k for k in coded if matching[k] is not None]
    compared = [k for k in range(len(weights)) if k not in coded]
    sizes = lambda t, n: t.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    n_a, n_b = sizes(a, "n_a"), sizes(b, "n_b")
    both = n_a.join(n_b, keys) if keys else n_a.join(F.broadcast(n_b), F.lit(True))
    # so many tasks that all cores have work, if there is enough
    total = both.agg(F.sum(F.col("n_a").cast("double") * F.col("n_b")).alias("pairs"), F.sum("n_a").alias("a"), F.sum("n_b").alias("b")).first()
    share = max(TASK_PAIRS, (total["pairs"] or 0) / (4 * parallelism))
    parts = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(n) / share**0.5)).cast("int")
    cuts = write(both.select(*keys, parts("n_a").alias("parts_a"), parts("n_b").alias("parts_b")).withColumn("no", F.monotonically_increasing_id()), "cuts").df
    codes = [F.coalesce(F.col(f"x{k}").cast("long"), F.lit(NULL)).alias(f"c{k}") for k in coded]
    blank = [F.lit(None).cast("long").alias(f"c{k}") for k in coded] + [F.lit(None).cast("string").alias(f"s{k}") for k in compared]
    texts, nothing = [F.col(f"x{k}").alias(f"s{k}") for k in compared], F.lit(None).cast("array<bigint>").alias("w")
    useful = sum((F.col(f"x{k}").isNotNull().cast("int") for k in coded), F.lit(0)) >= 2
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def side(t: DataFrame, own: str, block: str) -> DataFrame:
        met = t.where(useful).join(cuts, keys) if keys else t.where(useful).join(F.broadcast(cuts), F.lit(True))
        return met.withColumn(block, F.pmod(F.xxhash64("t"), F.col(own)).cast("int"))

    left, right = side(a, "parts_a", "ba"), side(b, "parts_b", "bb")
    rows = [
        left.withColumn("bb", each("parts_b")).select("no", "ba", "bb", F.lit(0).alias("kind"), "t", *codes, *texts, nothing),
        right.withColumn("ba", each("parts_a")).select("no", "ba", "bb", F.lit(1).alias("kind"), "t", *codes, *texts, nothing)]
    for k in fuzzy:
        values = left.where(f"x{k} is not null").select("no", "ba", "parts_b", F.col(f"x{k}").alias("v")).distinct()
        # a partner's code and whether it is of the upper level, in one number
        partners = matching[k].groupBy("v").agg(F.collect_list(F.col("w") * 2 + F.col("level") - 1).alias("w"))
        rows.append(values.join(partners.hint("shuffle_hash"), "v").withColumn("bb", each("parts_b")).select("no", "ba", "bb", F.lit(2 + k).alias("kind"), F.col("v").alias("t"), *blank, "w"))
    tasks = max(8 * parallelism, int((total["a"] or 0) + (total["b"] or 0)) // TASK_ROWS)
    spread = reduce(DataFrame.unionByName, rows).repartition(tasks, "no", "ba", "bb")
    return spread.mapInArrow(_kernel(list(coded), fuzzy, compared, list(weights), list(wanted), list(radix), cfg), "ta long, tb long, pattern_id int")
