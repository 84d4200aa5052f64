"""Pairs of tuples that agree in two variables or more, found by words of bits.

Joins on two variables take every record to all partners of one of its values, which are hundreds of
millions of rows where names have many partners. Here tuples are cut into blocks; for each two blocks a
value of one side has a row of bits, one for each tuple of the other, and a tuple's rows, combined word by
word, leave the few pairs that agree in two variables. Every pair of tuples is looked at, 64 at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tuples of either side in a block; pairs that make a task worth while.
BLOCK_A, BLOCK_B, TASK_PAIRS = 65_536, 131_072, 1 << 28
#: Rows of tuples which go over to tasks at once, and blocks of B.
ROUND_ROWS, ROUND_BLOCKS = 8_000_000, 4
#: Tuples of B in a row of bits, and of A combined at once, so that they stay in the cache.
COLUMNS, ROWS = 4096, 1024
#: Words whose pairs are opened at once.
WORDS = 16_384
#: The code of null, below all codes and int values.
NULL = -(1 << 63)


class _Bits:
    """The agreement of one variable: rows of bits by values of A for some tuples of B."""

    def __init__(self, a: np.ndarray, b: np.ndarray, match: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> None:
        """``a`` and ``b`` are codes, ``NULL`` for null; ``match`` has codes and levels, None stands for equality."""
        values, self.of_a = np.unique(a, return_inverse=True)
        others, self.of_b = np.unique(b, return_inverse=True)
        self.n = len(values)
        if match is None:
            known = values[values != NULL]
            match = known, known, np.ones(len(known), np.int8)
        v, w, level = match
        x, y = np.minimum(np.searchsorted(values, v), len(values) - 1), np.minimum(np.searchsorted(others, w), len(others) - 1)
        here = np.flatnonzero((values[x] == v) & (others[y] == w))
        here = here[np.argsort(y[here], kind="stable")]
        self.x, self.level = x[here], level[here]
        self.starts = np.searchsorted(y[here], np.arange(len(others) + 1))

    def fill(self, begin: int, end: int) -> None:
        """Make the rows for the tuples from ``begin`` to ``end``; row 0 is that of values without a partner."""
        words = -(-(end - begin) // 64)
        of = self.of_b[begin:end]
        first, count = self.starts[of], self.starts[of + 1] - self.starts[of]
        column = np.repeat(np.arange(end - begin), count)
        at = np.arange(len(column)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        x, level = self.x[at], self.level[at]
        present = np.zeros(self.n, bool)
        present[x] = True
        row = np.cumsum(present) * present
        self.row = row[self.of_a]
        cell, bit = row[x] * words + column // 64, np.uint64(1) << (column % 64).astype(np.uint64)
        # a pair of a value and a tuple comes once, so that the sum of bits is their union
        self.any, self.two = (np.zeros((int(present.sum()) + 1) * words, np.uint64) for _ in range(2))
        np.add.at(self.any, cell, bit)
        upper = level == 2
        self.has_two = bool(upper.any())
        if self.has_two:
            np.add.at(self.two, cell[upper], bit[upper])
        self.any, self.two = self.any.reshape(-1, words), self.two.reshape(-1, words)


def agreeing(a: Sequence[np.ndarray], b: Sequence[np.ndarray], matches: Sequence, weights: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers in A and in B, and patterns, of all pairs that agree in two variables or more; each pair once."""
    if not len(a[0]) or not len(b[0]):
        return
    # equal values of the first variable together
    order = np.argsort(a[0], kind="stable")
    bits = [_Bits(x[order], y, m) for x, y, m in zip(a, b, matches)]
    for begin in range(0, len(b[0]), COLUMNS):
        end = min(begin + COLUMNS, len(b[0]))
        words = -(-(end - begin) // 64)
        for v in bits:
            v.fill(begin, end)
        both, either, twice = (np.empty((ROWS, words), np.uint64) for _ in range(3))
        taken, upper = ([np.empty((ROWS, words), np.uint64) for _ in bits] for _ in range(2))
        kept, n_kept = [], 0
        for top in range(0, len(order), ROWS):
            n = min(ROWS, len(order) - top)
            rows = [v.row[top : top + n] for v in bits]
            now = [np.take(v.any, r, axis=0, out=t[:n], mode="clip") for v, r, t in zip(bits, rows, taken)]
            some, more, common = either[:n], twice[:n], both[:n]
            some[:] = now[0]
            more[:] = 0
            for x in now[1:]:
                np.bitwise_and(some, x, out=common)
                np.bitwise_or(more, common, out=more)
                np.bitwise_or(some, x, out=some)
            at = np.flatnonzero(more)
            if len(at):
                # whole rows once more are less than single words from all over the table
                second = [np.take(v.two, r, axis=0, out=t[:n], mode="clip") if v.has_two else None for v, r, t in zip(bits, rows, upper)]
                kept.append((at + top * words, more.ravel()[at], *[None if x is None else x.ravel()[at] for x in (*now, *second)]))
                n_kept += len(at)
            if n_kept >= WORDS or (n_kept and top + n == len(order)):
                for i, j, pattern in _opened([None if x[0] is None else np.concatenate(x) for x in zip(*kept)], words, weights):
                    yield order[i], begin + j, pattern
                kept, n_kept = [], 0


def _opened(kept: list[np.ndarray | None], words: int, weights: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, column and pattern of each bit of some words: ``kept`` are their places, the bits, and the bits of each variable and level."""
    at, left, *levels = kept
    found = [(x, np.int32(weight)) for x, weight in zip(levels, [*weights, *weights]) if x is not None]
    i, word = np.divmod(at, words)
    while len(left):
        low = left & (~left + np.uint64(1))
        pattern = np.zeros(len(low), np.int32)
        for x, weight in found:
            pattern += ((x & low) != 0) * weight
        yield i, word * 64 + np.bitwise_count(low - np.uint64(1)), pattern
        left = left ^ low
        rest = np.flatnonzero(left)
        if len(rest) < len(left):
            left, i, word, found = left[rest], i[rest], word[rest], [(x[rest], weight) for x, weight in found]


def _read(batches: Iterator[pa.RecordBatch], n_fuzzy: int, size: int):  # noqa: ANN202
    """Tuples of both sides and value pairs from the rows of one task."""
    table = pa.Table.from_batches(list(batches)).combine_chunks()
    kind = table.column("kind").to_numpy()
    sides, matches = [], []
    for side in (0, 1):
        part = table.filter(pa.array(kind == side))
        sides.append((part.column("t").to_numpy(), part.column("n").to_numpy(), [part.column(f"c{k}").to_numpy() for k in range(size)]))
    for k in range(n_fuzzy):
        part = table.filter(pa.array(kind == 2 + k)).combine_chunks()
        v, w = part.column("t").to_numpy(), part.column("w")
        lists = w.chunk(0) if w.num_chunks else pa.array([], w.type)
        packed = lists.flatten().to_numpy()
        matches.append((np.repeat(v, np.asarray(lists.value_lengths(), np.int64)), packed // 2, (packed % 2 + 1).astype(np.int8)))
    return sides, matches + [None] * (size - n_fuzzy)


def _kernel(n_fuzzy: int, weights: Sequence[int], wanted: Sequence[int] | None):  # noqa: ANN202
    size = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [x for x in batches if x.num_rows]
        if not batches:
            return
        ((ta, na, a), (tb, nb, b)), matches = _read(batches, n_fuzzy, size)
        n_patterns = 1 + sum(w * (2 if k < n_fuzzy else 1) for k, w in enumerate(weights))
        alike = bool((na == 1).all() and (nb == 1).all())
        sums, chosen = np.zeros(n_patterns, np.int64), np.isin(np.arange(n_patterns), list(wanted or ()))
        kept, n_kept = [], 0
        for i, j, pattern in agreeing(a, b, matches, weights):
            if wanted is None:
                if alike:
                    sums += np.bincount(pattern, minlength=n_patterns)
                else:
                    np.add.at(sums, pattern, na[i] * nb[j])
                continue
            at = np.flatnonzero(chosen[pattern])
            if len(at):
                kept.append((ta[i[at]], tb[j[at]], pattern[at]))
                n_kept += len(at)
            if n_kept > 100_000:
                yield _rows(kept)
                kept, n_kept = [], 0
        if wanted is None:
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["pattern_id", "n"])
        elif kept:
            yield _rows(kept)

    return run


def _rows(kept: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    ta, tb, pattern = (np.concatenate(x) for x in zip(*kept))
    return pa.RecordBatch.from_arrays([pa.array(ta), pa.array(tb), pa.array(pattern.astype(np.int32))], ["ta", "tb", "pattern_id"])


def _cut(n_a: int, n_b: int, parallelism: int) -> tuple[int, int]:
    """Blocks of either side."""
    parts = [max(1, -(-n_a // BLOCK_A)), max(1, -(-n_b // BLOCK_B))]
    while parts[0] * parts[1] < 4 * parallelism and n_a * n_b > TASK_PAIRS * parts[0] * parts[1]:
        larger = int(n_b / parts[1] > n_a / parts[0])
        parts[larger] += 1
    return parts[0], parts[1]


def grid(a: DataFrame, b: DataFrame, matching: Sequence[DataFrame | None], weights: Sequence[int], sizes: tuple[int, int], wanted: Sequence[int] | None = None) -> list[DataFrame]:
    """Parts of ``pattern_id, n``: the record pairs of each pattern with two agreements or more; or of ``ta, tb, pattern_id`` of the wanted ones.

    ``a`` and ``b`` have ``t, n`` and codes ``x0, x1, ...``, null for what agrees with nothing;
    ``matching`` has ``v, w, level`` of the codes of each fuzzy variable, then None for each exact one.
    Each row of a task is a tuple of one of its two blocks or a value with its partners in the other. Each
    part has some blocks of B; run one after the other, they need room for the copies of these only.
    """
    parts_a, parts_b = _cut(*sizes, a.sparkSession.sparkContext.defaultParallelism)
    # for a block of B all tuples of A go over once, and its own to all blocks of A
    copied = sizes[0] + -(-sizes[1] // parts_b) * parts_a
    at_once = max(1, min(ROUND_BLOCKS, ROUND_ROWS // max(1, copied)))
    return [_part(a, b, matching, weights, parts_a, parts_b, begin, min(begin + at_once, parts_b), wanted) for begin in range(0, parts_b, at_once)]


def _part(a: DataFrame, b: DataFrame, matching: Sequence[DataFrame | None], weights: Sequence[int], parts_a: int, parts_b: int, begin: int, end: int, wanted: Sequence[int] | None) -> DataFrame:
    """The part with the blocks of B from ``begin`` to ``end``."""
    n_fuzzy, size = sum(m is not None for m in matching), len(weights)
    in_block = lambda parts: F.pmod(F.xxhash64("t"), F.lit(parts)).cast("int")
    codes = [F.coalesce(F.col(f"x{k}").cast("long"), F.lit(NULL)).alias(f"c{k}") for k in range(size)]
    useful = sum((F.col(f"x{k}").isNotNull().cast("int") for k in range(size)), F.lit(0)) >= 2
    blank = [F.lit(None).cast("long").alias(f"c{k}") for k in range(size)]
    each = lambda first, last: F.explode(F.sequence(F.lit(first), F.lit(last - 1)))
    task = (F.col("block_a") * (end - begin) + F.col("block_b") - begin).alias("task")
    nothing = F.lit(None).cast("array<bigint>").alias("w")
    left = a.where(useful).withColumn("block_a", in_block(parts_a))
    right = b.where(useful).withColumn("block_b", in_block(parts_b)).where((F.col("block_b") >= begin) & (F.col("block_b") < end))
    rows = [
        left.withColumn("block_b", each(begin, end)).select(task, F.lit(0).alias("kind"), "t", "n", *codes, nothing),
        right.withColumn("block_a", each(0, parts_a)).select(task, F.lit(1).alias("kind"), "t", "n", *codes, nothing)]
    for k in range(n_fuzzy):
        values = left.where(f"x{k} is not null").select("block_a", F.col(f"x{k}").alias("v")).distinct()
        # only partners in the block, of which there are as many as tuples at most
        here = right.where(f"x{k} is not null").select("block_b", F.col(f"x{k}").alias("w")).distinct()
        met = matching[k].select("v", "w", "level").join(F.broadcast(here), "w")
        # a partner's code and whether it is of the upper level, in one number
        partners = met.groupBy("v", "block_b").agg(F.collect_list(F.col("w") * 2 + F.col("level") - 1).alias("w"))
        rows.append(values.join(partners.hint("shuffle_hash"), "v").select(task, F.lit(2 + k).alias("kind"), F.col("v").alias("t"), F.lit(None).cast("long").alias("n"), *blank, "w"))
    spread = reduce(DataFrame.unionByName, rows).repartitionById(parts_a * (end - begin), F.col("task")).drop("task")
    return spread.mapInArrow(_kernel(n_fuzzy, weights, wanted), "pattern_id int, n long" if wanted is None else "ta long, tb long, pattern_id int")
