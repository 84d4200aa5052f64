"""Pairs found by words of bits, against pairs compared one by one."""

from collections import Counter

import numpy as np
import pytest

from linkwright.functions.jaro_winkler import similarity
from linkwright.operators import grid
from linkwright.operators.compare import Comparison, Deduplication

NAMES = [f"{x}{y}{z}" for x in ("mar", "dwa", "smi", "jon") for y in ("tha", "hta", "yne", "th", "son") for z in ("ann", "berg", "")] + ["", None, "x"]


def _table(spark, n, seed):
    draw = np.random.default_rng(seed)
    pick = lambda: NAMES[int(draw.integers(0, len(NAMES)))]
    # some records come twice
    rows = [(pick(), pick(), pick(), None if draw.random() < 0.1 else int(draw.integers(-40, 40))) for _ in range(n)]
    rows = [(i, *rows[i if i % 7 else 0]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "idx long, x string, y string, z string, e int")


def _levels(r, s, own):
    level = lambda u, v: 0 if u is None or v is None else 2 if own and u == v else sum(np.float32(similarity(u, v)) >= np.float32(t) for t in (0.88, 0.94))
    return tuple(int(level(u, v)) for u, v in zip(r[1:4], s[1:4])) + (int(r[4] is not None and r[4] == s[4]),)


@pytest.mark.parametrize("own", [False, True])
def test_counts_and_links_by_bits(spark, monkeypatch, own):
    # several blocks of either side, several rows of bits, and a last word that is not full
    monkeypatch.setattr(grid, "_cut", lambda *_: (2, 3))
    (ra, a), (rb, b) = _table(spark, 150, 1), _table(spark, 97, 2)
    names = ["x", "y", "z"]
    made = Deduplication(a, names, ["e"], index="idx", compat=False).fit() if own else Comparison(a, b, names, names, ["e"], ["e"], index_a="idx", index_b="idx").fit()
    # whether it pays is another question
    made.__dict__["_by_bits"] = True
    pairs = {(r[0], s[0]): _levels(r, s, own) for r in ra for s in (ra if own else rb) if not own or r[0] > s[0]}
    number = lambda at: at[0] * 18 + at[1] * 6 + at[2] * 2 + at[3]
    want = Counter(map(number, pairs.values()))
    assert made.Counts.tolist() == [want[p] for p in range(54)]
    likely = [p for p in range(54) if sum(d > 0 for d in (p // 18, p // 6 % 3, p // 2 % 3, p % 2)) >= 2 and p % 5]
    assert {tuple(r) for r in made.chosen(likely).collect()} == {(*ij, number(at)) for ij, at in pairs.items() if number(at) in likely}


def test_voters_are_compared_by_bits_and_dense_tables_by_joins(spark):
    draw = np.random.default_rng(3)
    many = [(i, f"{draw.integers(0, 10**6):06d}", int(draw.integers(0, 50))) for i in range(300)]
    sparse = spark.createDataFrame(many, "idx long, x string, e int")
    assert Comparison(sparse, sparse, ["x"], ["x"], ["e"], ["e"], index_a="idx", index_b="idx").fit()._by_bits
    dense = spark.createDataFrame([(i, "ab"[i % 2], i % 3) for i in range(300)], "idx long, x string, e int")
    assert not Deduplication(dense, ["x"], ["e"], index="idx").fit()._by_bits
    assert not Comparison(sparse, sparse, ["x"], ["x"], ["e"], ["e"], block_on=["e"], index_a="idx", index_b="idx").fit()._by_bits
