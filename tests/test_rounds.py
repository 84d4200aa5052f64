"""Work that grows with the product of both tables is done in rounds, each of which moves little."""

from collections import Counter

import numpy as np
import pytest

from linkwright.config import CompareConfig
from linkwright.functions.jaro_winkler import similarity
from linkwright.operators import grid, levels
from linkwright.operators.compare import Comparison, Deduplication

NAMES = [f"{x}{y}{z}" for x in ("mar", "dwa", "smi", "jon") for y in ("tha", "hta", "yne", "th", "son") for z in ("ann", "berg", "")] + ["", None, "x"]


def _table(spark, n, seed):
    draw = np.random.default_rng(seed)
    pick = lambda: NAMES[int(draw.integers(0, len(NAMES)))]
    rows = [(i, pick(), pick(), None if draw.random() < 0.1 else int(draw.integers(0, 9))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "idx long, x string, y string, e int")


def _level(u, v, own):
    return 0 if u is None or v is None else 2 if own and u == v else sum(np.float32(similarity(u, v)) >= np.float32(t) for t in (0.88, 0.94))


@pytest.mark.parametrize("own", [False, True])
def test_values_in_rounds(spark, monkeypatch, own):
    monkeypatch.setattr(levels, "BLOCK_VALUES", 8)
    monkeypatch.setattr(levels, "ROUND_VALUES", 100)
    (ra, a), (rb, b) = _table(spark, 150, 1), _table(spark, 97, 2)
    numbered = [(v, 7 * i + 1, i % 3 + 1) for i, v in enumerate(x for x in NAMES if x is not None)]
    values = spark.createDataFrame(numbered, "v string, code long, n long")
    parts = levels.value_rounds(values, None if own else values, CompareConfig())
    assert len(parts) > 3
    want = Counter((cv, cw, level, nv * nw) for v, cv, nv in numbered for w, cw, nw in numbered if (level := _level(v, w, own)))
    assert Counter(tuple(r) for part in parts for r in part.collect()) == want
    # each meeting of blocks belongs to one round, and a round moves few of them
    made = Deduplication(a, ["x", "y"], ["e"], index="idx", compat=False).fit() if own else Comparison(a, b, ["x", "y"], ["x", "y"], ["e"], ["e"], index_a="idx", index_b="idx").fit()
    got = Counter()
    for r in ra:
        for s in ra if own else rb:
            if not own or r[0] > s[0]:
                got[_level(r[1], s[1], own) * 6 + _level(r[2], s[2], own) * 2 + int(r[3] is not None and r[3] == s[3])] += 1
    assert made.Counts.tolist() == [got[p] for p in range(18)]
    assert "_values" not in made.__dict__


def test_a_part_of_the_grid_copies_few_tuples(spark, monkeypatch):
    monkeypatch.setattr(grid, "_cut", lambda *_: (4, 6))
    moved, kernel = spark.sparkContext.accumulator(0), grid._kernel
    monkeypatch.setattr(grid, "ROUND_ROWS", 400)

    def counting(*args):
        run = kernel(*args)

        def counted(batches):
            batches = list(batches)
            moved.add(sum(int((x.column("kind").to_numpy() < 2).sum()) for x in batches))
            return run(iter(batches))

        return counted

    monkeypatch.setattr(grid, "_kernel", counting)
    (ra, a), (rb, b) = _table(spark, 150, 1), _table(spark, 97, 2)
    made = Comparison(a, b, ["x", "y"], ["x", "y"], ["e"], ["e"], index_a="idx", index_b="idx").fit()
    made.__dict__["_by_bits"] = True
    parts, total, most = made._grid(), 0, 0
    for part in parts:
        before = moved.value
        total += sum(r["n"] for r in part.collect())
        most = max(most, moved.value - before)
    assert (len(parts), 0 < most <= 400) == (6, True)
    agree = lambda r, s: sum((_level(r[1], s[1], False) > 0, _level(r[2], s[2], False) > 0, r[3] is not None and r[3] == s[3]))
    assert total == sum(agree(r, s) >= 2 for r in ra for s in rb)


def test_pairs_of_codes_take_little_room(spark):
    (_, a), (_, b) = _table(spark, 150, 1), _table(spark, 97, 2)
    made = Comparison(a, b, ["x", "y"], ["x", "y"], ["e"], ["e"], index_a="idx", index_b="idx").fit()
    kept = made._coded[2][0]
    assert dict(kept.dtypes) == {"v": "bigint", "w": "bigint", "level": "int", "n": "bigint"}
    assert all(".zstd." in f for f in kept.inputFiles()) and kept.inputFiles()
