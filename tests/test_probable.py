"""Pairs of wanted patterns without comparing all values."""

import random

import numpy as np
import pytest

from linkwright.functions.jaro_winkler import Sketches, pair_levels, similarity
from linkwright.operators import probable
from linkwright.operators.compare import Comparison

RNG = random.Random(5)
LETTERS = "abcdeo\u00e9"


def _word(low, high):
    return "".join(RNG.choice(LETTERS) for _ in range(RNG.randint(low, high)))


def _slip(w):
    at = RNG.randrange(len(w) + 1)
    return w[:at] + RNG.choice(LETTERS) + w[at + 1 :]


def test_levels_of_single_pairs():
    xs = [_word(0, 9) for _ in range(60)] + ["x" * 70, "", "a"]
    ys = [_slip(x) for x in xs[:40]] + [_word(0, 9) for _ in range(60)] + ["x" * 70, "x" * 69, "", "a"]
    for n in (2000, 10):
        x, y = np.array([RNG.randrange(len(xs)) for _ in range(n)]), np.array([RNG.randrange(len(ys)) for _ in range(n)])
        score = [np.float32(similarity(xs[i], ys[j], 0.1)) for i, j in zip(x, y)]
        assert pair_levels(xs, ys, x, y, 0.1, 0.88, 0.94).tolist() == [int(s >= np.float32(0.88)) + int(s >= np.float32(0.94)) for s in score]


def test_sketches_keep_all_pairs_that_reach_the_threshold():
    xs = [_word(0, 9) for _ in range(80)] + ["x" * 70, "zzz"]
    ys = [_slip(x) for x in xs] + [_word(0, 9) for _ in range(80)] + ["x" * 69]
    near = Sketches(xs, ys, 0.1, 0.88).near(*(v.ravel() for v in np.indices((len(xs), len(ys))))).reshape(len(xs), len(ys))
    reach = np.array([[similarity(x, y, 0.1) >= 0.88 for y in ys] for x in xs])
    assert not (reach & ~near).any()
    assert near.mean() < 0.5


@pytest.mark.parametrize("block", [[], ["year"]])
def test_values_of_long_columns_are_not_all_compared(spark, monkeypatch, block):
    monkeypatch.setattr(probable, "BLOCK", 64)
    monkeypatch.setattr(probable, "AT_ONCE", 50)
    people = [(_word(7, 12), _word(6, 9), str(RNG.randrange(100, 999)), RNG.choice([None, *range(1950, 1956)])) for _ in range(150)]
    near = lambda v: RNG.choice([v, v, _slip(v), None])
    rows = lambda: [(i, near(n), near(f), near(h), RNG.choice([y, y, y, 1950])) for i, (n, f, h, y) in enumerate(people)]
    a, b = (spark.createDataFrame(rows(), "idx long, name string, given string, house string, year int") for _ in range(2))
    names = ["name", "given", "house"]
    made = lambda: Comparison(a, b, names, names, ["year"], ["year"], block_on=block, index_a="idx", index_b="idx").fit()
    # all that agree in three variables or more
    wanted = [p for p in range(54) if sum(x > 0 for x in (p // 18, p // 6 % 3, p // 2 % 3, p % 2)) >= 3]
    other, new = made(), made()
    expected = sorted(map(tuple, other.pairs.where(other.pairs.pattern_id.isin(wanted)).collect()))
    assert sorted(map(tuple, new.chosen(wanted).collect())) == expected
    assert len(expected) > 20
    # of one column at least no values were compared all with all
    assert "_coded" not in new.__dict__
