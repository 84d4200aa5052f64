"""Counts from products of rows, and blocks of classes of lengths."""

from itertools import combinations

import numpy as np

from linkwright.functions import jaro_winkler
from linkwright.functions.jaro_winkler import block_pairs, similarity
from linkwright.operators import levels
from linkwright.operators.compare import Comparison

NAMES = ["martha", "marhta", "dwayne", "duane", "smith", "smyth", "jones", "johnson", "jonson", None, ""]


def test_pairs_that_agree_in_two_variables_come_from_products(spark):
    draw = np.random.default_rng(5)
    rows = [(i, *(NAMES[k] for k in draw.integers(0, len(NAMES), 2)), int(draw.integers(0, 3))) for i in range(60)]
    a, b = (spark.createDataFrame(part, "idx long, x string, y string, z int") for part in (rows[:30], rows[30:]))
    made = Comparison(a, b, ["x", "y"], ["x", "y"], ["z"], ["z"], index_a="idx", index_b="idx").fit()
    level = lambda u, v: sum(np.float32(similarity(u, v) or 0) >= np.float32(t) for t in (0.88, 0.94)) if u and v else 0
    found = {}
    for r in rows[:30]:
        for s in rows[30:]:
            at = (level(r[1], s[1]), level(r[2], s[2]), int(r[3] == s[3]))
            for i, j in combinations(range(3), 2):
                found[i, j, at[i], at[j]] = found.get((i, j, at[i], at[j]), 0) + 1
    for i, j in combinations(range(3), 2):
        for (x, y), n in made._products(i, j).items():
            assert n == found.get((i, j, x, y), 0)


def test_short_and_long_values_share_blocks(spark):
    # one class holds several lengths, so that values of rare lengths make no blocks of their own
    for n in range(1, 40):
        assert any(low <= n <= high for low, high in map(levels._bounds, range(1, 24)))
    words = spark.createDataFrame([("abcdefgh"[: 4 + i % 5] + chr(97 + i % 26) * (i % 9) + str(i),) for i in range(400)], "v string")
    before, levels.BLOCK_VALUES = levels.BLOCK_VALUES, 100
    try:
        made = levels._blocks(words, [], "a")
        sizes = [len({len(v) for v in r["values_a"]}) for r in made.collect()]
        assert max(sizes) > 1
    finally:
        levels.BLOCK_VALUES = before


def test_sketches_lose_no_pair():
    draw = np.random.default_rng(2)
    words = ["".join(draw.choice(list("abcdeéß -XYZ12"), draw.integers(1, 15))) for _ in range(150)] + NAMES[:9]
    assert hasattr(jaro_winkler.Block(words), "sketch")
    for threshold, p in ((0.88, 0.1), (0.5, 0.25), (0.8, 0.0)):
        i, j, _ = block_pairs(words, words, p, threshold)
        assert set(zip(i.tolist(), j.tolist())) == {(x, y) for x, u in enumerate(words) for y, v in enumerate(words) if np.float32(similarity(u, v, p)) >= np.float32(threshold)}
