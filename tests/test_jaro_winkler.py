from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkwright.functions.jaro_winkler import block_pairs, jw_similarity, length_range, pair_scores, register, similarity

# Pairs, similarities and levels.
GOLDEN = [
    ("martha", "marhta", 0.96111107, 2), ("dwayne", "duane", 0.84000003, 0), ("dixon", "dicksonx", 0.81333333, 0),
    ("smith", "smyth", 0.8933333, 1), ("john", "jon", 0.93333334, 1), ("maria", "mariah", 0.96666664, 2),
    ("anh", "ana", 0.8222223, 0), ("jones", "janes", 0.87999994, 0), ("abcd", "abcdefghij", 0.88, 1),
    ("abcdef", "bcadef", 0.9166667, 1), ("abcdefgh", "bcaefdgh", 0.875, 0), ("ab", "ac", 0.70000005, 0),
    ("a", "ab", 0.84999996, 0), ("a", "a", 0.0, 0), ("101", "101", 1.0, 2), ("abc", "bca", 0.0, 0),
    ("", "", 0.0, 0), ("", "a", 0.0, 0), ("éa", "éb", 0.70000005, 0)]
WORDS = st.text(alphabet="abcé", max_size=9)


@pytest.mark.parametrize(("a", "b", "score", "level"), GOLDEN)
def test_golden(a, b, score, level):
    s = np.float32(similarity(a, b))
    assert s == np.float32(score)
    assert (s >= np.float32(0.88)) + int(s >= np.float32(0.94)) == level


def test_null():
    assert similarity(None, "a") is None


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, max_size=8), st.lists(WORDS, max_size=8), st.sampled_from([0.3, 0.7, 0.88]))
def test_block_is_the_scalar(xs, ys, threshold):
    i, j, score = block_pairs(xs, ys, 0.1, threshold)
    want = {(i, j): s for i, x in enumerate(xs) for j, y in enumerate(ys) if (s := np.float32(similarity(x, y))) >= np.float32(threshold)}
    assert dict(zip(zip(i.tolist(), j.tolist()), score)) == want and len(i) == len(want)


def test_long_strings():
    xs, ys = ["a" * 70, "b" * 10, "ab" * 40], ["a" * 69, "b" * 10, "ab" * 39 + "a"]
    i, j, _ = block_pairs(xs, ys, 0.1, 0.88)
    assert set(zip(i.tolist(), j.tolist())) == {(0, 0), (1, 1), (2, 2)}


def test_scores_of_many_pairs():
    xs, ys = ["john"] * 7 + [None, "", "éa", "x" * 70], ["jon", "john", "", "jhon", "zzz", "jo", "j", "a", "a", "éb", "x" * 70]
    got = pair_scores(xs, ys, 0.1)
    assert np.isnan(got[7])
    assert all(got[i] == np.float32(similarity(x, y)) for i, (x, y) in enumerate(zip(xs, ys)) if i != 7)


@settings(max_examples=200, deadline=None)
@given(WORDS.filter(bool), WORDS.filter(bool))
def test_length_range_loses_nothing(a, b):
    if np.float32(similarity(a, b)) >= np.float32(0.88):
        low, high = length_range(len(a), 0.88, 0.1)
        assert low <= len(b) <= (high or len(b))


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("select jw_similarity('martha', 'marhta') s, jw_level('smith', 'smyth') l, jw_similarity(null, 'a') n, jw_level(null, 'a') z").first()
    assert (np.float32(row.s), row.l, row.n, row.z) == (np.float32(0.96111107), 1, None, 0)
    df = spark.createDataFrame([("john", "jon"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(jw_similarity(df.a, df.b)).collect()] == [pytest.approx(0.9333333), None]


def test_pairs_left_out_by_letters_in_common():
    """Long blocks of random words: few pairs reach the kernel, and none is missed."""
    from linkwright.functions.jaro_winkler import Block, _codes

    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    ys = [word(8) for _ in range(300)]
    xs = [y[:5] + y[6] + y[5] + y[7] for y in ys[:40]] + [word(8) for _ in range(60)]
    block, pairs = Block(ys), [(i, j) for i in range(100) for j in range(300)]
    want = {(i, j) for i, j in pairs if similarity(xs[i], ys[j]) >= np.float32(0.88)}
    i, j, _ = block.against(xs, 0.1, 0.88)
    assert set(zip(i.tolist(), j.tolist())) == want and len(want) >= 40
    letters = np.minimum(np.searchsorted(block.alphabet, _codes(xs)), len(block.alphabet) - 1).reshape(100, 8)
    met = sum(len(x) for x, _ in block._candidates(letters, np.arange(300), np.array([8]), np.zeros(300, np.int64), 0.1, 0.88))
    assert met < len(pairs) / 50
