from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from linkwright.config import CompareConfig
from linkwright.functions.jaro_winkler import similarity
from linkwright.functions.pairs import exact_dedup, exact_pairs, jaro_winkler_dedup, jaro_winkler_pairs
from linkwright.operators.compare import Comparison, Deduplication, intersect_pairs, setdiff_pairs, union_pairs
from linkwright.operators.estimate import Estimation
from linkwright.operators.evaluate import Evaluation, frontier
from linkwright.operators.indexing import with_index
from linkwright.operators.link import Linkage
from linkwright.operators.patterns import add_counts, gamma_table

A = [(0, "smith", "john", "12", 1980), (1, "smyth", "jon", "7", 1975), (2, "garcia", "maria", "101", 1990), (3, "nguyen", "anh", "5", 1966)]
B = [(0, "smith", "jon", "12", 1980), (1, "garcia", "mariah", "101", 1990), (2, "nguyen", "anh", "5", 1966), (3, "lopez", "ana", "44", 1971)]
SCHEMA = "id long, last string, first string, house string, year int"
COUNTS = [9000, 150, 120, 60, 40, 630]
START = ([[0.8, 0.15, 0.05], [0.9, 0.1]], [[0.05, 0.15, 0.8], [0.1, 0.9]])


def _tables(spark):
    return spark.createDataFrame(A, SCHEMA), spark.createDataFrame(B, SCHEMA)


def _pairs(df):
    return {(r["idx_a"], r["idx_b"]): r["pattern_id"] for r in df.collect()}


def test_linkage_golden(spark):
    a, b = _tables(spark)
    made = Comparison(a, b, ["last", "first", "house"], ["last", "first", "house"], ["year"], ["year"], index_a="id", index_b="id").fit()
    assert _pairs(made.pairs) == {(0, 0): 47, (1, 0): 30, (2, 1): 53, (3, 2): 49}
    assert made.Counts.sum() == 16 and made.Counts[0] == 12 and len(made.Counts) == 54
    assert [tuple(r) for r in made.indices(30).collect()] == [(1, 0)]
    strict = Comparison(a, b, ["last", "first", "house"], ["last", "first", "house"], ["year"], ["year"], index_a="id", index_b="id", compat=False).fit()
    assert _pairs(strict.pairs)[3, 2] == 53


def test_dedup_golden(spark):
    rows = [(0, "smith", 1980), (1, "smyth", 1980), (2, "smith", 1980), (3, "garcia", 1990), (4, "5", 1971), (5, "5", 1971)]
    df = spark.createDataFrame(rows, "id long, name string, year int")
    made = Deduplication(df, ["name"], ["year"], order_by="id").fit()
    assert _pairs(made.pairs) == {(1, 0): 3, (2, 0): 5, (2, 1): 3, (5, 4): 5}
    assert made.Counts.tolist() == [17, 0, 0, 2, 0, 2]
    assert Deduplication(df, ["name"], ["year"], index="id", compat=False).fit().Counts.tolist() == [11, 0, 0, 2, 0, 2]


def _level(x, y, own):
    if x is None or y is None:
        return 0
    if own and x == y:
        return 2
    s = np.float32(similarity(x, y))
    return int(s >= np.float32(0.88)) + int(s >= np.float32(0.94))


@pytest.mark.parametrize(("kf", "ke", "own", "seed"), [(1, 0, False, 1), (2, 1, False, 2), (0, 2, False, 3), (2, 1, True, 4), (1, 2, True, 5)])
def test_brute_force(spark, kf, ke, own, seed):
    rng = random.Random(seed)
    words = ["", "a", "ab", "smith", "smyth", "smithe", "garcia", "garcía", "x" * 70, "x" * 69 + "y", None]
    row = lambda i: (i, *[rng.choice(words) for _ in range(kf)], *[rng.choice([1, 2, None]) for _ in range(ke)])
    left, right = [row(i) for i in range(20)], [row(i) for i in range(15)]
    if own:
        right = left
    f, e = [f"f{i}" for i in range(kf)], [f"e{i}" for i in range(ke)]
    schema = ", ".join(["id long", *[f"{c} string" for c in f], *[f"{c} int" for c in e]])
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    made = (Deduplication(a, f, e, index="id") if own else Comparison(a, b, f, f, e, e, index_a="id", index_b="id")).fit()
    want = {}
    for x, y in itertools.product(left, right):
        if own and x[0] <= y[0]:
            continue
        levels = [_level(x[1 + k], y[1 + k], own) for k in range(kf)] + [int(x[1 + kf + k] is not None and x[1 + kf + k] == y[1 + kf + k]) for k in range(ke)]
        pid = 0
        for lv, n in zip(levels, [3] * kf + [2] * ke):
            pid = pid * n + lv
        if pid:
            want[x[0], y[0]] = pid
    assert _pairs(made.pairs) == want
    total = 20 * 21 // 2 if own else 300
    assert made.Counts.sum() == total


@pytest.mark.parametrize("own", [False, True])
def test_pairs_of_chosen_patterns(spark, own):
    """Pairs of probable patterns, found without the pairs of all others."""
    rng = random.Random(12)
    draw = lambda: (rng.choice(["smith", "smyth", "jones", "janes", None]), rng.choice(["john", "jon", "maria", ""]), rng.choice([1980, 1981, None]), rng.choice("xy"))
    schema = "i long, l string, f string, y int, b string"
    a = spark.createDataFrame([(i, *draw()) for i in range(60)], schema)
    b = spark.createDataFrame([(i, *draw()) for i in range(40)], schema)
    for block in ([], ["b"]):
        made = Deduplication(a, ["l", "f"], ["y"], index="i", block_on=block).fit() if own else Comparison(a, b, ["l", "f"], ["l", "f"], ["y"], ["y"], index_a="i", index_b="i", block_on=block).fit()
        everything = {tuple(r) for r in made.pairs.select("idx_a", "idx_b", "pattern_id").collect()}
        for wanted in ([13, 17, 15, 5], [17, 12], []):
            assert {tuple(r) for r in made.chosen(wanted).select("idx_a", "idx_b", "pattern_id").collect()} == {p for p in everything if p[2] in wanted}
        seen = [0] * 18
        for *_, p in everything:
            seen[p] += 1
        assert made.Counts[1:].tolist() == seen[1:]


def test_blocking_is_a_loop_over_blocks(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["smith", "smyth", "garcia"]), rng.choice([1, 2]), rng.choice("MF")) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, name string, year int, sex string")
    whole = Deduplication(df, ["name"], ["year"], block_on=["sex"], index="id").fit()
    parts = [Deduplication(df.where(f"sex = '{s}'"), ["name"], ["year"], index="id").fit() for s in "MF"]
    assert {tuple(r) for r in whole.counts.collect()} == {tuple(r) for r in add_counts(*[p.counts for p in parts]).collect()}
    one = Comparison(df, df, ["name"], ["name"], block_on=["sex"], index_a="id", index_b="id").fit()
    assert one.Counts.sum() == sum(sum(r[3] == s for r in rows) ** 2 for s in "MF")


def test_edge_tables(spark):
    df = spark.createDataFrame([], "id long, name string, year int")
    made = Deduplication(df, ["name"], ["year"], index="id").fit()
    assert made.pairs.count() == 0 and made.Counts.tolist() == [0] * 6
    full = spark.createDataFrame([(0, "ann", 1)], "id long, name string, year int")
    assert Comparison(full, df, ["name"], ["name"], index_a="id", index_b="id").fit().Counts.tolist() == [0, 0, 0]


def test_errors(spark):
    a, b = _tables(spark)
    for args in ((["last"], []), (["no"], ["last"]), ([], []), (["last"], ["last"], ["year"], []), (["last"], ["last"], ["no"], ["year"])):
        with pytest.raises(ValueError):
            Comparison(a, b, *args)
    with pytest.raises(ValueError):
        Deduplication(a, ["no"])
    made = Comparison(a, b, ["last"], ["last"], index_a="id", index_b="id")
    with pytest.raises(RuntimeError):
        _ = made.Counts
    made.fit()
    with pytest.raises(RuntimeError):
        made.fit()
    with pytest.raises(ValueError):
        CompareConfig(p=0.3)


def test_helpers(spark):
    a, b = (with_index(t, "id") for t in _tables(spark))
    assert {tuple(r) for r in exact_pairs(a, b, "year", "year").collect()} == {(0, 0, 1), (2, 1, 1), (3, 2, 1)}
    assert {tuple(r) for r in jaro_winkler_pairs(a, b, "last", "last").collect()} == {(0, 0, 2), (1, 0, 1), (2, 1, 2), (3, 2, 2)}
    assert {tuple(r) for r in jaro_winkler_dedup(a, "last").collect()} == {(1, 0, 1)}
    assert exact_dedup(a, "year").count() == 0
    x = spark.createDataFrame([(1, 0), (2, 0)], "idx_a long, idx_b long")
    y = spark.createDataFrame([(2, 0), (3, 0)], "idx_a long, idx_b long")
    rows = lambda d: {tuple(r) for r in d.collect()}
    assert rows(intersect_pairs(x, y)) == {(2, 0)} and rows(setdiff_pairs(x, y)) == {(1, 0)} and len(rows(union_pairs(x, y))) == 3
    none = x.where("idx_a < 0")
    assert rows(intersect_pairs(none, y)) == set() and rows(setdiff_pairs(x, none)) == rows(x)


def test_index(spark):
    df = spark.range(100).selectExpr("id", "99 - id AS k").repartition(7)
    assert all(r["__idx"] == r["k"] for r in with_index(df, "k").collect())
    assert with_index(df.where("id < 0"), "k").count() == 0
    assert sorted(r["__idx"] for r in with_index(df).collect()) == list(range(100))
    with pytest.raises(ValueError):
        with_index(df.withColumnRenamed("k", "__idx"))


@pytest.mark.parametrize("order", [None, "id"])
def test_index_of_wide_rows(spark, order):
    """Adaptive execution merges partitions of narrow and wide rows differently; no row may be lost by that."""
    df = spark.range(200_000).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 8).alias("wide"))
    made = with_index(df, order).agg(F.count("*"), F.countDistinct("__idx"), F.max("__idx"), F.sum((F.col("id") == F.col("__idx")).cast("int"))).first()
    assert tuple(made)[:3] == (200_000, 200_000, 199_999)
    assert order is None or made[3] == 200_000
    own = Deduplication(df, [], ["id"], order_by="id")
    assert own.a.count() == 200_000


def test_gamma(spark):
    got = [tuple(r["gamma"]) for r in gamma_table(spark, 2, 1).orderBy("pattern_id").collect()]
    assert got == list(itertools.product(range(3), range(3), range(2)))


def test_estimation_golden():
    e = Estimation(1, 1, COUNTS, init=START).fit()
    assert e.iterations == 5 and e.converged
    assert pytest.approx(0.070549, abs=1e-6) == e.Lambda
    assert np.allclose(e.Ksi, [1.2e-05, 0.069526, 0.005159, 0.969142, 0.16756, 0.99918], atol=1e-6)
    once = Estimation(1, 1, COUNTS, init=START).fit(max_iter=1)
    assert pytest.approx(0.064676515, abs=1e-9) == once.Lambda and not once.converged
    with pytest.raises(RuntimeError):
        e.fit()
    with pytest.raises(RuntimeError):
        _ = Estimation(1, 1, COUNTS).Ksi
    with pytest.raises(ValueError):
        Estimation(1, 1, [1, 2])


def test_estimation_recovers_parameters():
    rng = np.random.default_rng(3)
    non, match = [[0.9, 0.07, 0.03], [0.85, 0.1, 0.05], [0.95, 0.05]], [[0.05, 0.15, 0.8], [0.1, 0.2, 0.7], [0.1, 0.9]]
    cells = np.array([0.95 * np.prod([non[k][g] for k, g in enumerate(gs)]) + 0.05 * np.prod([match[k][g] for k, g in enumerate(gs)]) for gs in itertools.product(range(3), range(3), range(2))])
    e = Estimation(2, 1, rng.multinomial(2_000_000, cells), seed=1).fit(1e-6)
    assert abs(e.Lambda - 0.05) < 0.002
    assert all(np.allclose(p, q, atol=0.01) for p, q in zip(e.Pi[1], match))


def test_evaluation_golden(spark):
    e = Estimation(1, 1, COUNTS, init=START).fit()
    as_coded, documented = Evaluation(e.Lambda, e.Ksi, COUNTS), Evaluation(e.Lambda, e.Ksi, COUNTS, compat=False)
    assert all(pytest.approx(0.0034316, abs=1e-6) == documented.FDR(s) for s in (0.5, 0.85, 0.95))
    assert pytest.approx(0.0253176, abs=1e-6) == documented.FNR(0.5)
    assert pytest.approx(2531763.87, rel=1e-6) == as_coded.FNR(0.5)
    assert (documented.optimal_threshold(spark, 1), as_coded.optimal_threshold(spark, 1)) == (0.168, 0.0)
    assert math.isnan(documented.FDR(1.1))
    curve = {round(r["s"] * 1000): r for r in documented.frontier(spark).collect()}
    assert len(curve) == 1001 and pytest.approx(documented.FDR(0.5)) == curve[500]["fdr"] and math.isnan(curve[1000]["fdr"])
    nan = spark.createDataFrame([(float("nan"), 5.0), (0.9, 2.0)], "ksi double, count double")
    assert frontier(nan, 0.1).where("s = 0").first()["fdr"] == pytest.approx(0.1)


def test_linkage(spark):
    a, b = _tables(spark)
    made = Comparison(a, b, ["last"], ["last"], index_a="id", index_b="id").fit()
    link = Linkage(made.a, made.b, made.pairs, [0.99, 0.5, 0.85])
    out = link.transform(include_score=True)
    assert out.columns == [f"{c}_A" for c in a.columns] + ["Index_A", "Index_B"] + [f"{c}_B" for c in b.columns] + ["ksi"]
    assert {(r["Index_A"], r["Index_B"]) for r in out.collect()} == {(0, 0), (2, 1), (3, 2)}
    with pytest.raises(ValueError):
        link.transform(0.9)
    assert link.transform(0.9, compat=False).count() == 0
    assert Linkage(made.a, made.b, made.pairs, [0.0, float("nan"), 0.9]).matches().count() == 3
    with pytest.raises(ValueError):
        Linkage(made.a.withColumnRenamed("year", "Index"), made.b, made.pairs, [0.0, 0.0, 0.9]).transform()


def test_planted_matches(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    people = [(i, word(8), word(7), rng.randint(1940, 2000)) for i in range(120)]

    def slip(w):
        i = rng.randrange(2, len(w))
        return w[:i] + rng.choice(letters) + w[i + 1 :]

    left = people[:80]
    right = [(i, slip(x) if rng.random() < 0.5 else x, y, z) for i, x, y, z in people[40:]]
    schema = "id long, last string, first string, year int"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    made = Comparison(a, b, ["last", "first"], ["last", "first"], ["year"], ["year"], order_by_a="id", order_by_b="id").fit()
    e = Estimation(2, 1, made.counts, seed=2).fit()
    out = Linkage(made.a, made.b, made.pairs, e.ksi_table(spark)).transform()
    got = {(r["id_A"], r["id_B"]) for r in out.select("id_A", "id_B").collect()}
    true = {(i, i) for i in range(40, 80)}
    assert len(got & true) >= 38 and len(got - true) <= 2


def test_streaming(spark, tmp_path):
    from pathlib import Path

    from linkwright.store import shared_dir
    from linkwright.streaming import link_batches

    a, b = _tables(spark)
    a.write.parquet(str(tmp_path / "in"))
    got = []
    kept = lambda: sorted(p.name for p in Path(shared_dir(spark)).glob("*"))
    before = kept()
    query = link_batches(spark.readStream.schema(a.schema).parquet(str(tmp_path / "in")), b, ["last"], [], [0.0, 0.5, 0.9], lambda df, n: got.extend(df.select("id_A", "id_B").collect()), order_by="id").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in got} == {(0, 0), (2, 1), (3, 2)}
    # a stream leaves no tables behind
    assert kept() == before
