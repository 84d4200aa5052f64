from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from linkwright.operators import compare
from linkwright.operators.compare import Comparison, Deduplication


@pytest.mark.parametrize("own", [False, True])
def test_pairs_of_many_equal_records(spark, own, monkeypatch):
    """Records of a few tuples, in several lists each: every pair once, and none of them shuffled."""
    monkeypatch.setattr(compare, "LIST_RECORDS", 16, raising=False)
    df = spark.range(300).select("id", F.expr("array('smith', 'smyth', 'jones')[id % 3]").alias("name"), F.expr("if(id % 7 = 0, null, id % 2)").alias("k"))
    made = (Deduplication(df, ["name"], ["k"], index="id") if own else Comparison(df, df, ["name"], ["name"], ["k"], ["k"], index_a="id", index_b="id")).fit()
    rows = made.pairs.collect()
    assert len(rows) == len({(r["idx_a"], r["idx_b"]) for r in rows})
    name, key = lambda i: i % 3, lambda i: None if i % 7 == 0 else i % 2
    level = lambda x, y: 2 if x == y else 1 if {x, y} == {0, 1} else 0
    want = {(i, j): 2 * level(name(i), name(j)) + int(key(i) is not None and key(i) == key(j)) for i in range(300) for j in range(i if own else 300)}
    assert {(r["idx_a"], r["idx_b"]): r["pattern_id"] for r in rows} == {p: n for p, n in want.items() if n}
    plan = made.pairs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = lambda word: next((i for i, x in enumerate(plan) if word in x), len(plan))
    assert first("Generate explode") < min(first("Aggregate"), first("Join"), first("Repartition"))


def test_cover_of_probable_patterns(spark):
    """Pairs of chosen patterns come from the combinations of variables that few pairs share, not from all."""
    rows = [(i, f"name{i % 50}", f"town{i % 7}x{i % 3}", i % 2, i % 40) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, l string, s string, g int, y int")
    made = Deduplication(df, ["l", "s"], ["g", "y"], index="id").fit()
    wanted = [35, 34, 33]
    sets = {frozenset({0, 1, 2, 3}), frozenset({0, 1, 2}), frozenset({0, 1, 3})}
    taken = made._cover(sets)
    assert len(taken) <= 2 and all(any(s.issuperset(c) for c in taken) for s in sets)
    got = {tuple(r) for r in made.chosen(wanted).collect()}
    assert got and got == {tuple(r) for r in made.pairs.where(F.col("pattern_id").isin(wanted)).collect()}
