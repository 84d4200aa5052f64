"""Duplicates by formatting, components, variants, matching, addresses."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwright.functions.text import bare
from linkwright.llm.addresses import locate, location_pairs, parse_addresses
from linkwright.llm.components import connected_components
from linkwright.llm.dedup import formatting_duplicates
from linkwright.llm.matching import RAISE, WINDOW, assign_one_to_one, best_matching, join_weak, match_entities
from linkwright.llm.names import CUT, FORM, INITIAL, NONE, SAME, SLIP, Forms, Name, compare_family, compare_given, edits, words
from linkwright.llm import variants
from linkwright.llm.metric import Words, close_words
from linkwright.llm.variants import metric_cells, metric_variants, name_variants

PERSON = "idx long, last_name string, first_name string, house_number string, street_name string, birth_year int, gender string"
FORMS = [("Robert", "Bob"), ("Katherine", "Kate")]


def _forms(spark):
    return spark.createDataFrame(FORMS, "formal_name string, other_form string")


# ---- formatting duplicates


def _found(df):
    return {(r["keep"], r["copy"], r["n_copies"]) for r in formatting_duplicates(df, "id", {"s": bare("s"), "y": F.col("y")}, {"n": [bare("a"), bare("b")]}).collect()}


def test_formatting_duplicates(spark):
    rows = [(1, "O'Neil", "Ann", "Main St", 1), (2, "ann", "ONEIL", "main-st.", 1), (3, "Oneil", "Anne", "Main St", 1), (4, None, "x", None, None), (5, "X", "", "", None), (6, "X", "", "", None), (7, "q", "q", "s", 2), (8, "q", None, "s", 2)]
    df = spark.createDataFrame(rows, "id long, a string, b string, s string, y int").withColumn("copy", F.lit("clash"))
    assert _found(df) == {(1, 1, 2), (1, 2, 2), (4, 4, 3), (4, 5, 3), (4, 6, 3)}
    assert _found(df.where("id < 0")) == set()
    assert len(_found(df.where("id = 6").unionByName(df.where("id = 6").withColumn("id", F.lit(9).cast("long"))))) == 2


@pytest.mark.parametrize("bits", [1, 3])
def test_formatting_duplicates_with_collisions(spark, bits):
    """Hashes of a bit or three throw unequal records together, which the verification parts again."""
    rng = random.Random(bits)
    rows = [(i, rng.choice("abc"), rng.choice("abc"), rng.choice(["s", "t", None])) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a string, b string, s string")
    groups: dict = {}
    for i, a, b, s in rows:
        groups.setdefault((tuple(sorted((a, b))), s), []).append(i)
    expected = {(min(g), i, len(g)) for g in groups.values() if len(g) > 1 for i in g}
    found = formatting_duplicates(df, "id", {"s": F.col("s")}, {"n": [F.col("a"), F.col("b")]}, hash_bits=bits)
    assert {tuple(r) for r in found.collect()} == expected


def test_formatting_duplicates_sort_nothing(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "b", "a")], "id long, a string, b string")
    found = formatting_duplicates(df, "id", {}, {"n": [F.col("a"), F.col("b")]})
    assert "Sort" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 2


# ---- components


def _components(pairs):
    group = {}
    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                group.setdefault(x, x)
    while True:
        before = dict(group)
        for a, b in pairs:
            if a is not None and b is not None:
                group[a] = group[b] = min(group[a], group[b])
        if before == group:
            return group


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(500, None), (None, 501), (502, 502), (None, None)] + [(i, i + 1) for i in range(100, 120)] + [(900, i) for i in range(901, 930)] * 2
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {r["idx"]: r["group_idx"] for r in connected_components(df, "a", "b").collect()} == _components(pairs)


def test_components_of_a_star_with_hubs(spark, monkeypatch):
    """A hub with most of the edges goes the way of broadcast minima."""
    from linkwright.llm import components

    monkeypatch.setattr(components, "LEAST_HUB", 20)
    pairs = [(500, i) for i in range(300)] + [(500, 1000), (1000, 1001), (2000, 2001)]
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {r["idx"]: r["group_idx"] for r in connected_components(df, "a", "b").collect()} == _components(pairs)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# ---- names


def test_name_parts():
    forms = Forms(FORMS, ["robert", "katherine", "pamela", "frances", "francis"])
    n = lambda a, b: Name(a, b, forms)
    fam, giv = lambda a, b: compare_family(a, b, forms), lambda a, b: compare_given(a, b, forms)
    a = n("Van der Sihert Jr.", "Dr. Robert")
    assert words("Bij0l PhD") == ("bijol",) and words(None) == () and words("  ") == ()
    assert fam(a, n("vandersihert", "BOB")) >= FORM and giv(a, n("x", "BOB")) == FORM
    assert (fam(a, n("Robert", "Van der Sihert")), giv(a, n("Robert", "Van der Sihert"))) == (SAME, SAME)
    assert (fam(a, n(None, "Robert Sihert")), giv(a, n(None, "Robert Sihert"))) == (SAME, SAME)
    assert giv(a, n("Sihert", "R.")) == INITIAL and giv(a, n("Sihert", "Rob")) == CUT and giv(a, n("Sihert", "Robrt")) == SLIP
    assert giv(n("A", "Frances"), n("A", "Francis")) == NONE
    assert fam(n("McSkegolm", "x"), n("Skegolm", "x")) == FORM and fam(n("Sihert-Menilm", "x"), n("Menilm", "x")) == SAME
    assert edits("abcd", "abdc") == 1 and edits("a", "abcd") == 3


# ---- metric variants


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_metric_join_is_exact(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    rows = [(s, w) for s, n in (("big", 300), ("small", 6)) for w in vocabulary[:n]] + [("one", "x"), ("big", vocabulary[0]), (None, "x"), ("big", None)]
    df = spark.createDataFrame(rows, "stratum string, word string")
    got = [tuple(r) for r in metric_variants(df, 1).collect()]
    want = {(s, *sorted(p)) for s in ("big", "small") for p in itertools.combinations({w for t, w in rows if t == s and w}, 2) if _lev(*p) <= 1}
    assert len(got) == len(set(got)) and set(got) == want


def test_name_variants(spark):
    rows = [
        (1, "Sihert", "Robert", "12", "Main St", 1970, "M"), (2, "Sihret", "Bob", "12", "main st", 1970, "M"), (3, "Robert", "SIHERT", "12", "Main St.", 1970, "M"),
        (4, "Sihert", "Katherine", "12", "Main St", 1970, "F"), (5, "Sihert", "R.", "12", "Main St", 1970, None), (6, "Sihert", "Robert", "12", "Main St", 1971, "M"),
        (7, "Sihert", "Robert", "12", "Main St", None, "M"), (8, None, None, "12", "Main St", 1970, None), (9, "", "", None, None, 1970, "F"), (10, "S" * 3000, "Robert", "12", "Main St", 1970, "M")]
    # given names are known by their frequency
    rows += [(100 + i, f"Other{i}", ["Robert", "Katherine"][i % 2], str(i), "Far Rd", 1950, "M") for i in range(20)]
    df = spark.createDataFrame(rows, PERSON).withColumn("stratum", F.lit(1))
    got = {(r["idx_1"], r["idx_2"]) for r in name_variants(df, _forms(spark)).collect()}
    assert got == {(1, 2), (2, 3), (1, 5), (2, 5), (3, 5)}
    assert name_variants(df.where("idx < 0"), _forms(spark)).count() == 0


def test_distances_of_many_pairs():
    rng = random.Random(6)
    some = ["".join(rng.choice("abé") for _ in range(rng.randrange(n))) for n in (1, 5, 9, 12, 20, 70) for _ in range(12)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(some)), np.arange(len(some))))
    assert Words(some).distances(i, j).tolist() == [_lev(some[a], some[b]) for a, b in zip(i, j)]


def test_cells_in_memory_are_exact():
    rng = random.Random(7)
    points = sorted({(rng.randrange(9) ** 2, "".join(rng.choice("abcd") for _ in range(rng.randint(1, 8)))) for _ in range(900)})
    x, y, cells = close_words([w for _, w in points], np.array([g for g, _ in points]), 2)
    want = {(a, b) for a, b in itertools.combinations(range(len(points)), 2) if points[a][0] == points[b][0] and _lev(points[a][1], points[b][1]) <= 2}
    assert set(zip(x.tolist(), y.tolist())) == want and cells > 9
    assert close_words([], np.zeros(0), 2)[2] == 0


def test_large_stratum_makes_a_tree_of_cells(spark, monkeypatch):
    """Two thousand words of one stratum; the plain result comes from shared forms without one letter."""
    monkeypatch.setattr(variants, "CELL_WORDS", 200)
    monkeypatch.setattr(variants, "SALT_WORK", 20_000)
    rng = random.Random(8)
    # words of some families that lie far from each other
    stems = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 60))) for _ in range(100)]
    made = set()
    while len(made) < 2_000:
        w = list(rng.choice(stems))
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = rng.choice("abcdefghijklmnop")
        made.add("".join(w))
    df = spark.createDataFrame([("s", w) for w in made], "stratum string, word string").repartition(4)
    got = {(r["x"], r["y"]) for r in metric_variants(df, 1).collect()}
    forms: dict = {}
    for w in made:
        for f in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            forms.setdefault(f, []).append(w)
    want = {p for group in forms.values() for p in itertools.combinations(sorted(group), 2) if _lev(*p) == 1}
    assert got == want
    assert metric_cells(df, 1).agg(F.count_distinct("cell")).first()[0] > 10


def test_name_variants_by_rows_and_by_joins(spark):
    """Strata in rows and strata by joins give the same pairs; a crowd is no reason to drop one."""
    rng = random.Random(9)
    last = ["Sihert", "Sihret", "Mujalk", "Mujalk-Sihert", "O'Brel", "Obrel", "Ng", "N", "", None, "Zz"]
    first = ["Robert", "Bob", "Katherine", "Kate", "Al", "A.", "", None, "Robrt"]
    rows = [(i, rng.choice(last), rng.choice(first), "1", "High St" if i % 3 else None, 1970, rng.choice(["M", "F", None])) for i in range(160)]
    df = spark.createDataFrame(rows, PERSON)
    found = [{tuple(sorted(r)) for r in name_variants(df, _forms(spark), row_records=n).collect()} for n in (256, 0)]
    assert found[0] == found[1] and len(found[0]) > 200
    short = spark.createDataFrame([(1, "Ng", "Al", "1", "High St", 1970, None), (2, "Ng", "A", "1", "High St", 1970, None)], PERSON)
    assert {tuple(r) for r in name_variants(short, _forms(spark)).collect()} == {(1, 2)}


# ---- addresses


def test_parse_address(spark):
    rows = [("12", "Main Street"), (None, "74 N Main Ct"), ("0168B", "Main St, Flat 3"), ("no 9", "Main Rd #25"), (None, "Main Rd., No No. 305"), ("", "190Main Hgwy"), (None, None), ("5", None), ("7", "Main-StUnit12")]
    df = spark.createDataFrame(rows, "h string, s string")
    got = [tuple(r) for r in parse_addresses(df, "h", "s").select("number", "words").collect()]
    assert got == [("12", "main street"), ("74", "n main ct"), ("168b", "main st"), ("9", "main rd"), ("305", "main rd"), ("190", "main hgwy"), ("", ""), ("5", ""), ("7", "mainst")]


def test_locations(spark):
    streets = ["Tobrucroft Road", "Skidoworth Road", "Upper Brasufield Street", "Gifuham Square", "Mikesford Road"]
    streets += [f"{a}{b} {c}" for a, b, c in zip(("Pluna", "Kresi", "Vodo", "Jahi", "Lemu", "Nusti", "Fawo", "Tegri", "Shuka"), ("ham", "well", "burn", "croft", "dal", "gat", "moor", "den", "bury"), ("Lane", "Court", "Drive", "Place", "Avenue", "Terrace", "Crescent", "Highway", "Lane"))]
    rows = [(i, str(1 + i % 40), streets[i // 40]) for i in range(40 * len(streets))] * 2
    rows += [(0, str(n), "Tobrucroft Rd") for n in (1, 2, 3, 4, 5)] + [(0, "6", "Skidoworth Rd"), (0, "7", "Skidworth Road"), (0, "8", "Brsfld Street Upper"), (0, "9", "Gifuham"), (0, "10", "tobrucroftroad"), (0, "11", "Mikesford Rd Apt 4"), (0, None, "Gifuham Square"), (0, "3", None)]
    df = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "idx long, house string, street string").withColumn("number", F.lit("clash"))
    place = {r["idx"]: r["location"] for r in locate(df, "house", "street", ["idx"]).collect()}
    at = {(r[1], r[2]): place.get(i) for i, r in enumerate(rows)}
    for (house, new), old in {("1", "Tobrucroft Rd"): "Tobrucroft Road", ("6", "Skidoworth Rd"): "Skidoworth Road", ("7", "Skidworth Road"): "Skidoworth Road", ("8", "Brsfld Street Upper"): "Upper Brasufield Street", ("9", "Gifuham"): "Gifuham Square", ("10", "tobrucroftroad"): "Tobrucroft Road", ("11", "Mikesford Rd Apt 4"): "Mikesford Road"}.items():
        assert at[house, new] == at[house, old] is not None
    assert len({v for v in at.values() if v}) == 40 * len(streets)
    assert at[None, "Gifuham Square"] is None and at["3", None] is None
    assert locate(df.where("idx < 0"), "house", "street", ["idx"]).count() == 0
    with pytest.raises(ValueError):
        locate(df, "house", "street", ["number"])


@pytest.mark.parametrize("total", [10, 10**9])
def test_location_pairs(spark, total):
    a = spark.createDataFrame([(i, "x", f"b{i % 2}") for i in range(2200)] + [(3000, "y", "q")], "idx long, location string, bare string")
    b = spark.createDataFrame([(10_000, "x", "b0"), (10_001, "y", "q"), (10_002, "y", "r")], "idx long, location string, bare string")
    got = [tuple(r) for r in location_pairs(a, b, total).collect()]
    assert sorted(got) == sorted([(i, 10_000) for i in range(1, 2200, 2)] + [(3000, 10_002)])


# ---- matching


def _greatest(edges):
    """The total of the best matching, by trying all."""
    if not edges:
        return 0.0
    (u, v, w), rest = edges[0], edges[1:]
    return max(_greatest(rest), w + _greatest([e for e in rest if e[0] != u and e[1] != v]))


def test_assignment(spark):
    # u and v are two sides: 2 on the left is another than 2 on the right
    edges = [(1, 1, 5.0), (2, 1, 5.5), (2, 2, 5.0), (5, 6, 1.0), (5, 7, 1.0), (8, 9, 2.0), (8, 9, 1.5)]
    df = spark.createDataFrame(edges, "u long, v long, score double")
    assert {tuple(r) for r in assign_one_to_one(df).collect()} == {(1, 1, 5.0), (2, 2, 5.0), (5, 6, 1.0), (8, 9, 2.0)}
    assert assign_one_to_one(df.where("u < 0")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_matchings_are_the_greatest(seed):
    rng = random.Random(seed)
    edges = list({(u, v): (u, v, float(rng.randint(1, 9))) for u, v in ((rng.randrange(5), rng.randrange(5)) for _ in range(13))}.values())
    got = best_matching(edges)
    assert len({u for u, *_ in got}) == len({v for _, v, _ in got}) == len(got)
    assert sum(w for *_, w in got) == _greatest(edges)


def test_auction_of_large_components(spark):
    """A component too large for a row is solved by bids, to within a raise for each node."""
    rng = random.Random(3)
    edges = list({(u, v): (u, v, rng.randint(4, 40) / 4) for u, v in ((rng.randrange(6), rng.randrange(5)) for _ in range(14))}.values())
    got = [tuple(r) for r in assign_one_to_one(spark.createDataFrame(edges, "u long, v long, score double"), row_edges=0).collect()]
    assert len({u for u, *_ in got}) == len({v for _, v, _ in got}) == len(got)
    assert sum(w for *_, w in got) >= _greatest(edges) - 11 * RAISE


@pytest.mark.parametrize("heaviest", [(1, 2), (1, 11), (2, 11)])
def test_weakly_repeated_records_stay_together(spark, heaviest):
    """Records 1 and 2 of one source and 11 of the other are one person; 3 competes for 11, 12 has no other."""
    edges = [(1, 2, 0, 0), (1, 11, 0, 1), (2, 11, 0, 1), (3, 11, 0, 1), (3, 12, 0, 1), (12, 13, 1, 1), (13, 14, 1, 1)]
    rows = [(*e, 9.0 if e[:2] == heaviest else 7.0 if e[:2] == (3, 11) else 8.0) for e in edges]
    weak = spark.createDataFrame(rows, "u0 long, v0 long, side_i int, side_j int, score double")
    got = {r["entity"]: r["to"] for r in join_weak(weak).collect()}
    assert got == {1: 1, 2: 1, 11: 1, 3: 3, 12: 3, 13: 3, 14: 3}
    assert join_weak(weak.where("u0 < 0")).count() == 0


def test_two_slips_of_a_usual_name_are_not_rare(spark):
    """Both are as usual as the name that they come from, however rare each of them is."""
    from linkwright.llm import matching

    names = ["menilm"] * 100 + ["meenilm", "menlm", "sihert", "sihrt"]
    rows = [(i, i % 2, n, "Barbara", n, "barbara", "b", 1961, "F", str(i), f"street{i}") for i, n in enumerate(names)]
    counted = {r["idx"]: tuple(r) for r in matching._counted(spark.createDataFrame(rows, matching._FIELDS)).collect()}
    evidence = matching.Evidence({1961: 0.01}, Forms([], ["barbara"]), 24.0, 10_000)
    near = counted[100][len(matching._NAMES) + matching._COUNTS.index("n_near_fam")]
    assert near == 101 and counted[102][-len(matching._CODES) - 3] == 2
    assert evidence.of(counted[100], counted[101]) < 20 < evidence.of(counted[102], counted[103])


def test_evidence_grows_with_the_table():
    """A unique family name without year and address holds against a threshold that grows with the rows."""
    import math

    from linkwright.llm.matching import Evidence

    row = lambda i, total: (i, 0, "sihert", "Barbara", "sihert", "barbara", "b", None if i == 1 else 1961, "F", None, None, 2, total // 128, None, 2, total // 128)
    for total in (96_000, 960_000, 9_600_000):
        evidence = Evidence({1961: 0.01}, Forms([], ["barbara"]), 99.0, total)
        assert evidence.of(row(1, total), row(2, total)) >= math.log2(total) + 1


def test_slips_at_the_start_of_a_family_name_are_compared(spark):
    from linkwright.llm.matching import _FIELDS, Evidence, _compare_sorted, _counted

    names = [("Chuchashond", "Cuchashond", "Mary", 1984), ("Oshawegilm", "Okshawegilm", "Jurgen", 1990), ("Dakrokrabourn", "Dnakrokrabourn", "Gregory", 1978), ("Sihert-Menbury", "Menbury", "Mary", 1950)]
    rows = [(2 * k + i, i, x, giv, x.lower().replace("-", ""), giv.lower(), giv[0].lower(), year, "F", str(i), f"street{i}") for k, (*fam, giv, year) in enumerate(names) for i, x in enumerate(fam)]
    evidence = Evidence({}, Forms([], ["mary", "jurgen", "gregory"]), 24.0, 96_000)
    table = _counted(spark.createDataFrame(rows, _FIELDS)).orderBy("idx").toArrow().combine_chunks()
    found = _compare_sorted(table, np.arange(8), np.zeros(8), np.zeros(8), evidence, 17.6, True)
    assert {p[:2] for p in found} == {(0, 1), (2, 3), (4, 5), (6, 7)}


def test_slips_are_found_beyond_the_window(spark):
    from linkwright.llm import matching

    rng = random.Random(5)
    fams = ["".join(rng.choice("defg") + rng.choice("aeiou") for _ in range(5)) for _ in range(60)] + ["chuchashond", "huchashond", "chuchashind"]
    rows = [(i, i % 2, fam, "Mary", fam, "mary", "m", 1984, "F", str(i), f"street{i}") for i, fam in enumerate(fams)]
    df = matching._counted(spark.createDataFrame(rows, matching._FIELDS))
    total, threshold = 100_000, 17.6
    evidence = matching.Evidence({}, Forms([], ["mary"]), 99.0, total)
    pairs = lambda found: {(r["i"], r["j"]) for r in found.collect()}
    assert pairs(matching._slip_pairs(df, total, evidence, threshold)) == {(60, 61), (60, 62)}
    assert (60, 61) not in pairs(matching._window_pairs(df, matching.SORT_KEYS[2], len(rows), evidence, threshold))
    assert pairs(matching._slip_pairs(df, total, evidence, 99.0)) == set()


def test_matching(spark):
    rng = random.Random(9)
    letters = "bcdfghklmnprstvz"
    name = lambda n: "".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(n)).title()
    given = ["Robert", "Katherine", "Pamela", "Oscar", "Walter"]
    people = [(name(4), rng.choice(given), str(rng.randint(1, 400)), f"{name(4)} Road", rng.randint(1930, 2004), rng.choice("MF")) for _ in range(150)]
    a = [(i, *p) for i, p in enumerate(people[:110])] + [(500, *people[60][:3], people[60][3], people[60][4], None)]
    b = []
    for i, (last, first, house, street, year, sex) in enumerate(people[50:]):
        kind = i % 5
        last = last[:3] + last[4:] if kind == 1 else last
        first = {"Robert": "Bob"}.get(first, first[0] + ".") if kind == 2 else first
        house, street = (str(500 + i), "Elsewhere Lane") if kind == 3 else (house, street)
        year = None if kind == 4 else year
        b.append((1000 + 50 + i, last, first, house, street, year, sex))
    b += [(2000, None, None, None, None, None, None), (2001, "", "", "", "", None, "")]
    da, db = spark.createDataFrame(a, PERSON), spark.createDataFrame(b, PERSON).withColumn("side", F.lit("clash"))
    got = match_entities(da, db, _forms(spark), margin=3.0).collect()
    pairs = {(r["idx_a"], r["idx_b"]) for r in got}
    want = {(i, 1000 + i) for i in range(50, 110)} | {(500, 1060)}
    assert len(pairs) == len(got) and all(0 < r["confidence"] <= 1 for r in got)
    assert len(pairs & want) >= len(want) - 2 and len(pairs - want) <= 1
    assert match_entities(da.where("idx < 0"), db, _forms(spark)).count() == 0


def test_windows_go_over_borders(spark):
    """Every pair less than a window apart is compared, however the sorted rows are cut."""
    from linkwright.llm import matching

    class Always(matching.Evidence):
        def of(self, x, y):
            return 1.0

    n = 40
    rows = [(i, 0, "a", "b", "aaa", "bbb", "b", 1970, "M", "1", "str") for i in range(n)]
    df = matching._counted(spark.createDataFrame(rows, matching._FIELDS))
    always = Always({}, Forms([], []), 1.0, n)
    # a pair near two borders may come twice
    got = sorted({(r["i"], r["j"]) for r in matching._window_pairs(df, ("fam", "giv"), n, always, 0.0).collect()})
    assert got == [(i, j) for i in range(n) for j in range(i + 1, min(n, i + WINDOW))]
