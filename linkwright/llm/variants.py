"""Variant spellings of names (problem 1).

Words of names are points of a metric space with edit distance. Within each stratum, the records
that can be of one person at all, pivots are drawn by hash, the more of them the more words there
are; every word goes to the cell of its nearest pivot, and by the triangle inequality to each cell
whose pivot is not more than twice the radius farther; two words within the radius always meet in
the home cell of either. Inside a cell only words whose distances to the pivot differ by the radius
or less are compared.

Strata that fit into one row are split into cells and joined in memory, many strata at once; larger
ones by joins, cells that are still large being split again, so that the pivots make a tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.functions.text import bare
from linkwright.llm.metric import PIVOT_PART, close_words
from linkwright.llm.names import INITIAL, SLIP, Forms, Name, compare_family, compare_given, same_letters
from linkwright.operators.skew import annotate_groups
from linkwright.store import write

#: Accented letters and what they are compared as.
_ACCENTED = "áàâäãåāăąçćčďèéêëēęěğìíîïīłñńňòóôöõøōőřśšşťùúûüūůűýÿžźż"
_PLAIN = "aaaaaaaaacccdeeeeeeegiiiiilnnnoooooooorssstuuuuuuuyyzzz"

#: Records of a stratum that may stand in one row.
ROW_RECORDS = 256
#: Pivots of one level of the tree, and words from which on a cell is split again.
LEVEL_PIVOTS, CELL_WORDS = 32, 1_000
#: Comparisons for each salt of a cell.
SALT_WORK = 5_000_000


def folded(c: Column) -> Column:
    return F.translate(F.lower(c), _ACCENTED, _PLAIN)


def name_words(*fields: str) -> Column:
    """Distinct folded words, and each field without its gaps."""
    parts = []
    for f in fields:
        text = F.regexp_replace(folded(F.coalesce(F.col(f), F.lit(""))), "['’`´]", "")
        parts += [F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), 1), F.array(F.regexp_replace(text, r"[^\p{L}]", ""))]
    return F.filter(F.array_distinct(F.concat(*parts)), lambda w: F.length(w) >= 1)


def _split(cells: DataFrame, radius: int, level: int, n: int) -> DataFrame:
    """``stratum, above, cell, word, d, home``: the cells below the given ones, which are ``above`` them."""
    h = F.pmod(F.xxhash64("word", F.lit(level)), F.lit(1 << 40))
    sized = annotate_groups(cells.withColumn("h", h), ["stratum", "cell"], [F.min("h").alias("least")], n, min_rows=1)
    share = F.least(1 / (F.sqrt("group_rows") * PIVOT_PART), F.lit(float(LEVEL_PIVOTS)) / F.col("group_rows"))
    pivots = sized.where((F.col("h") == F.col("least")) | (F.col("h") < share * float(1 << 40))).select("stratum", "cell", F.col("word").alias("pivot"))
    met = sized.select("stratum", "cell", "word", "home").join(pivots, ["stratum", "cell"]).withColumn("d", F.levenshtein("word", "pivot"))
    # about LEVEL_PIVOTS of them at most
    near = met.groupBy("stratum", "cell", "word", "home").agg(F.min(F.struct("d", "pivot")).alias("near"), F.collect_list(F.struct("d", "pivot")).alias("all"))
    below = near.withColumn("c", F.explode(F.filter("all", lambda c: c["d"] <= F.col("near.d") + 2 * radius)))
    return below.select("stratum", F.col("cell").alias("above"), F.xxhash64("cell", "c.pivot").alias("cell"), "word", F.col("c.d").alias("d"), (F.col("home") & (F.col("near.pivot") == F.col("c.pivot"))).alias("home"))


def metric_cells(words: DataFrame, radius: int = 2) -> DataFrame:
    """``stratum, cell, word, d, home, work``: the words of each stratum in cells of a tree of pivots.

    ``d`` is the distance to the cell's pivot. A cell with more than ``CELL_WORDS`` words is split
    again by pivots of its own. A split counts if it halves the comparisons to be made; where words
    lie so near to each other that they all go to all cells, the cell stays whole. ``work`` is the
    number of comparisons of the cell.
    """
    points = words.where("stratum is not null and word is not null").select("stratum", "word").distinct()
    now = write(points.select("stratum", F.lit(0).cast("long").alias("cell"), "word", F.lit(0).alias("d"), F.lit(True).alias("home")), "cells")
    done, level = [], 0
    work = F.sum(F.col("home").cast("long")) * F.count(F.lit(1))
    while n := now.df.count():
        below = write(_split(now.df, radius, level, n), "cells")
        sizes = below.df.groupBy("stratum", "above", "cell").agg(work.alias("work"), F.count(F.lit(1)).alias("n"))
        new = sizes.groupBy("stratum", "above").agg(F.sum("work").alias("new")).withColumnRenamed("above", "cell")
        old = now.df.groupBy("stratum", "cell").agg(work.alias("work"))
        verdict = write(old.join(new, ["stratum", "cell"]).withColumn("split", 2 * F.col("new") <= F.col("work")), "verdict").df
        done.append(now.df.join(verdict.where("not split").select("stratum", "cell", "work"), ["stratum", "cell"]))
        good = verdict.where("split").select("stratum", F.col("cell").alias("above"))
        made = write(below.df.join(sizes.join(good, ["stratum", "above"], "left_semi"), ["stratum", "above", "cell"]).drop("above"), "made").df
        done.append(made.where(F.col("n") <= CELL_WORDS).drop("n"))
        now, level = write(made.where(F.col("n") > CELL_WORDS).drop("n", "work"), "cells"), level + 1
        below.drop()
    columns = ["stratum", "cell", "word", "d", "home", "work"]
    out = points.select("stratum", F.lit(0).cast("long").alias("cell"), "word", F.lit(0).alias("d"), F.lit(True).alias("home"), F.lit(0).cast("long").alias("work")).limit(0)
    for d in done:
        out = out.unionByName(d.select(*columns))
    return out


def metric_variants(words: DataFrame, radius: int = 2) -> DataFrame:
    """``stratum, x, y``: all pairs of words of a stratum within ``radius`` edits, ``x < y``.

    ``words`` has ``stratum`` and ``word``; repeated rows count once, nulls are left out. The result
    is exact for Levenshtein distance; equal words are no pair. Words meet by their distances to the
    pivot, and cells with much work are spread over salts.
    """
    cells = write(metric_cells(words, radius), "cells").df
    salts = F.least(F.lit(512), 1 + F.floor(F.col("work") / SALT_WORK)).cast("int")
    left = cells.where("home").select("stratum", "cell", F.pmod(F.xxhash64("word", F.lit(7)), salts).cast("int").alias("salt"), F.col("d").alias("at"), F.col("word").alias("x"))
    right = cells.select("stratum", "cell", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("word").alias("y"), "d").withColumn("at", F.explode(F.sequence(F.col("d") - radius, F.col("d") + radius))).drop("d")
    met = left.join(right, ["stratum", "cell", "salt", "at"]).where((F.col("x") != F.col("y")) & (F.abs(F.length("x") - F.length("y")) <= radius))
    close = met.where(F.levenshtein("x", "y", radius) >= 0)
    return close.select("stratum", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def variants_in_rows(radius: int, forms_rows: list[tuple[str, str]], given: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function on Arrow batches with a stratum's records in each row, that finds and judges its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Forms(forms_rows, given)
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            stratum = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            idx, last, first, gender, words, bare_name = (flat.field(i).to_pylist() for i in range(6))
            # records of one stratum under one name, spelt alike, are one point
            spelt: dict[tuple, list[int]] = {}
            for row, key in enumerate(zip(stratum, last, first, gender)):
                spelt.setdefault(key, []).append(row)
            holders: dict[tuple[int, str], list[int]] = {}
            of = list(spelt.values())
            for name, rows in enumerate(of):
                for w in words[rows[0]]:
                    holders.setdefault((stratum[rows[0]], w), []).append(name)
            points = sorted(holders)
            x, y, _ = close_words([w for _, w in points], np.array([g for g, _ in points], np.int64), radius)
            met = set()
            for a, b in zip(x.tolist(), y.tolist()):
                for i in holders[points[a]]:
                    for j in holders[points[b]]:
                        if i != j:
                            met.add((i, j) if i < j else (j, i))
            for names in holders.values():
                for at, i in enumerate(names):
                    met.update((i, j) for j in names[at + 1 :])
            rep = [rows[0] for rows in of]
            parsed: dict[int, Name] = {}

            def name(i: int) -> Name:
                if i not in parsed:
                    parsed[i] = Name(last[rep[i]], first[rep[i]], forms)
                return parsed[i]

            sure, alone = [], {}
            for i, j in met:
                kind = one_person(name(i), name(j), gender[rep[i]], gender[rep[j]], forms)
                if kind == SURE:
                    sure.append((i, j))
                elif kind == ALONE:
                    for u, v in ((i, j), (j, i)):
                        if not name(u).family:
                            alone.setdefault(u, []).append(v)
            for u, partners in alone.items():
                if one_family([" ".join(name(v).family) for v in partners], forms):
                    sure += [(min(u, v), max(u, v)) for v in partners]
            left, right = [], []
            for i, j in set(sure):
                # equal but for formatting
                if bare_name[rep[i]] == bare_name[rep[j]]:
                    continue
                for p in of[i]:
                    for q in of[j]:
                        left.append(min(idx[p], idx[q]))
                        right.append(max(idx[p], idx[q]))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["idx_1", "idx_2"])

    return run


def judge(forms_rows: list[tuple[str, str]], given: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function on Arrow batches that adds how sure it is that two names are one person's, and their families."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Forms(forms_rows, given)
        for batch in batches:
            la, fa, ga, lb, fb, gb = (batch.column(i).to_pylist() for i in range(2, 8))
            kind, of_a, of_b = [], [], []
            for i in range(len(la)):
                a, b = Name(la[i], fa[i], forms), Name(lb[i], fb[i], forms)
                kind.append(one_person(a, b, ga[i], gb[i], forms))
                of_a.append(" ".join(a.family))
                of_b.append(" ".join(b.family))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kind, pa.int32()), pa.array(of_a, pa.string()), pa.array(of_b, pa.string())], ["c1", "c2", "kind", "f1", "f2"])

    return run


#: Two names are not one person's; they are; they are if only one family of the stratum has the given name.
OTHER, SURE, ALONE = 0, 1, 2


def one_person(a: Name, b: Name, gender_a: str | None, gender_b: str | None, forms: Forms) -> int:
    """Whether two names of one birth year and one address are one person's."""
    other_gender = gender_a is not None and gender_b is not None and gender_a != gender_b
    if same_letters(a, b, forms):
        return SURE
    family, given = compare_family(a, b, forms), compare_given(a, b, forms)
    if family >= INITIAL and given >= INITIAL:
        return SURE if not (other_gender and given < SLIP) else OTHER
    if other_gender:
        return OTHER
    bare_given = lambda x: not x.given and not x.initials
    if family >= SLIP and (bare_given(a) or bare_given(b)):
        return SURE
    if given >= SLIP and not (a.family and b.family):
        return ALONE
    return OTHER


def one_family(families: Sequence[str], forms: Forms) -> bool:
    """All family names, given by their words, agree with the shortest of them."""
    some = sorted({f for f in families if f}, key=lambda f: (len(f), f))
    return all(compare_family(Name(some[0], None, forms), Name(f, None, forms), forms) for f in some[1:])


def strata() -> Column:
    """Birth year and bare address in one string."""
    return F.concat_ws("|", "birth_year", F.concat(bare("house_number"), bare("street_name")))


def name_knowledge(records: DataFrame, together: DataFrame, forms: DataFrame, given_share: float = 0.0025, support: int = 3, part: float = 0.2) -> tuple[list[tuple[str, str]], list[str]]:
    """Pairs of a given name and another form of it, and the given names themselves.

    Given names are the first names which at least ``given_share`` of the records have, fewer than
    its inverse, and more records than have them for a last name; the share is the same at every
    size. Forms are those of the table and others mined from the records: a word which among records
    of one last name, birth year and address stands beside the same given name ``support`` times or
    more, and in ``part`` of its cases; relatives have many given names. A form must occur in one of
    a million records at least, which bounds their number. ``together`` has ``stratum, last_name,
    first_name`` of the records that may share a birth year and an address.
    """
    word = lambda c: F.replace(F.regexp_replace(folded(c), r"\P{L}+", ""), F.lit("rn"), F.lit("m"))
    total = records.count()
    # both fields in one pass; a family name that often stands in the wrong field is no given name
    fields = records.select(F.explode(F.array(F.struct(word(F.col("first_name")).alias("w"), F.lit(1).alias("f")), F.struct(word(F.col("last_name")).alias("w"), F.lit(0).alias("f")))).alias("x")).select("x.*")
    often = fields.where(F.length("w") > 2).groupBy("w").agg(F.sum("f").alias("n_first"), F.sum(1 - F.col("f")).alias("n_last"))
    given = [r["w"] for r in often.where((F.col("n_first") >= given_share * total) & (F.col("n_first") > F.col("n_last"))).collect()]
    known = [(r["formal_name"], r["other_form"]) for r in forms.where("formal_name is not null and other_form is not null").collect()]
    at = together.where("stratum not like '%|'").select("stratum", bare("last_name").alias("l"), word(F.col("first_name")).alias("w")).where("l <> '' and length(w) > 1").select(F.xxhash64("stratum", "l").alias("of"), "w").distinct()
    names = F.broadcast(records.sparkSession.createDataFrame([(g,) for g in given], "w string"))
    rare, full = at.join(names, "w", "left_anti"), at.join(names, "w", "left_semi").withColumnRenamed("w", "g")
    met = rare.join(full, "of").groupBy("w", "g").agg(F.count(F.lit(1)).alias("c"))
    whole = F.sum("c").over(Window.partitionBy("w"))
    mined = met.withColumn("whole", whole).where((F.col("c") >= max(support, 1e-6 * total)) & (F.col("c") >= part * F.col("whole")))
    return known + [(r["g"], r["w"]) for r in mined.select("g", "w").collect()], given


def _large_strata(rows: DataFrame, n: int, known: list[tuple[str, str]], given: list[str], radius: int) -> DataFrame:
    """``idx_1, idx_2`` of strata that no row may hold, by joins between distinct names."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("\x00"))
    keys = ["stratum", "k_last", "k_first", "k_gender"]
    keyed = rows.drop("group_rows").withColumns({"k_last": blank("last_name"), "k_first": blank("first_name"), "k_gender": blank("gender")})
    named = write(annotate_groups(keyed, keys, [F.min("idx").alias("c")], n, min_rows=1).drop(*keys[1:], "group_rows"), "named").df
    names = named.where("idx = c")
    tokens = write(names.select("c", "stratum", F.explode("words").alias("word")), "words").df
    same = tokens.select("stratum", F.col("word").alias("x"), F.col("word").alias("y")).distinct()
    by = lambda i: tokens.select("stratum", F.col("word").alias("xy"[i]), F.col("c").alias(f"i{i}"))
    either = metric_variants(tokens, radius).unionByName(same)
    met = either.join(by(0), ["stratum", "x"]).join(by(1), ["stratum", "y"]).where("i0 <> i1").select(F.least("i0", "i1").alias("c1"), F.greatest("i0", "i1").alias("c2")).distinct()
    side = lambda i: names.select(F.col("c").alias(f"c{i}"), *[F.col(x).alias(f"{x}_{i}") for x in ("last_name", "first_name", "gender")])
    both = met.join(side(1), "c1").join(side(2), "c2").select("c1", "c2", *[f"{x}_{i}" for i in (1, 2) for x in ("last_name", "first_name", "gender")])
    judged = write(both.mapInArrow(judge(known, given), "c1 bigint, c2 bigint, kind int, f1 string, f2 string").where(f"kind <> {OTHER}"), "judged").df
    turned = judged.where(f"kind = {ALONE}").select("c1", "c2", F.explode(F.array(F.struct(F.col("c1").alias("u"), F.col("f1").alias("own"), F.col("f2").alias("f")), F.struct(F.col("c2").alias("u"), F.col("f2").alias("own"), F.col("f1").alias("f")))).alias("x")).select("c1", "c2", "x.*").where("own = ''")
    shortest = turned.where("f <> ''").groupBy("u").agg(F.min(F.struct(F.length("f").alias("n"), "f")).alias("s")).select("u", F.col("s.f").alias("s"))
    against = turned.where("f <> ''").join(shortest, "u").where("f <> s").select("u", "s", "f").distinct()

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Forms(known, given)
        for batch in batches:
            two = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield batch.select(["u"]).filter(pa.array([not one_family(x, made) for x in two], pa.bool_()))

    several = against.mapInArrow(differ, "u bigint").distinct()
    sure = judged.where(f"kind = {SURE}").select("c1", "c2").unionByName(turned.join(several, "u", "left_anti").select("c1", "c2")).distinct()
    of = lambda i: named.select(F.col("c").alias(f"c{i}"), F.col("idx").alias(f"i{i}"), F.col("name").alias(f"name_{i}"))
    # names that are equal but for formatting are no variants
    return sure.join(of(1), "c1").join(of(2), "c2").where("name_1 <> name_2").select(F.least("i1", "i2").alias("idx_1"), F.greatest("i1", "i2").alias("idx_2"))


def name_variants(records: DataFrame, forms: DataFrame, radius: int = 2, id_col: str = "idx", row_records: int = ROW_RECORDS) -> DataFrame:
    """``idx_1, idx_2``: records of one birth year and one bare address under other names of one person.

    ``records`` has ``id_col, last_name, first_name, house_number, street_name, birth_year, gender``;
    ``forms`` has ``formal_name, other_form``. Records without a birth year are in no pair. Two
    records are judged if a word of one name is within ``radius`` edits of a word of the other;
    equal words count. Names with equal bare last and first names, in either order, are no variants.
    Missing and empty fields have no words. A given name without a family name joins those of the
    stratum who have it if they are of one family. Strata of more than ``row_records`` records are
    worked on by joins, with the same result.
    """
    total = records.count()
    name = F.xxhash64(F.least("b_last", "b_first"), F.greatest("b_last", "b_first"))
    rows = records.where("birth_year is not null").select(F.col(id_col).alias("idx"), "last_name", "first_name", "gender", strata().alias("stratum"), bare("last_name").alias("b_last"), bare("first_name").alias("b_first"))
    rows = rows.select("idx", "last_name", "first_name", "gender", "stratum", name.alias("name"))
    mixed = annotate_groups(rows, ["stratum"], [F.min("name").alias("n0"), F.max("name").alias("n1")], total, by_hash=True).where("n0 <> n1")
    kept = write(mixed.select("idx", "last_name", "first_name", "gender", "stratum", "name", "group_rows"), "strata").df
    known, given = name_knowledge(records, kept, forms)
    worded = kept.withColumn("words", name_words("last_name", "first_name"))
    small = worded.where(F.col("group_rows") <= row_records).groupBy("stratum").agg(F.collect_list(F.struct("idx", "last_name", "first_name", "gender", "words", "name")).alias("all"))
    found = small.select("all").mapInArrow(variants_in_rows(radius, known, given), "idx_1 bigint, idx_2 bigint")
    large = worded.where(F.col("group_rows") > row_records)
    n = large.count()
    if n:
        found = found.unionByName(_large_strata(large, n, known, given, radius))
    return found
