"""Comparison of two tables, or of a table with itself."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property, reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.config import LOWER, PREFIX_WEIGHT, UPPER, CompareConfig
from linkwright.operators.grid import grid
from linkwright.operators.indexing import INDEX, with_index
from linkwright.operators.levels import distinct_levels, exact_levels, fuzzy_levels, value_rounds
from linkwright.operators.patterns import combine, gamma_table, n_patterns, radices, strides
from linkwright.operators.probable import probable
from linkwright.store import write

#: Record numbers in a list, of which two make up to a square of it in pairs.
LIST_RECORDS = 1024
#: Pairs of tuples looked at as bits in the time in which a join makes one.
BITS_AS_JOINED = 8192
#: Greatest part of all pairs whose strings are compared one by one.
FEW_PAIRS = 1 / 16


def _known(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}")


class _Once(Sequence):
    """Items made when they are first asked for."""

    def __init__(self, n: int, make: Callable[[int], DataFrame]) -> None:
        self._n, self._make, self._made = n, make, {}

    def __len__(self) -> int:
        return self._n

    def __getitem__(self, k: int) -> DataFrame:
        if not 0 <= k < self._n:
            raise IndexError(k)
        if k not in self._made:
            self._made[k] = self._make(k)
        return self._made[k]


class _Pairs:
    """What both comparisons share: value pairs, record pairs, counts and their guards.

    Counts need no record pairs. Records equal in all variables are one tuple with a multiplicity.
    Pairs that agree in three variables or more are found between tuples, by joins on combinations
    of variables that few pairs share. How many agree in two or in one alone follows from products
    of the numbers of rows of values, less those that agree in others, too. Where values have many
    partners, pairs that agree in two or more are found by words of bits instead.
    """

    def __init__(self, n_fuzzy: int, n_exact: int, compat: bool, block_on: Sequence[str]) -> None:
        radices(n_fuzzy, n_exact)
        self.n_fuzzy, self.n_exact, self.compat, self.block_on = n_fuzzy, n_exact, compat, list(block_on)
        self._cfg: CompareConfig | None = None

    def _begin(self, p: float, lower: float, upper: float) -> None:
        if self._cfg is not None:
            raise RuntimeError("the comparison has already been made")
        self._cfg = CompareConfig(p, lower, upper, self.compat)

    def _fitted(self) -> CompareConfig:
        if self._cfg is None:
            raise RuntimeError("fit must be called first")
        return self._cfg

    @cached_property
    def _values(self) -> _Once:
        """The value pairs of each fuzzy variable, each written once, when it is asked for."""
        made = lambda x, y: write(distinct_levels(self.a, None if self._own else self.b, x, y, self._fitted(), self.block_on), "values").df
        return _Once(self.n_fuzzy, lambda k: made(*self._fuzzy[k]))

    @cached_property
    def pairs(self) -> DataFrame:
        """``idx_a, idx_b, pattern_id`` of all pairs that agree somewhere.

        Patterns are found between tuples; record numbers come in lists, which are opened last, so
        that no pair of records is shuffled.
        """
        cfg, block = self._fitted(), self.block_on
        a, b = self._sides
        other, names = None if self._own else b, [f"x{k}" for k in range(self.n_fuzzy + self.n_exact)]
        levels = [fuzzy_levels(a, other, x, x, cfg, "t", block, v) for x, v in zip(names, self._values)]
        levels += [exact_levels(a, other, x, x, "t", block) for x in names[self.n_fuzzy :]]
        found = combine(levels, self.n_fuzzy, self.n_exact).withColumnsRenamed({"idx_a": "ta", "idx_b": "tb"})
        if self._own:
            found = found.unionByName(a.select(F.col("t").alias("ta"), F.col("t").alias("tb"), self._top().cast("int").alias("pattern_id")).where("pattern_id > 0"))
        lists = lambda side: self._lists(side).withColumnsRenamed({c: f"{c}{side}" for c in ("t", "no", "ids")})
        met = found.join(lists("a"), "ta").join(lists("b"), "tb")
        if self._own:
            # of a tuple with itself each two lists once
            met = met.where("ta <> tb or noa >= nob")
        spread = met.repartition(8 * self.a.sparkSession.sparkContext.defaultParallelism, "ta", "tb", "noa", "nob")
        out = spread.select("pattern_id", "ta", "tb", "noa", "nob", "idsb", F.explode("idsa").alias("i")).select("pattern_id", "ta", "tb", "noa", "nob", "i", F.explode("idsb").alias("j"))
        if not self._own:
            return out.select(F.col("i").alias("idx_a"), F.col("j").alias("idx_b"), "pattern_id")
        return out.where("ta <> tb or noa <> nob or i > j").select(F.greatest("i", "j").alias("idx_a"), F.least("i", "j").alias("idx_b"), "pattern_id")

    def _top(self) -> Column:
        """The pattern of a tuple with itself."""
        levels = radices(self.n_fuzzy, self.n_exact)
        return sum((F.when(F.col(f"x{k}").isNotNull(), (n - 1) * w).otherwise(0) for k, (n, w) in enumerate(zip(levels, strides(levels)))), F.lit(0))

    def _lists(self, side: str) -> DataFrame:
        """``t, no, ids``: the records of each tuple in lists of about ``LIST_RECORDS``."""
        parts = F.ceil(F.col("n") / LIST_RECORDS)
        numbered = self._members(side, "n").withColumn("no", F.pmod(F.xxhash64("idx"), parts).cast("int"))
        return numbered.groupBy("t", "no").agg(F.collect_list("idx").alias("ids"))

    def indices(self, pattern_id: int) -> DataFrame:
        """The pairs of one pattern."""
        return self.pairs.where(F.col("pattern_id") == pattern_id).select("idx_a", "idx_b")

    @cached_property
    def gamma(self) -> DataFrame:
        self._fitted()
        return gamma_table(self.a.sparkSession, self.n_fuzzy, self.n_exact)

    def _tuples(self, side: str) -> DataFrame:
        """``block_on, x0, x1, ..., t, n``: the distinct records of a side, each by its smallest number, with their rows."""
        df, at = (self.a, 0) if side == "a" else (self.b, 1)
        cols = [F.col(v[at]).alias(f"x{k}") for k, v in enumerate([*self._fuzzy, *self._exact])]
        keyed = df.select(*self.block_on, *cols, F.col(INDEX).alias("idx"))
        for c in self.block_on:
            keyed = keyed.where(F.col(c).isNotNull())
        return keyed.groupBy(*[c for c in keyed.columns if c != "idx"]).agg(F.min("idx").alias("t"), F.count(F.lit(1)).alias("n"))

    @cached_property
    def _sides(self) -> tuple[DataFrame, DataFrame]:
        a = write(self._tuples("a"), "tuples").df
        return a, a if self._own else write(self._tuples("b"), "tuples").df

    @cached_property
    def _coded(self) -> tuple[DataFrame, DataFrame, list[DataFrame | None]]:
        """Tuples of both sides, and the value pairs in both directions, with numbers for fuzzy values; one without a partner is null. None stands for equality."""
        return self._code(range(self.n_fuzzy), self.block_on)

    def _code(self, variables: Sequence[int], block: Sequence[str]) -> tuple[DataFrame, DataFrame, list[DataFrame | None]]:
        """The same for some of the fuzzy variables, whose values are compared within ``block``."""
        sides, matching = list(self._sides[: 1 if self._own else 2]), [None] * (self.n_fuzzy + self.n_exact)
        for k in variables:
            known = [t.where(f"x{k} is not null").groupBy(*block, F.col(f"x{k}").alias("v")).agg(F.sum("n").alias("n")) for t in self._sides[: 1 if self._own else 2]]
            names = reduce(DataFrame.union, [t.select("v") for t in known]).distinct()
            names = write(names.withColumn("code", F.monotonically_increasing_id()), "names").df
            # compared with their codes, so that no pair of values is joined with these
            rounds = value_rounds(*[t.join(names, "v") for t in known], *[None] * self._own, self._fitted(), block)
            matching[k] = reduce(DataFrame.unionByName, [write(part, "matching", codec="zstd").df for part in rounds])
            partners = matching[k].select(F.col("v").alias("code")).union(matching[k].select(F.col("w").alias("code"))).distinct()
            codes = write(names.join(partners, "code", "left_semi").select(F.col("v").alias(f"x{k}"), "code"), "codes").df
            sides = [t.join(codes, f"x{k}", "left").drop(f"x{k}").withColumnRenamed("code", f"x{k}") for t in sides]
        sides = [write(t, "coded").df for t in sides]
        return sides[0], sides[-1], matching

    def _products(self, i: int, j: int) -> dict[tuple[int, int], int]:
        """How many pairs of records reach each two levels of two variables; of one table in both orders, each with itself."""
        a, b, matching = self._coded
        block = self.block_on
        # one side goes over to the other's values of one variable, the other side to this one's of the second
        sides = []
        for t, k, own, other in ((a, i, "v", "w"), (b, j, "w", "v")):
            rows = t.where(f"x{i} is not null and x{j} is not null").groupBy(*block, f"x{i}", f"x{j}").agg(F.sum("n").alias("n"))
            if matching[k] is None:
                sides.append(rows.select(*block, f"x{i}", f"x{j}", F.col("n").alias("n1")))
                continue
            met = rows.join(matching[k].select(*block, F.col(own).alias(f"x{k}"), F.col(other).alias("y"), "level"), [*block, f"x{k}"]).drop(f"x{k}").withColumnRenamed("y", f"x{k}")
            sides.append(met.groupBy(*block, f"x{i}", f"x{j}").agg(*[F.sum(F.when(F.col("level") == level, F.col("n")).otherwise(0)).alias(f"n{level}") for level in (1, 2)]))
        left, right = (t.withColumnsRenamed({c: f"{c}{s}" for c in t.columns if c in ("n1", "n2")}) for t, s in zip(sides, "ab"))
        levels = [(x, y) for x in (1, 2) for y in (1, 2) if f"n{x}a" in left.columns and f"n{y}b" in right.columns]
        product = lambda x, y: F.when((F.col(f"n{x}a") > 0) & (F.col(f"n{y}b") > 0), F.col(f"n{x}a").cast("decimal(38,0)") * F.col(f"n{y}b"))
        sums = left.join(right, [*block, f"x{i}", f"x{j}"]).agg(*[F.coalesce(F.sum(product(x, y)), F.lit(0)).alias(f"s{x}{y}") for x, y in levels])
        row = write(sums, "products").df.first()
        return {(x, y): int(row[f"s{x}{y}"]) for x, y in levels}

    @cached_property
    def _sizes(self) -> tuple[int, int]:
        """Tuples of both sides."""
        n = self._sides[0].count()
        return n, n if self._own else self._sides[1].count()

    @cached_property
    def _by_bits(self) -> bool:
        """Whether looking at all pairs of tuples, 64 at a time, costs less than joins on two variables."""
        fields = [t.schema[f"x{k}"].dataType.simpleString() for t in self._sides for k in range(self.n_fuzzy + self.n_exact)]
        same = fields[: len(fields) // 2] == fields[len(fields) // 2 :]
        # codes of exact values go over as they are
        if self.block_on or len(fields) < 4 or not same or not set(fields[self.n_fuzzy : len(fields) // 2]) <= {"tinyint", "smallint", "int"}:
            return False
        pairs, total = float(self._sizes[0]) * self._sizes[1], max(1, int(self._total().first()[0]))
        share = [sum(n for (k, _), n in self._reached.items() if k == v) / total for v in range(self.n_fuzzy + self.n_exact)]
        agreeing = pairs * sum(x * y for x, y in combinations(share, 2))
        return agreeing <= pairs / 64 and pairs / BITS_AS_JOINED <= agreeing + sum(self._sizes)

    def _grid(self, wanted: Sequence[int] | None = None) -> list[DataFrame]:
        a, b, matching = self._coded
        return grid(a, b, matching, strides(radices(self.n_fuzzy, self.n_exact)), self._sizes, wanted)

    def _patterned(self, cover: Sequence[Sequence[int]]) -> list[DataFrame]:
        """``ta, tb, na, nb, pattern_id`` for each combination of variables: pairs of tuples that agree in all of these, and not in all of one before; of one table in both orders, each with itself."""
        a, b, matching = self._coded
        weights, block = strides(radices(self.n_fuzzy, self.n_exact)), self.block_on
        size, parts = len(weights), []
        for at, combination in enumerate(cover):
            known = " and ".join(f"x{k} is not null" for k in combination)
            left, right = (t.where(known).select(*block, F.col("t").alias(f"t{s}"), F.col("n").alias(f"n{s}"), *[F.col(f"x{k}").alias(f"{s}{k}") for k in range(size)]) for t, s in ((a, "a"), (b, "b")))
            fuzzy = [k for k in combination if matching[k] is not None]
            # one side goes over to the other's values of one variable, the other side to this one's of the second
            for k in combination:
                if k in fuzzy[1:]:
                    right = right.join(matching[k].select(*block, F.col("w").alias(f"b{k}"), F.col("v").alias(f"a{k}"), F.col("level").alias(f"l{k}")), [*block, f"b{k}"]).drop(f"b{k}")
                elif k in fuzzy:
                    left = left.join(matching[k].select(*block, F.col("v").alias(f"a{k}"), F.col("w").alias("y"), F.col("level").alias(f"l{k}")), [*block, f"a{k}"]).drop(f"a{k}").withColumnRenamed("y", f"a{k}")
                    right = right.withColumnRenamed(f"b{k}", f"a{k}")
                else:
                    left, right = left.withColumn(f"l{k}", F.lit(1)), right.withColumnRenamed(f"b{k}", f"a{k}")
            out = left.join(right, [*block, *[f"a{k}" for k in combination]]).drop(*[f"a{k}" for k in combination])
            for k in [k for k in range(size) if k not in combination]:
                if matching[k] is None:
                    out = out.withColumn(f"l{k}", F.coalesce((F.col(f"a{k}") == F.col(f"b{k}")).cast("int"), F.lit(0)))
                else:
                    out = out.join(matching[k].select(*block, F.col("v").alias(f"a{k}"), F.col("w").alias(f"b{k}"), F.col("level").alias(f"l{k}")), [*block, f"a{k}", f"b{k}"], "left").fillna(0, [f"l{k}"])
                out = out.drop(f"a{k}", f"b{k}")
            for before in cover[:at]:
                out = out.where(reduce(lambda x, y: x | y, [F.col(f"l{k}") == 0 for k in before]))
            parts.append(out.select("ta", "tb", "na", "nb", sum((F.col(f"l{k}") * w for k, w in enumerate(weights)), F.lit(0)).cast("int").alias("pattern_id")))
        return parts

    def _alone(self, coded: tuple[DataFrame, DataFrame, list[DataFrame | None]], variables: Sequence[int], block: Sequence[str]) -> DataFrame:
        """``variable, level, n``: how many pairs of records reach each level of each variable; of fuzzy ones each pair of values has its number."""
        a, b, matching = coded
        parts, product = [], F.col("na").cast("decimal(38,0)") * F.col("nb")
        for k in variables:
            match, keys = matching[k], [*block, f"x{k}"]
            rows = lambda t, name: t.where(F.col(f"x{k}").isNotNull()).groupBy(*keys).agg(F.sum("n").alias(name))  # noqa: E731, B023
            if match is None:
                met, n = rows(a, "na").join(rows(b, "nb"), keys).withColumn("level", F.lit(1)), product
            else:
                met, n = match, F.col("n").cast("decimal(38,0)")
            parts.append(met.groupBy("level").agg(F.sum(n).alias("n")).select(F.lit(k).alias("variable"), "level", "n"))
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def _reached(self) -> dict[tuple[int, int], int]:
        """How many pairs of records reach each variable's level."""
        return {(r["variable"], r["level"]): int(r["n"]) for r in self._alone(self._coded, range(self.n_fuzzy + self.n_exact), self.block_on).collect()}

    @cached_property
    def Counts(self) -> np.ndarray:  # noqa: N802
        """The counts as a vector in order of patterns."""
        self._fitted()
        levels = radices(self.n_fuzzy, self.n_exact)
        weights, size = strides(levels), n_patterns(self.n_fuzzy, self.n_exact)
        found = [0] * size
        variables = range(len(levels))
        digit = lambda p, k: p // weights[k] % levels[k]
        for part in self._grid() if self._by_bits else []:
            summed = part.groupBy("pattern_id").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
            for r in write(summed, "found").df.collect():
                found[r["pattern_id"]] += int(r["n"])
        cover = [] if self._by_bits else self._cover({frozenset(c) for r in variables[3:] for c in combinations(variables, r)} | ({frozenset(variables)} if len(levels) > 2 else set()))
        for part in self._patterned(cover):
            summed = part.groupBy("pattern_id").agg(F.sum(F.col("na").cast("decimal(38,0)") * F.col("nb")).alias("n"))
            for r in write(summed, "found").df.collect():
                found[r["pattern_id"]] += int(r["n"])
        for i, j in [] if self._by_bits else combinations(variables, 2):
            if (i, j) not in cover:
                for (x, y), n in self._products(i, j).items():
                    alone = x * weights[i] + y * weights[j]
                    found[alone] = n - sum(found[p] for p in range(size) if digit(p, i) == x and digit(p, j) == y and p != alone)
        for (k, level), n in self._reached.items():
            found[level * weights[k]] = n - sum(found[p] for p in range(size) if digit(p, k) == level and p != level * weights[k])
        if self._own:
            # every pair has come twice, and every record with itself
            for r in self._sides[0].groupBy(self._top().alias("p")).agg(F.sum("n").alias("n")).collect():
                found[r["p"]] -= r["n"]
            found = [n // 2 for n in found]
        found[0] = int(self._total().first()[0]) - sum(found[1:])
        return np.array(found, np.int64)

    @cached_property
    def counts(self) -> DataFrame:
        """``pattern_id, count`` of every pattern."""
        return self.a.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(self.Counts)], "pattern_id int, count long")

    def chosen(self, patterns: Sequence[int]) -> DataFrame:
        """``idx_a, idx_b, pattern_id`` of the pairs of some patterns; the pairs of others are not made if all of these agree in two variables or more."""
        levels = radices(self.n_fuzzy, self.n_exact)
        agreeing = {frozenset(k for k, (w, n) in enumerate(zip(strides(levels), levels)) if p // w % n) for p in patterns}
        if not patterns or any(len(s) < 2 for s in agreeing):
            return self.pairs.where(F.col("pattern_id").isin(list(patterns)))
        few = self._few(agreeing)
        part = self._probable(few, patterns) if few else None
        if part is not None:
            parts = [part]
        else:
            parts = self._grid(patterns) if self._by_bits else self._patterned(self._cover(agreeing))
        kept = [write(part.where(F.col("pattern_id").isin(list(patterns))), "chosen").df for part in parts]
        tuples = reduce(DataFrame.unionByName, [part.select("ta", "tb", "pattern_id") for part in kept])
        a, b = self._members("a"), self._members("b")
        out = tuples.join(a.select(F.col("t").alias("ta"), F.col("idx").alias("idx_a")), "ta").join(b.select(F.col("t").alias("tb"), F.col("idx").alias("idx_b")), "tb")
        return (out.where("idx_a > idx_b") if self._own else out).select("idx_a", "idx_b", "pattern_id")

    @cached_property
    def _distinct(self) -> dict[int, float]:
        """How many pairs of distinct values each fuzzy variable has."""
        a, b = (t.agg(*[F.approx_count_distinct(f"x{k}").alias(f"x{k}") for k in range(self.n_fuzzy)]).first() for t in self._sides)
        return {k: float(a[k]) * b[k] for k in range(self.n_fuzzy)}

    def _few(self, agreeing: set[frozenset[int]]) -> list[int]:
        """Variables with few distinct values of which every set holds two or more; none if no comparison of values is saved."""
        a, b = self._sides
        # where all values have been compared, nothing is left to save
        if self._own or not self.compat or "_coded" in self.__dict__:
            return []
        exact = range(self.n_fuzzy, self.n_fuzzy + self.n_exact)
        # codes of exact values go over as they are
        if any(a.schema[f"x{k}"].dataType != b.schema[f"x{k}"].dataType or a.schema[f"x{k}"].dataType.simpleString() not in ("tinyint", "smallint", "int") for k in exact):
            return []
        order = [*exact, *sorted(range(self.n_fuzzy), key=self._distinct.get)]
        return sorted(next((order[:n] for n in range(2, len(order)) if all(len(s.intersection(order[:n])) >= 2 for s in agreeing)), []))

    def _probable(self, few: Sequence[int], patterns: Sequence[int]) -> DataFrame | None:
        """``ta, tb, pattern_id`` of the pairs of some patterns; None if too many pairs agree in two of the few variables."""
        levels = radices(self.n_fuzzy, self.n_exact)
        coded = self._code([k for k in few if k < self.n_fuzzy], ())
        total = max(1, self.a.count() * self.b.count())
        share = dict.fromkeys(few, 0.0)
        for r in self._alone(coded, few, ()).collect():
            share[r["variable"]] += float(r["n"]) / total
        # within a block all pairs agree in what makes it
        share |= {k: 1.0 for k in few if k >= self.n_fuzzy and len(set(self._exact[k - self.n_fuzzy])) == 1 and self._exact[k - self.n_fuzzy][0] in self.block_on}
        if sum(x * y for x, y in combinations(share.values(), 2)) > FEW_PAIRS:
            return None
        a, b, matching = coded
        return probable(a, b, matching, few, strides(levels), levels, patterns, self._fitted(), self.block_on)

    def _cover(self, agreeing: set[frozenset[int]]) -> list[tuple[int, ...]]:
        """Combinations of variables with few pairs, up to two fuzzy ones and any exact ones in each, so that every set holds one of them."""
        number, size = dict.fromkeys(range(self.n_fuzzy + self.n_exact), 0), max(1, int(self._total().first()[0]))
        for (k, _), n in self._reached.items():
            number[k] += n
        usable = [c for r in range(2, 3 + self.n_exact) for c in combinations(number, r) if sum(k < self.n_fuzzy for k in c) <= 2 and any(s.issuperset(c) for s in agreeing)]
        # each costs the rows to be joined besides its pairs
        cost = {c: float(np.prod([number[k] / size for k in c])) * size + size**0.5 for c in usable}
        left, taken = set(agreeing), []
        while left:
            best = min(usable, key=lambda c: cost[c] / max(sum(s.issuperset(c) for s in left), 1e-9))
            taken.append(best)
            left = {s for s in left if not s.issuperset(best)}
        for c in list(taken):
            others = [x for x in taken if x != c]
            if all(any(s.issuperset(x) for x in others) for s in agreeing):
                taken = others
        return taken

    def _members(self, side: str, *more: str) -> DataFrame:
        """``t, idx``: the records of each tuple; with other columns of the tuples, if asked for."""
        df, at = (self.a, 0) if side == "a" else (self.b, 1)
        tuples = self._sides[at]
        rows = df.select(*self.block_on, *[F.col(v[at]).alias(f"__x{k}") for k, v in enumerate([*self._fuzzy, *self._exact])], F.col(INDEX).alias("idx"))
        same = reduce(lambda x, y: x & y, [rows[c].eqNullSafe(tuples[c]) for c in self.block_on] + [rows[f"__x{k}"].eqNullSafe(tuples[f"x{k}"]) for k in range(self.n_fuzzy + self.n_exact)])
        return rows.join(tuples, same).select(tuples["t"], rows["idx"], *[tuples[c] for c in more])


class Comparison(_Pairs):
    """All pairs of records of two tables.

    ``block_on`` names columns of both tables which must be equal for a pair to be compared at all.
    Records are numbered by ``order_by_a`` and ``order_by_b``, or by the columns ``index_a`` and
    ``index_b`` if given. Nulls agree with nothing; an empty table gives no pairs.
    """

    def __init__(self, df_a: DataFrame, df_b: DataFrame, fuzzy_a: Sequence[str], fuzzy_b: Sequence[str], exact_a: Sequence[str] = (), exact_b: Sequence[str] = (), *, block_on: Sequence[str] = (), index_a: str | None = None, index_b: str | None = None, order_by_a: str | Sequence[str] | None = None, order_by_b: str | Sequence[str] | None = None, compat: bool = True) -> None:
        if len(fuzzy_a) != len(fuzzy_b):
            raise ValueError("the lists of fuzzy variables differ in length")
        if len(exact_a) != len(exact_b):
            raise ValueError("the lists of exact variables differ in length")
        _known(df_a, [*fuzzy_a, *exact_a, *block_on])
        _known(df_b, [*fuzzy_b, *exact_b, *block_on])
        super().__init__(len(fuzzy_a), len(exact_a), compat, block_on)
        self.a = df_a.withColumn(INDEX, F.col(index_a).cast("long")) if index_a else with_index(df_a, order_by_a)
        self.b = df_b.withColumn(INDEX, F.col(index_b).cast("long")) if index_b else with_index(df_b, order_by_b)
        self.fuzzy, self.exact = list(zip(fuzzy_a, fuzzy_b)), list(zip(exact_a, exact_b))
        self._fuzzy, self._exact, self._own = self.fuzzy, self.exact, False

    def fit(self, p: float = PREFIX_WEIGHT, lower: float = LOWER, upper: float = UPPER, num_threads: int = 256, max_chunk_size: float = 2.0) -> Comparison:
        """Plan the comparison; the last two parameters are accepted and have no meaning here."""
        self._begin(p, lower, upper)
        return self

    def _total(self) -> DataFrame:
        keys = self.block_on
        n_a, n_b = self.a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_a")), self.b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_b"))
        both = n_a.join(n_b, keys) if keys else n_a.join(F.broadcast(n_b), F.lit(True))
        return both.agg(F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).alias("total"))


class Deduplication(_Pairs):
    """All pairs of records of one table, the larger number first.

    With ``compat`` the total of pairs, and so the count of pattern 0, includes each record with
    itself. See ``Comparison`` for the other parameters.
    """

    def __init__(self, df: DataFrame, fuzzy: Sequence[str], exact: Sequence[str] = (), *, block_on: Sequence[str] = (), index: str | None = None, order_by: str | Sequence[str] | None = None, compat: bool = True) -> None:
        _known(df, [*fuzzy, *exact, *block_on])
        super().__init__(len(fuzzy), len(exact), compat, block_on)
        self.a = df.withColumn(INDEX, F.col(index).cast("long")) if index else with_index(df, order_by)
        self.b = self.a
        self.fuzzy, self.exact = list(fuzzy), list(exact)
        self._fuzzy, self._exact, self._own = [(x, x) for x in fuzzy], [(x, x) for x in exact], True

    def fit(self, p: float = PREFIX_WEIGHT, lower: float = LOWER, upper: float = UPPER, num_threads: int = 256, max_chunk_size: float = 2.0) -> Deduplication:
        """Plan the comparison; the last two parameters are accepted and have no meaning here."""
        self._begin(p, lower, upper)
        return self

    def _total(self) -> DataFrame:
        sizes = self.a.dropna(subset=self.block_on).groupBy(*self.block_on).agg(F.count(F.lit(1)).alias("n")) if self.block_on else self.a.agg(F.count(F.lit(1)).alias("n"))
        more = F.lit(1 if self.compat else -1)
        return sizes.agg(F.coalesce(F.sum(F.expr("n") * (F.col("n") + more)), F.lit(0)).alias("twice")).select(F.expr("twice div 2").alias("total"))


def intersect_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs in both sets."""
    return a.select("idx_a", "idx_b").intersect(b.select("idx_a", "idx_b"))


def setdiff_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs in the first set and not in the second."""
    return a.select("idx_a", "idx_b").subtract(b.select("idx_a", "idx_b"))


def union_pairs(*sets: DataFrame) -> DataFrame:
    """Pairs in any of the sets."""
    return reduce(DataFrame.unionByName, [s.select("idx_a", "idx_b") for s in sets]).distinct()
