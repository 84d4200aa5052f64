"""Entities matched across sources without keys (problem 5).

Records of all sources stand in order of several composite keys; in each order every record is
compared with its neighbours in a sliding window; records of one birth year and given name whose family
names differ by one slip are joined exactly, however many stand between them. A comparison adds up bits of evidence: an
agreement counts the more, the rarer the value. Strong matches join records into entities, weaker ones
within a source join those of repeated records; the parts of entities in either source are then matched
by the weaker ones between the sources, one to one, so that the evidence adds up to the most.

Why windows need not grow with the tables: names and a year that many records share are no evidence.
What may match without an agreeing place is expected to be alone, or nearly so, with its three values.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.addresses import parse_addresses
from linkwright.llm.components import connected_components
from linkwright.llm.metric import Words
from linkwright.llm.names import INITIAL, NONE, SAME, SLIP, Forms, Name, compare_family, compare_given, edits, same_letters
from linkwright.llm.variants import name_knowledge, strata
from linkwright.store import write

#: Records in a window, and most records of a sorted partition.
WINDOW, PARTITION_ROWS = 12, 100_000
#: Sorted rows whose candidates are judged at once.
CHUNK_ROWS = 10_000
#: Pairs of names compared at once.
PAIRS_AT_ONCE = 500_000
#: Evidence above the threshold which makes a match strong.
STRONG = 6.0
#: Most bits for a birth year, whose values grow no rarer with the table, and the share of a birth year from which on it may be a placeholder.
MOST_BITS, PLACEHOLDER = 12.0, 0.04
#: Bits against a match at two addresses: of the surest pairs of the test data, one in eight has two.
MOVED = 3.0

_FIELDS = "idx bigint, side int, last string, first string, fam string, giv string, ini string, year int, gender string, num string, street string"
_NAMES = [x.split(" ")[0] for x in _FIELDS.split(", ")]
#: How many rows have a row's own family name, given name and place, and how many a family or given name
#: that is nearly its own; they stand behind the fields.
_COUNTS = ("n_fam", "n_giv", "n_place", "n_near_fam", "n_near_giv")
#: Numbers by which whole windows are looked through at once; 0 stands for null.
_CODES = ("h_fam", "h_skel", "h_begin", "h_giv", "h_ini", "h_num", "h_street")
#: The composite keys by which records are sorted; records that lack the first part stand in another order.
SORT_KEYS = (("fam", "giv", "year", "num"), ("num", "street", "giv", "fam"), ("year", "giv", "fam", "num"))


#: Words that many streets have in common, in full and in short; they don't tell streets apart.
COMMON_FULL = "street road avenue square drive boulevard terrace place court highway lane crescent upper lower north south east west saint fort mount old".split()
COMMON_SHORT = "st str strt rd ave av avn sq dr drv blvd bd boul ter terr pl plc ct crt hwy hgwy ln cres cr upp low n s e w ft mt".split()


_SEVERAL = r"(?U)\w\W+\w"


def _skeleton(word: str) -> str:
    return word[:1] + "".join(c for c in word[1:] if c not in "aeiou")


@functools.lru_cache(100_000)
def _common(word: str) -> bool:
    """The word, or what it is a slip of, is none that tells streets apart."""
    return word in COMMON_FULL or word in COMMON_SHORT or len(word) < 3 or any(edits(word, c, 2) <= (2 if len(c) >= 7 else 1) for c in COMMON_FULL if len(c) >= 4)


@functools.lru_cache(100_000)
def _street_core(words: str) -> str | None:
    """The consonants of the longest word that is the street's own."""
    own = [w for w in words.split(" ") if not _common(w)]
    return _skeleton(max(own, key=len)) if own else None


def _prepare(records: DataFrame, known: list[tuple[str, str]], given: list[str]) -> DataFrame:
    """The compared features of each record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Forms(known, given)
        for batch in batches:
            last, first, words = (batch.column(i).to_pylist() for i in (2, 3, 7))
            fam, giv, ini, many = [], [], [], []
            for x, y in zip(last, first):
                n = Name(x, y, forms)
                many.append(len(n.family) > 1)
                g = n.given[0] if n.given else ""
                of = forms.of.get(g)
                fam.append(n.bare or None)
                giv.append((min(of) if of else g) or None)
                ini.append((giv[-1] or "".join(n.initials))[:1] or None)
            street = [_street_core(w) for w in words]
            num = [x or None for x in batch.column(6).to_pylist()]
            text = lambda x: pa.array(x, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], text(fam), text(giv), text(ini), batch.column(4), batch.column(5), text(num), text(street), pa.array(many, pa.bool_())], [*_NAMES, "several"])

    rows = parse_addresses(records, "house_number", "street_name").select("idx", "side", "last_name", "first_name", F.col("birth_year").cast("int"), "gender", "number", "words")
    return rows.mapInArrow(run, f"{_FIELDS}, several boolean")


def _shares(features: DataFrame, column: str, total: int, least: float) -> dict:
    """The values with at least this share of the rows, at most its inverse many, and their shares."""
    common = features.where(F.col(column).isNotNull()).groupBy(column).count().where(F.col("count") >= max(2, least * total))
    return {r[column]: r["count"] / total for r in common.collect()}


def _with_near(counts: DataFrame, name: str, n: str) -> DataFrame:
    """The distinct names and their rows with ``n_near_...``, the rows of all names that a slip may have made of one.

    Names one edit apart share a form without one letter. Of the forms of a name, the one with the
    most rows counts, so that a rare slip of a usual name is as usual as the name itself.
    """
    letter = F.transform(F.sequence(F.lit(0), F.length(name)), lambda i: F.when(i == 0, F.xxhash64(name)).otherwise(F.xxhash64(F.concat(F.substring(F.col(name), F.lit(1), i - 1), F.substring(F.col(name), i + 1, F.length(name))))))
    forms = counts.select(name, n, F.explode(F.array_distinct(letter)).alias("form"))
    rows = forms.groupBy("form").agg(F.sum(n).alias("rows"), F.count(F.lit(1)).alias("names")).where("names > 1")
    near = forms.join(rows.hint("shuffle_hash"), "form").groupBy(name).agg(F.max("rows").alias(f"n_near_{name}"))
    joined = counts.join(near.hint("shuffle_hash"), name, "left")
    return joined.select(name, n, F.coalesce(f"n_near_{name}", n).alias(f"n_near_{name}"))


def _counted(parsed: DataFrame) -> DataFrame:
    """The features with the exact numbers of rows that have each record's values, and with codes."""
    out = parsed
    for name, of in zip(_COUNTS, (["fam"], ["giv"], ["num", "street"])):
        counts = parsed.dropna(subset=of).groupBy(*of).agg(F.count(F.lit(1)).alias(name))
        if len(of) == 1:
            counts = _with_near(counts, *of, name)
        out = out.join(counts.hint("shuffle_hash"), of, "left")
    skeleton = F.concat(F.substring("fam", 1, 1), F.translate(F.expr("substring(fam, 2)"), "aeiou", ""))
    values = {"h_fam": F.col("fam"), "h_skel": F.substring(skeleton, 1, 4), "h_begin": F.substring("fam", 1, 2), "h_giv": F.col("giv"), "h_ini": F.col("ini"), "h_num": F.col("num"), "h_street": F.col("street")}
    code = lambda c: F.when(c.isNull(), 0).when(F.hash(c) == 0, 1).otherwise(F.hash(c))
    # more than one word in the family name: such names may agree in parts
    several = F.col("several") if "several" in parsed.columns else F.coalesce(F.col("last").rlike(_SEVERAL), F.lit(False))
    return out.select(*_NAMES, *_COUNTS, *[code(values[c]).alias(c) for c in _CODES], several.alias("several"))


class Evidence:
    """Bits for and against two records being of one entity."""

    def __init__(self, years: dict[int, float], forms: Forms, strong: float, total: int = 1) -> None:
        self.years, self.forms, self.strong, self.total = years, forms, strong, total
        self.placeholders = sorted(y for y, share in years.items() if share >= PLACEHOLDER)
        self.names: dict[int, Name] = {}

    def rarity(self, column: str, a: Sequence, b: Sequence) -> float:
        """Bits of an agreement, by the more usual one of the two rows' values."""
        at = len(_NAMES) + _COUNTS.index(f"n_{column}")
        return math.log2(self.total / max(a[at] or 1, b[at] or 1))

    def name(self, row: Sequence) -> Name:
        """A row's name, parsed once while the rows of a partition are compared."""
        found = self.names.get(row[0])
        if found is None:
            found = self.names[row[0]] = Name(row[2], row[3], self.forms)
        return found

    def year_bits(self, year: int) -> float:
        """Of an agreement in a birth year; years that hardly anybody has count as all that are not listed."""
        share = self.years.get(year)
        return MOST_BITS if share is None else min(MOST_BITS, -math.log2(share))

    def of(self, a: Sequence, b: Sequence) -> float:
        """The sum for two rows of features; -inf if they contradict each other."""
        _, _, _, _, fam_a, giv_a, _, year_a, sex_a, num_a, street_a, *_ = a
        _, _, _, _, fam_b, giv_b, _, year_b, sex_b, num_b, street_b, *_ = b
        total = 0.0
        if year_a is not None and year_b is not None:
            if year_a == year_b:
                total += self.year_bits(year_a)
                near = True
            else:
                near = _year_slip(year_a, year_b)
                if near:
                    total -= 3
                elif max(self.years.get(y, 0) for y in (year_a, year_b)) < PLACEHOLDER:
                    return -math.inf
                else:
                    total -= 1
        else:
            near = False
        if fam_a is not None and fam_a == fam_b and giv_a is not None and giv_a == giv_b:
            family = given = SAME
        else:
            x, y = self.name(a), self.name(b)
            family, given = compare_family(x, y, self.forms), compare_given(x, y, self.forms)
            if min(family, given) == NONE and same_letters(x, y, self.forms):
                family = given = SLIP
            if given == NONE and (x.given or x.initials) and (y.given or y.initials):
                return -math.inf
            if family == NONE and x.family and y.family:
                total -= 7
        if family:
            # both may be slips of one usual name
            total += self.rarity("near_fam" if family == SLIP else "fam", a, b) - (SAME - family) * 0.7
        if given:
            total += 2.5 if given == INITIAL else self.rarity("near_giv" if given == SLIP else "giv", a, b) - (SAME - given) * 0.7
        if given <= INITIAL and year_a != year_b:
            total -= 8
        if sex_a is not None and sex_b is not None:
            total += 1 if sex_a == sex_b else -4
        if num_a is not None and num_b is not None and street_a is not None and street_b is not None:
            if num_a == num_b and _streets(street_a, street_b):
                total += self.rarity("place", a, b)
                if not near:
                    total -= 1
            else:
                total -= MOVED if near and year_a == year_b else 4
        # of one name and address, but without years to tell a parent from a child: never strong
        return total if near else min(total, self.strong - 0.01)


def _year_slip(a: int, b: int) -> bool:
    """One of the usual slips: off by up to three, by ten, or the last two digits exchanged."""
    return abs(a - b) <= 3 or abs(a - b) == 10 or (a // 100 == b // 100 and a % 10 == b // 10 % 10 and b % 10 == a // 10 % 10)


def _year_slips(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same of many pairs, equal years included."""
    gap = np.abs(a - b)
    return (gap <= 3) | (gap == 10) | ((a // 100 == b // 100) & (a % 10 == b // 10 % 10) & (b % 10 == a // 10 % 10))


def _streets(a: str, b: str) -> bool:
    return a == b or a.startswith(b) or b.startswith(a) or edits(a, b, 1) <= 1


def _possible(x: dict[str, np.ndarray], fam: Words, a: np.ndarray, b: np.ndarray, evidence: Evidence, threshold: float) -> np.ndarray:
    """Which pairs of rows can reach the threshold at all: those whose evidence would do if all that is not known yet agreed."""
    bits = lambda c: np.log2(evidence.total / np.maximum(np.maximum(x[c][a], x[c][b]), 1))
    both = lambda c: (x[c][a] != 0) & (x[c][b] != 0)
    ya, yb = x["year"][a], x["year"][b]
    known = (ya != 0) & (yb != 0)
    year = np.where(known, np.where(ya == yb, x["year_bits"][a], np.where(_year_slips(ya, yb), -3.0, -1.0)), 0.0)
    sex = np.where((x["sex"][a] != 0) & (x["sex"][b] != 0), np.where(x["sex"][a] == x["sex"][b], 1.0, -4.0), 0.0)
    apart = np.where(known & (ya == yb), -MOVED, -4.0)
    place = np.where(both("h_num") & both("h_street"), np.where(x["h_num"][a] == x["h_num"][b], np.maximum(bits("n_place"), apart), apart), 0.0)
    family = bits("n_fam")
    most = year + sex + place + family + np.maximum(bits("n_giv"), 2.5)
    ok = most >= threshold - 1e-6
    # single words: if all hangs on the family names, these must be alike
    look = np.flatnonzero(ok & both("h_fam") & (x["h_fam"][a] != x["h_fam"][b]) & (x["h_giv"][a] == x["h_giv"][b]) & ~x["several"][a] & ~x["several"][b] & (most - family - 7 < threshold - 1e-6))
    if len(look):
        p, q = a[look], b[look]
        d, gap = fam.distances(p, q), np.abs(fam.lengths[p] - fam.lengths[q])
        u, v = x["letters"][p], x["letters"][q]
        odd = np.maximum(np.bitwise_count(u & ~v), np.bitwise_count(v & ~u))
        # two slips, one or both of them exchanged letters; or a beginning or an end of the longer one, but for a slip
        ok[look] = (d <= 2) | ((d == 3) & (odd <= 1)) | ((d == 4) & (odd == 0)) | ((gap >= 2) & (d <= gap + 1))
    return ok


def _compare_sorted(rows: pa.Table, place: np.ndarray, part: np.ndarray, group: np.ndarray, evidence: Evidence, threshold: float, inside: bool) -> list[tuple]:
    """The pairs of sorted rows less than a window apart that reach the threshold.

    ``place`` is a row's place in the whole order. With ``inside`` pairs are of one partition, else
    of two; they are of one ``group``.
    """
    n = rows.num_rows
    if n < 2:
        return []
    number = lambda c: rows.column(c).fill_null(0).to_numpy()
    x = {c: number(c) for c in (*_CODES, *_COUNTS, "year")}
    x["several"] = rows.column("several").to_numpy()
    born = x["year"] = x["year"].astype(np.int64)
    sexes = {"": 0}
    x["sex"] = np.array([sexes.setdefault(g or "", len(sexes)) for g in rows.column("gender").to_pylist()])
    bits = {y: evidence.year_bits(y) for y in np.unique(born).tolist()}
    x["year_bits"] = np.array([bits[y] for y in born.tolist()])
    fam = Words([f or "" for f in rows.column("fam").to_pylist()])
    letters = x["letters"] = fam.letters()
    unsure = (born == 0) | np.isin(born, evidence.placeholders)
    strings = rows.select([*_NAMES, *_COUNTS])
    out: list[tuple] = []
    # so many rows at a time that what is held of them stays small
    for begin in range(0, n, CHUNK_ROWS):
        one, other = [], []
        for step in range(1, min(WINDOW, n)):
            a, b = slice(begin, min(begin + CHUNK_ROWS, n - step)), slice(begin + step, min(begin + CHUNK_ROWS + step, n))
            if a.start >= a.stop:
                break
            near = (place[b] - place[a] < WINDOW) & ((part[a] == part[b]) == inside) & (group[a] == group[b])
            same = lambda c: (x[c][a] == x[c][b]) & (x[c][a] != 0)  # noqa: E731, B023
            sf, sg, sn = same("h_fam") | same("h_skel"), same("h_giv"), same("h_num")
            sy = (born[a] == born[b]) & (born[a] != 0)
            address = sn & same("h_street")
            name = (sf | same("h_begin")) & (sg | same("h_ini"))
            # one given name and year: all families but those of single words that differ by more than two letters, which no slip, cut or prefix explains
            u, v = letters[a], letters[b]
            like = x["several"][a] | x["several"][b] | (np.minimum(np.bitwise_count(u & ~v), np.bitwise_count(v & ~u)) <= 2)
            # years that contradict each other need no look at the names
            possible = unsure[a] | unsure[b] | _year_slips(born[a], born[b])
            found = np.flatnonzero(near & possible & ((name & (sy | sn)) | (address & (sg | sf | sy)) | (sf & sg) | (sn & sy & (sg | sf)) | (sg & sy & like))) + begin
            one.append(found)
            other.append(found + step)
        if not one:
            continue
        a, b = np.concatenate(one), np.concatenate(other)
        ok = _possible(x, fam, a, b, evidence, threshold)
        a, b = a[ok], b[ok]
        used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        held = list(zip(*[c.to_pylist() for c in strings.take(pa.array(used)).columns]))
        evidence.names = {}
        out += [p for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist()) if (p := _judged(held[i], held[j], evidence, threshold))]
    return out


def _judged(x: Sequence, y: Sequence, evidence: Evidence, threshold: float) -> tuple | None:
    score = evidence.of(x, y)
    if score < threshold:
        return None
    if x[0] > y[0]:
        x, y = y, x
    return x[0], y[0], x[1], y[1], score


def _table(batches: list[pa.RecordBatch], empty: pa.Schema) -> pa.Table:
    return pa.Table.from_batches(batches).combine_chunks() if batches else empty.empty_table()


_PAIRS = "i bigint, j bigint, side_i int, side_j int, score double"
_PAIR_NAMES = [x.split(" ")[0] for x in _PAIRS.split(", ")]


def _pair_batch(pairs: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
    return [pa.array([p[c] for p in pairs], kind) for c, kind in enumerate(kinds)]


def _window_pairs(features: DataFrame, key: Sequence[str], n_rows: int, evidence: Evidence, threshold: float) -> DataFrame:
    """Scored pairs of one sorted neighbourhood.

    The rows are range-partitioned and sorted by the key. Every partition compares its own windows
    and hands on its first and last rows; those about each border, at most two windows of rows, are
    compared on their own.
    """
    spark = features.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-n_rows // PARTITION_ROWS))
    fields = features.columns
    typed = ", ".join(f"{c} {kind}" for c, kind in features.dtypes)
    edge = f"{_PAIRS}, part int, pos bigint, n bigint, {typed}"
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    field_types = [arrow[kind] for _, kind in features.dtypes]
    empty = pa.schema(list(zip(fields, field_types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _table(list(batches), empty)
        n, part = rows.num_rows, TaskContext.get().partitionId()
        alike = np.zeros(n, np.int64)
        found = _compare_sorted(rows, np.arange(n), alike, alike, evidence, threshold, True)
        blank = lambda kind, m: pa.nulls(m, kind)
        names = [*_PAIR_NAMES, "part", "pos", "n", *fields]
        yield pa.RecordBatch.from_arrays([*_pair_batch(found), *[blank(k, len(found)) for k in (pa.int32(), pa.int64(), pa.int64(), *field_types)]], names)
        at = [i for i in range(n) if i < WINDOW - 1 or i >= n - WINDOW + 1]
        edges = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.take(pa.array(at, pa.int64())).columns]
        edges = [e.chunk(0) if isinstance(e, pa.ChunkedArray) else e for e in edges]
        nothing = [blank(k, len(at)) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array([n] * len(at), pa.int64()), *edges], names)

    placed = features.where(F.col(key[0]).isNotNull()).repartitionByRange(parts, *key, "idx").sortWithinPartitions(*key, "idx")
    table = write(placed.mapInArrow(run, edge), "window").df
    pairs = table.where("i is not null").select("i", "j", "side_i", "side_j", "score")
    borders = table.where("part is not null").select("part", "pos", "n", *fields)
    # one number for each partition
    sizes = sorted((r["part"], r["n"]) for r in borders.where("pos = 0").select("part", "n").collect())
    starts = dict(zip([p for p, _ in sizes], np.cumsum([0, *[n for _, n in sizes]]).tolist()))
    cuts = np.array(sorted(starts.values())[1:], np.int64)
    # only partitions smaller than a window have rows near several borders
    near = lambda place: cuts[np.searchsorted(cuts, place - WINDOW + 1) : np.searchsorted(cuts, place + WINDOW)].tolist()

    def about(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = [starts[p] + i for p, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            hits = [(row, g) for row, x in enumerate(place) for g in near(x)]
            rows = batch.take(pa.array([r for r, _ in hits], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([g for _, g in hits], pa.int64()), pa.array([place[r] for r, _ in hits], pa.int64()), rows.column(0), *rows.columns[3:]], ["cut", "place", "part", *fields])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _table(list(batches), pa.schema([("cut", pa.int64()), ("place", pa.int64()), ("part", pa.int32()), *empty])).sort_by([("cut", "ascending"), ("place", "ascending")]).combine_chunks()
        cut, place, part = (rows.column(i).to_numpy() for i in range(3))
        yield pa.RecordBatch.from_arrays(_pair_batch(_compare_sorted(rows.select(fields), place, part, cut, evidence, threshold, False)), _PAIR_NAMES)

    tasks = max(1, min(parts, spark.sparkContext.defaultParallelism))
    met = borders.mapInArrow(about, f"cut bigint, place bigint, part int, {typed}").repartition(tasks, "cut").mapInArrow(over, _PAIRS)
    return pairs.unionByName(met)


def _slips_of_halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``i, j`` of the rows ``idx, fam, half`` that share a half and whose names are one edit apart or less."""
    rows = _table(list(batches), pa.schema([("idx", pa.int64()), ("fam", pa.string()), ("half", pa.int64())]))
    half = rows.column("half").to_numpy()
    order = np.argsort(half, kind="stable")
    sorted_half = half[order]
    end = np.searchsorted(sorted_half, sorted_half, side="right")
    later = end - np.arange(len(order)) - 1
    idx = rows.column("idx").to_numpy()
    # a bounded number of pairs at a time
    begins = np.flatnonzero(later > 0)
    for part in np.split(begins, np.flatnonzero(np.diff(np.cumsum(later[begins]) // PAIRS_AT_ONCE)) + 1) if len(begins) else ():
        for low in range(0, int(later[part].max()), PAIRS_AT_ONCE):
            size = np.clip(later[part] - low, 0, PAIRS_AT_ONCE)
            x = np.repeat(part, size)
            y = x + 1 + low + np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
            used, at = np.unique(order[np.concatenate([x, y])], return_inverse=True)
            fam = Words(rows.column("fam").take(pa.array(used)).to_pylist())
            p, q = at[: len(x)], at[len(x) :]
            d = fam.distances(p, q)
            # exchanged letters are two edits of this metric
            for k in np.flatnonzero((d == 2) & (fam.lengths[p] == fam.lengths[q])):
                d[k] = edits(fam.words[p[k]], fam.words[q[k]], 1)
            a, b = idx[used[p[d <= 1]]], idx[used[q[d <= 1]]]
            ok = a != b
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok])], ["i", "j"])


def _slip_pairs(features: DataFrame, total: int, evidence: Evidence, threshold: float) -> DataFrame:
    """Scored pairs of one birth year and given name whose family names are at most one edit apart, all of them.

    One edit leaves the first or the last half of a name as it is, by which they are joined. Records
    whose names and year can't reach the threshold without an agreeing place, which the order by
    places finds, are left out; of the others one record or less is expected to share all three
    values, so that the pairs grow as the rows.
    """
    fields = features.columns
    n_year = features.where("year is not null").groupBy("year").agg(F.count(F.lit(1)).alias("n_year"))
    bits = lambda n: F.log2(F.lit(total) / F.col(n))
    year = F.when(F.col("n_year") >= max(2, 1e-3 * total), F.least(F.lit(MOST_BITS), bits("n_year"))).otherwise(MOST_BITS)
    able = features.where("fam is not null and giv is not null").select("idx", "year", "giv", "fam", "n_fam", "n_giv").join(n_year.hint("broadcast") if total < 1 << 40 else n_year, "year").where(bits("n_fam") + bits("n_giv") + year + 1 >= threshold - 1e-6)
    halves = [F.xxhash64("year", "giv", F.lit(side), F.expr(n), F.expr(f"{side}(fam, cast({n} as int))")) for side in ("left", "right") for n in ("length(fam) div 2", "(length(fam) - 1) div 2")]
    keyed = able.select("idx", "fam", F.explode(F.array_distinct(F.array(*halves))).alias("half")).repartition("half")
    of = keyed.mapInArrow(_slips_of_halves, "i bigint, j bigint")
    # the features are shuffled once; only rows of some pair go on
    ends = of.distinct().select("i", "j", F.explode(F.array("i", "j")).alias("idx"))
    pairs = features.join(ends.hint("shuffle_hash"), "idx").groupBy("i", "j").agg(F.collect_list(F.struct(*fields)).alias("two")).select("two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            evidence.names = {}
            flat = batch.column(0).flatten()
            rows = list(zip(*[flat.field(c).to_pylist() for c in range(len(fields))]))
            # hashes may collide
            alike = ((x, y) for x, y in zip(rows[::2], rows[1::2]) if x[7] == y[7] and x[5] == y[5])
            yield pa.RecordBatch.from_arrays(_pair_batch([p for x, y in alike if (p := _judged(x, y, evidence, threshold))]), _PAIR_NAMES)

    return pairs.mapInArrow(run, _PAIRS)


#: Edges of a component that may stand in one row, and most rounds of the auction for larger ones.
ROW_EDGES, MOST_ROUNDS = 256, 500
#: The least raise of a bid, in bits: the auction's total is below the greatest by no more than this for each node.
RAISE = 0.05


def best_matching(edges: Sequence[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Of the edges ``(u, v, score)`` between two sides, those of a matching with the greatest total.

    Paths that gain the most are added one by one: from a free ``u`` over edges to be taken and
    edges to be given up, alternately, to a free ``v``.
    """
    weight = {(u, v): w for u, v, w in sorted(edges, key=lambda e: (e[2], -e[0], -e[1]))}
    mate_u: dict[int, int] = {}
    mate_v: dict[int, int] = {}
    while True:
        gain = {u: 0.0 for u, _ in weight if u not in mate_u}
        came: dict[int, int] = {}
        reach: dict[int, float] = {}
        moved = True
        while moved:
            moved = False
            for (u, v), w in weight.items():
                if u in gain and mate_u.get(u) != v and gain[u] + w > reach.get(v, 0.0) + 1e-12:
                    reach[v], came[v], moved = gain[u] + w, u, True
                    if v in mate_v:
                        gain[mate_v[v]] = reach[v] - weight[mate_v[v], v]
        ends = [(g, -v) for v, g in reach.items() if v not in mate_v]
        if not ends:
            break
        v = -max(ends)[1]
        while True:
            u = came[v]
            before = mate_u.get(u)
            mate_u[u], mate_v[v] = v, u
            if before is None:
                break
            v = before
    return [(u, v, weight[u, v]) for u, v in mate_u.items()]


def assign_one_to_one(edges: DataFrame, row_edges: int = ROW_EDGES) -> DataFrame:
    """``u, v, score``: each ``u`` and each ``v`` in at most one edge, so that the scores add up to the most.

    ``u`` and ``v`` are two sides, whatever their numbers. Components of at most ``row_edges`` edges
    are solved one by one, exactly. In larger ones the ``u`` bid for the ``v`` by joins, round by
    round: a bid is the old price and what the best offer is better than the second best, or than
    none at all, and a raise, so that the total is within ``RAISE`` for each node of the greatest.
    More than ``MOST_ROUNDS`` rounds are an error. Ties go to the smaller ids.
    """
    # the sides' numbers may be the same: even and odd tell them apart
    known = write(edges.groupBy("u", "v").agg(F.max("score").alias("score")), "edges").df
    group = connected_components(known.select((F.col("u") * 2).alias("x"), (F.col("v") * 2 + 1).alias("y")), "x", "y")
    whole = write(known.join(group.select((F.col("idx") / 2).cast("long").alias("u"), "group_idx", "idx").where("idx % 2 = 0").drop("idx"), "u"), "grouped").df
    sizes = whole.groupBy("group_idx").agg(F.count(F.lit(1)).alias("n"))
    small = whole.join(sizes.where(F.col("n") <= row_edges).drop("n").hint("shuffle_hash"), "group_idx").groupBy("group_idx").agg(F.collect_list(F.struct("u", "v", "score")).alias("all"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [e for group in batch.column(0).to_pylist() for e in best_matching([(x["u"], x["v"], x["score"]) for x in group])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["u", "v", "score"])

    out = small.select("all").mapInArrow(solve, "u bigint, v bigint, score double")
    large = whole.join(sizes.where(F.col("n") > row_edges).drop("n"), "group_idx").select("u", "v", "score")
    return out if large.isEmpty() else out.unionByName(_auction(write(large, "large").df))


def _auction(edges: DataFrame) -> DataFrame:
    """The assignment of large components by bids, each round one join and two aggregates."""
    spark = edges.sparkSession
    state = write(spark.createDataFrame([], "v bigint, u bigint, price double"), "prices")
    for _ in range(MOST_ROUNDS):
        prices = state.df
        free = edges.join(prices.select("u"), "u", "left_anti").join(prices.select("v", "price"), "v", "left")
        value = free.select("u", "v", (F.col("score") - F.coalesce("price", F.lit(0.0))).alias("value"), F.coalesce("price", F.lit(0.0)).alias("price"))
        # the best offer and the value of the second best; none at all is worth 0
        first = value.where("value > 0").groupBy("u").agg(F.max(F.struct("value", (-F.col("v")).alias("mv"), "price")).alias("b"))
        second = value.join(first.select("u", (-F.col("b.mv")).alias("best")), "u").where("v <> best").groupBy("u").agg(F.max("value").alias("next"))
        bids = first.join(second, "u", "left").select("u", (-F.col("b.mv")).alias("v"), (F.col("b.price") + F.col("b.value") - F.greatest(F.coalesce("next", F.lit(0.0)), F.lit(0.0)) + RAISE).alias("price"))
        won = bids.groupBy("v").agg(F.max(F.struct("price", (-F.col("u")).alias("mu"))).alias("w")).select("v", (-F.col("w.mu")).alias("u"), F.col("w.price").alias("price"))
        won = write(won, "won")
        if won.df.isEmpty():
            return state.df.join(edges, ["u", "v"]).select("u", "v", "score")
        after = write(prices.join(won.df.select("v"), "v", "left_anti").select("v", "u", "price").unionByName(won.df), "prices")
        state.drop()
        won.drop()
        state = after
    raise RuntimeError("the auction did not settle")


def join_weak(weak: DataFrame) -> DataFrame:
    """``entity, to``: the entities that weak matches join to others.

    ``weak`` has ``u0, v0, side_i, side_j, score``. Entities tied by records of one source are the
    repeated records of a person: all that hang together become one. Only matches between the two
    sources compete: the part of an entity in one source with the part of another in the other
    source, one to one, between what has been joined so far, so that a person's repeated records
    come along whichever of them is matched.
    """
    repeated = weak.where("side_i = side_j").select(F.least("u0", "v0").alias("u"), F.greatest("u0", "v0").alias("v")).distinct()
    joined = write(connected_components(repeated, "u", "v"), "joined").df
    to = lambda x: joined.select(F.col("idx").alias(x), F.col("group_idx").alias(f"{x}_to")).hint("shuffle_hash")
    across = weak.where("side_i <> side_j").join(to("u0"), "u0", "left").join(to("v0"), "v0", "left").select(F.coalesce("u0_to", "u0").alias("u0"), F.coalesce("v0_to", "v0").alias("v0"), "side_i", "score").where("u0 <> v0")
    first = F.col("side_i") == 0
    chosen = assign_one_to_one(across.select(F.when(first, F.col("u0")).otherwise(F.col("v0")).alias("u"), F.when(first, F.col("v0")).otherwise(F.col("u0")).alias("v"), "score"))
    # parts of one entity may be joined to two others
    final = write(connected_components(chosen, "u", "v"), "chosen").df
    moved = final.select(F.col("idx").alias("person"), F.col("group_idx").alias("to"))
    kept = joined.select(F.col("idx").alias("entity"), F.col("group_idx").alias("person"))
    alone = moved.join(kept.select("person").distinct(), "person", "left_anti").select(F.col("person").alias("entity"), "to")
    return kept.join(moved, "person", "left").select("entity", F.coalesce("to", "person").alias("to")).unionByName(alone)


def match_entities(a: DataFrame, b: DataFrame, forms: DataFrame, margin: float = 1.0, with_confidence: bool = True) -> DataFrame:
    """``idx_a, idx_b, confidence``: the pairs of records of two sources that are of one entity.

    Both tables have ``idx`` (unique over both), ``last_name, first_name, house_number, street_name,
    birth_year, gender``; nulls and empty fields count neither way, an empty table gives no rows,
    extra columns are ignored, repeated rows are records. The threshold in bits is the logarithm of
    the larger table's rows, plus ``margin``: so much evidence makes a match more likely than not if
    every record of the smaller table has about one partner. The confidence is the probability that
    goes with the evidence of the pair itself or, for a pair that was not compared, with the weaker
    one of the best matches that bind the two records to their entity; without ``with_confidence``
    the column is left out.
    """
    cols = ["idx", "last_name", "first_name", "house_number", "street_name", "birth_year", "gender"]
    records = a.select(*cols).withColumn("side", F.lit(0)).unionByName(b.select(*cols).withColumn("side", F.lit(1)))
    together = records.where("birth_year is not null").select(strata().alias("stratum"), "last_name", "first_name")
    known, given = name_knowledge(records, together, forms)
    parsed = write(_prepare(records, known, given), "parsed")
    made = write(_counted(parsed.df), "features")
    parsed.drop()
    features = made.df
    total = max(1, features.count())
    threshold = math.log2(total) + margin
    evidence = Evidence(_shares(features, "year", total, 1e-3), Forms(known, given), threshold + STRONG, total)
    found = write(_slip_pairs(features, total, evidence, threshold), "slips").df
    for key in SORT_KEYS:
        found = found.unionByName(_window_pairs(features, key, total, evidence, threshold))
    scored = write(found.groupBy("i", "j").agg(F.min("side_i").alias("side_i"), F.min("side_j").alias("side_j"), F.max("score").alias("score")), "scored").df
    sides = write(features.select("idx", "side"), "sides").df
    made.drop()
    groups = write(connected_components(scored.where(F.col("score") >= threshold + STRONG), "i", "j"), "entities").df
    ent = lambda x, name: groups.select(F.col("idx").alias(x), F.col("group_idx").alias(name)).hint("shuffle_hash")
    ended = scored.join(ent("i", "u0"), "i", "left").join(ent("j", "v0"), "j", "left").select("i", "j", "side_i", "side_j", "score", F.coalesce("u0", "i").alias("u0"), F.coalesce("v0", "j").alias("v0"))
    weak = write(ended.where("u0 <> v0").select("u0", "v0", "side_i", "side_j", "score"), "weak").df
    persons = write(join_weak(weak), "persons").df
    entity = sides.join(groups.hint("shuffle_hash"), "idx", "left").select("idx", "side", F.coalesce("group_idx", "idx").alias("entity"))
    final = write(entity.join(persons.hint("shuffle_hash"), "entity", "left").select("idx", "side", F.coalesce("to", "entity").alias("entity")), "final").df
    left = final.where("side = 0").select(F.col("idx").alias("idx_a"), "entity")
    right = final.where("side = 1").select(F.col("idx").alias("idx_b"), "entity")
    pairs = left.join(right, "entity")
    if not with_confidence:
        return pairs.select("idx_a", "idx_b")
    of = lambda x: final.select(F.col("idx").alias(x), F.col("entity").alias(f"e_{x}"))
    kept = scored.join(of("i"), "i").join(of("j"), "j").where("e_i = e_j")
    best = write(kept.select(F.explode(F.array("i", "j")).alias("idx"), "score").groupBy("idx").agg(F.max("score").alias("best")), "best").df
    own = scored.select(F.col("i").alias("lo"), F.col("j").alias("hi"), "score")
    rated = pairs.withColumns({"lo": F.least("idx_a", "idx_b"), "hi": F.greatest("idx_a", "idx_b")}).join(own, ["lo", "hi"], "left")
    rated = rated.join(best.select(F.col("idx").alias("idx_a"), F.col("best").alias("best_a")), "idx_a", "left").join(best.select(F.col("idx").alias("idx_b"), F.col("best").alias("best_b")), "idx_b", "left")
    bits = F.coalesce("score", F.least("best_a", "best_b"), F.lit(threshold)) - F.lit(threshold)
    return rated.select("idx_a", "idx_b", (1 / (1 + F.pow(F.lit(2.0), -bits))).alias("confidence"))
