"""Records that differ only in formatting (problem 2)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.operators.skew import annotate_groups
from linkwright.store import write

#: Low bits of a field's hash that are added up; fewer bits make collisions, which the verification undoes.
HASH_BITS = 61


def _value(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("\x00null"))


def formatting_duplicates(df: DataFrame, id_col: str, fields: Mapping[str, Column], bags: Mapping[str, Sequence[Column]] | None = None, hash_bits: int = HASH_BITS) -> DataFrame:
    """``keep, copy, n_copies``: each record of a group of equal records, with the group's smallest id.

    ``fields`` maps a name to a normalised value; ``bags`` maps a name to several normalised values
    whose order does not count. Every (name, value) pair is hashed and the hashes are added, which
    commutes, so that the order of a bag's values is of no account. Records are grouped by two such
    sums, with nothing but numbers in the aggregate. The records of groups of two or more are then
    verified: each one's fields are compared with those of the record to be kept. Groups that hold
    unequal records (hash collisions) are grouped once more by the values themselves. Nothing is
    sorted: groups and kept records, one row for each group, are the hashed side of their joins.

    Nulls equal each other. Records without a copy, and empty tables, give no row. The kept record
    itself is a row with ``copy = keep``. Extra columns are ignored. Ids must be unique and not null.
    """
    bags = bags or {}
    cols, kinds = [F.col(id_col).alias("copy")], []
    for name, c in fields.items():
        cols.append(_value(c).alias(f"f_{name}"))
        kinds.append((name, f"f_{name}"))
    for name, values in bags.items():
        for i, c in enumerate(values):
            cols.append(_value(c).alias(f"b{i}_{name}"))
            kinds.append((name, f"b{i}_{name}"))
    names = [c for _, c in kinds]
    rows = df.select(*cols)
    wrap = lambda seed: sum_hash([F.xxhash64(F.lit(seed), F.lit(name), F.col(c)) for name, c in kinds], hash_bits)
    rows = rows.withColumn("h1", wrap(1)).withColumn("h2", wrap(2))
    total = df.count()
    members = write(annotate_groups(rows, ["h1", "h2"], [F.min("copy").alias("keep")], total, by_hash=True), "members").df
    kept = members.where("copy = keep").select(F.col("keep"), *[F.col(c).alias(f"k_{c}") for c in names])
    # the kept record meets its copies; those of very large groups are few and come by broadcast
    often = max(100_000, total // 2_000)
    big = members.where(F.col("group_rows") > often)
    met = members.where(F.col("group_rows") <= often).join(kept.hint("shuffle_hash"), "keep")
    if total > often:
        met = met.unionByName(big.join(F.broadcast(kept.join(F.broadcast(big.select("keep").distinct()), "keep", "left_semi")), "keep"))
    same = [F.col(f"f_{n}") == F.col(f"k_f_{n}") for n in fields]
    for n, values in bags.items():
        cells = [f"b{i}_{n}" for i in range(len(values))]
        same.append(_same_bag(F.array(*cells), F.array(*[f"k_{c}" for c in cells])))
    # of a record equal to the kept one, the fields are those of the kept one
    equal = reduce(lambda x, y: x & y, same, F.lit(True))
    verified = write(met.select("keep", "copy", "group_rows", equal.alias("equal")), "verified").df
    unequal = verified.where("not equal").select("keep").distinct()
    if unequal.isEmpty():
        return verified.select("keep", "copy", F.col("group_rows").alias("n_copies"))
    good = verified.join(unequal, "keep", "left_anti").select("keep", "copy", F.col("group_rows").alias("n_copies"))
    whole = [*[f"f_{n}" for n in fields], *[F.array_sort(F.array(*[f"b{i}_{n}" for i in range(len(v))])).alias(f"s_{n}") for n, v in bags.items()]]
    clash = members.join(unequal, "keep", "left_semi").select("copy", *whole)
    again = annotate_groups(clash, [c for c in clash.columns if c != "copy"], [F.min("copy").alias("keep")], total, by_hash=True)
    return good.unionByName(again.select("keep", "copy", F.col("group_rows").alias("n_copies")))


def sum_hash(hashes: Sequence[Column], bits: int = HASH_BITS) -> Column:
    """The sum of hashes modulo a power of two, without overflow errors."""
    out, low = F.lit(0).cast("long"), F.lit((1 << bits) - 1)
    for h in hashes:
        out = (out + h.bitwiseAND(low)).bitwiseAND(low)
    return out


def _same_bag(a: Column, b: Column) -> Column:
    """Each value stands in both bags equally often."""
    times = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    return F.forall(a, lambda x: times(a, x) == times(b, x))
