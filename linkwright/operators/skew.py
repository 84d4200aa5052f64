"""Per-key work when a few keys hold most rows.

Heavy keys are found with a mergeable frequent-items sketch, which misses no key above the wanted
share. Their rows stay where they are and meet the other side by broadcast; all other rows are
shuffled in the ordinary way; the two results are united. What is broadcast has a size bound:
at most ``1 / share`` keys can hold ``share`` of the rows each.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy from this share of all rows on, unless the caller says otherwise.
HEAVY_SHARE = 0.005
#: The largest sketch has 2^20 slots, and a share needs sixteen times its inverse.
LEAST_SHARE = 16 / (1 << 20)


def heavy_candidates(df: DataFrame, columns: Sequence[str], min_share: float) -> dict[str, list]:
    """For each column, a superset of the values that hold ``min_share`` of the rows.

    One pass with one sketch for each column. A frequent-items sketch of ``m`` slots undercounts no
    item by more than about ``3.5 / m`` of the rows, hence every value with the share ranks within
    the first ``1 / (share - error)`` items; as many are returned. Nulls are no value. An empty
    table gives empty lists. Shares too small for the largest sketch are refused.
    """
    if min_share < LEAST_SHARE:
        raise ValueError(f"the sketch can't promise to miss no value below a share of {LEAST_SHARE}")
    slots = max(1024, 1 << math.ceil(math.log2(16 / min_share)))
    k = math.ceil(2 / min_share)
    row = df.agg(*[F.expr(f"approx_top_k(`{c}`, {k}, {slots})").alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {c: [x["item"] for x in (row[f"c{i}"] or []) if x["item"] is not None] for i, c in enumerate(columns)}


def _keys_frame(df: DataFrame, column: str, values: list) -> DataFrame:
    kind = df.schema[column].dataType
    return df.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` {kind.simpleString()}")


def per_key(df: DataFrame, key: str, aggregates: Sequence[Column], min_share: float = HEAVY_SHARE, heavy: list | None = None) -> DataFrame:
    """One row for each non-null value of ``key`` with the given aggregates and ``is_heavy``.

    Rows of heavy keys are marked by a broadcast join and aggregated on their own: no shuffle
    carries them, only one partial result for each key and task. The others are grouped by an
    ordinary shuffle. Null keys are left out; an empty table gives no rows; ties and repeated rows
    count as rows. ``aggregates`` may not use a column called ``is_heavy``.
    """
    if "is_heavy" in df.columns:
        raise ValueError("the column name is_heavy is taken")
    if heavy is None:
        heavy = heavy_candidates(df, [key], min_share)[key]
    rows = df.where(F.col(key).isNotNull())
    keys = F.broadcast(_keys_frame(df, key, heavy))
    hot = rows.join(keys, key, "left_semi").groupBy(key).agg(*aggregates).withColumn("is_heavy", F.lit(True))
    rest = rows.join(keys, key, "left_anti").groupBy(key).agg(*aggregates).withColumn("is_heavy", F.lit(False))
    return hot.unionByName(rest)


def frequent_values(df: DataFrame, columns: Sequence[str], min_share: float) -> DataFrame:
    """``field_name, key_value, n_rows, share``: the values held by ``min_share`` of all rows or more.

    Candidates come from the sketch, counts are exact. Null is no value but its rows count in the
    total. Values come out as strings. Empty tables give no rows.
    """
    total = df.count()
    candidates = heavy_candidates(df, columns, min_share)
    parts = []
    for c in columns:
        counts = per_key(df.select(c), c, [F.count(F.lit(1)).alias("n_rows")], heavy=candidates[c])
        parts.append(counts.where(F.col("is_heavy") & (F.col("n_rows") >= F.lit(min_share) * F.lit(total)))
                     .select(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("key_value"), "n_rows", (F.col("n_rows") / F.lit(float(max(total, 1)))).alias("share")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", min_share: float = HEAVY_SHARE, max_broadcast_mb: int = 64) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, whatever share of ``left`` one key holds.

    Right rows of heavy left keys are broadcast if they are measured to hold at most
    ``max_broadcast_mb``; else the heavy left rows are salted and the right rows repeated once for
    each salt. Other keys take an ordinary shuffle join. ``how`` is inner, left, left_semi or
    left_anti. Null keys match nothing. Columns of the same name besides the key are refused.
    """
    clash = (set(left.columns) & set(right.columns)) - {key}
    if clash and how in ("inner", "left"):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    heavy = heavy_candidates(left, [key], min_share)[key]
    if not heavy:
        return left.join(right, key, how)
    keys = F.broadcast(_keys_frame(left, key, heavy))
    hot_l, hot_r = left.join(keys, key, "left_semi"), right.join(keys, key, "left_semi")
    rest = left.join(keys, key, "left_anti").join(right, key, how)
    if _bytes(hot_r) <= max_broadcast_mb << 20:
        hot = hot_l.join(F.broadcast(hot_r), key, how)
    else:
        n = max(16, left.sparkSession.sparkContext.defaultParallelism)
        # by the row's own values: a task that runs again salts alike; maps have no hash
        own = [F.col(f"`{c}`") for c, kind in left.dtypes if "map<" not in kind]
        salted = hot_l.withColumn("_salt", F.pmod(F.xxhash64(*own), F.lit(n)).cast("int"))
        repeated = hot_r.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        hot = salted.join(repeated, [key, "_salt"], how).drop("_salt")
    return hot.unionByName(rest.select(*hot.columns))


def _bytes(df: DataFrame) -> int:
    """About how much memory the rows take: fields of fixed size at 8 bytes, others by their text."""
    wide = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    nested = [c for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))]
    text = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c in wide] + [F.coalesce(F.octet_length(F.to_json(F.struct(f"`{c}`"))), F.lit(0)) for c in nested]
    size = F.lit(16 + 8 * len(df.columns))
    for t in text:
        size = size + t
    return df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]


def annotate_groups(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], total_rows: int, min_rows: int = 2, heavy_groups: int = 2_000, by_hash: bool = False) -> DataFrame:
    """Each row of a group with ``min_rows`` rows or more, together with its group's aggregates.

    Groups are aggregated with partial results before the shuffle. Then the rows meet their group:
    groups of more than ``total_rows / heavy_groups`` rows, which are fewer than ``heavy_groups``,
    by broadcast, all others by a shuffle. No group is ever gathered in one task. Adds
    ``group_rows``; rows with a null key are left out. With ``by_hash`` the groups, one row each,
    are the hashed side of the join, and nothing is sorted.
    """
    limit = max(100_000, total_rows // heavy_groups)
    near = lambda g: g.hint("shuffle_hash") if by_hash else g
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"), *aggregates).where(F.col("group_rows") >= min_rows)
    if total_rows <= limit:
        return df.join(near(groups), list(keys), "inner")
    heavy = groups.where(F.col("group_rows") > limit)
    light = df.join(near(groups.where(F.col("group_rows") <= limit)), list(keys), "inner")
    return light.unionByName(df.join(F.broadcast(heavy), list(keys), "inner"))
