"""Mixing sources to target shares (problem 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Each source is cut into size classes of at most 1/32 of their value, times so many parts.
PARTS = 64


def plan_mixture(sizes: dict[str, float], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, dict]:
    """Expected copies of each source's records, and the shares they give.

    Targets count in proportion among the sources that have any size. Without ``total`` the mixture
    is the largest in which every such source reaches its share within its cap, so that the shares
    are met exactly. With ``total``, sources that can't supply their share at their cap give all
    they may, and what they lack is spread over the others in proportion, until it fits or all are
    at their caps.
    """
    live = {s: (share, cap) for s, (share, cap) in targets.items() if sizes.get(s, 0) > 0 and share > 0 and cap > 0}
    whole = sum(share for share, _ in live.values())
    wanted = {s: share / whole for s, (share, _) in live.items()}
    most = {s: sizes[s] * cap for s, (_, cap) in live.items()}
    if total is None:
        total = min((most[s] / wanted[s] for s in live), default=0.0)
        given = {s: min(most[s], total * wanted[s]) for s in live}
    else:
        given, open_, left = {}, set(live), min(total, sum(most.values()))
        while open_:
            part = sum(wanted[s] for s in open_)
            full = {s for s in open_ if left * wanted[s] / part > most[s]}
            for s in full or open_:
                given[s] = most[s] if full else left * wanted[s] / part
            left -= sum(given[s] for s in full)
            open_ = open_ - full if full else set()
    size = sum(given.values())
    return {s: {"rate": given[s] / sizes[s], "wanted": wanted[s], "planned": given[s] / size} for s in live}


def _size_class(n: Column) -> Column:
    """The top six bits of a size, and how many bits follow them."""
    shift = F.greatest(F.lit(0), F.length(F.bin(n)) - 6)
    return F.struct(shift.alias("bits"), F.floor(n / F.pow(F.lit(2.0), shift)).cast("int").alias("top"))


def mixture(records: DataFrame, targets: DataFrame, id_col: str, source_col: str, size_col: str, seed: int = 1, total: float | None = None) -> DataFrame:
    """``id_col, source_col, size_col, copy_no`` of the mixture: systematic sampling in every source.

    Within a source, records stand in order of size class and a hash; their expected copies, all
    equal to the source's rate, are summed from the first on, a random offset is added, and a record
    comes out once for each integer that the sum passes at it. A record has therefore the rate
    rounded down or up in copies, never more than the cap, and since the order follows the size, the
    sum of sizes stays near its target.

    The prefix sums are taken in two steps, over the counts of (size class, part) and within each of
    these, so that no source is gathered in one task. ``targets`` has ``source, target_share,
    max_repeats``; it and the sums by source are small tables by nature and go through the driver.
    Sources without target, targets without records and records of no size or no source give no
    row; null or negative shares count as 0. Repeated rows of records are records; extra columns are
    ignored; an empty table gives no rows.
    """
    spark = records.sparkSession
    rows = records.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size_col).cast("long").alias("size")).where("size > 0 and source is not null")
    sizes = {r["source"]: r["size"] for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    wanted = {r["source"]: (max(r["target_share"] or 0.0, 0.0), r["max_repeats"] or 0) for r in targets.collect()}
    plan = plan_mixture(sizes, wanted, total)
    rates = spark.createDataFrame([(s, p["rate"]) for s, p in plan.items()], "source string, rate double")
    place = rows.join(F.broadcast(rates), "source").withColumn("h", F.xxhash64(F.lit(seed), "id")).withColumn("cls", _size_class(F.col("size"))).withColumn("part", F.pmod("h", F.lit(PARTS)))
    counts = place.groupBy("source", "cls", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("cls", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("source", "cls", "part").orderBy("h", "id"))
    ranked = place.withColumn("i", inside).join(before, ["source", "cls", "part"])
    offset = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rank = F.col("before") + F.col("i")
    passed = F.floor(rank * F.col("rate") + offset) - F.floor((rank - 1) * F.col("rate") + offset)
    drawn = ranked.withColumn("copies", passed.cast("int")).where("copies > 0")
    return drawn.select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("size").alias(size_col), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))


def actual_shares(mixed: DataFrame, records: DataFrame, targets: DataFrame, source_col: str, size_col: str) -> DataFrame:
    """``source, target_share, max_repeats, source_size, mixed_size, actual_share`` of each source.

    Sources that occur in only one of ``records`` and ``targets`` are rows too.
    """
    got = mixed.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("mixed_size"))
    there = records.where(F.col(source_col).isNotNull()).groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"))
    whole = got.agg(F.sum("mixed_size").alias("whole"))
    return targets.select("source", "target_share", "max_repeats").join(there, "source", "full").join(got, "source", "left").join(F.broadcast(whole), F.lit(True), "left").select(
        "source", "target_share", "max_repeats", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("mixed_size", F.lit(0)).alias("mixed_size"),
        F.coalesce(F.col("mixed_size") / F.col("whole"), F.lit(0.0)).alias("actual_share"))
