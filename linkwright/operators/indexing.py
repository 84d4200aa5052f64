"""Record numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwright.store import write

INDEX = "__idx"


def with_index(df: DataFrame, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """The rows with a contiguous number ``__idx`` from 0, in the order of ``order_by``.

    The order is found by a range partitioning and a sort of every part; a number is its part's
    offset plus the place within, so that no task sees all rows. Parts and places are written to the
    shared folder once, with the rows, and sizes and rows are both read from there: numbers taken in
    two executions need not mean the same parts. Without ``order_by`` rows are numbered as they
    come. An empty table stays empty; extra columns and repeated rows stay, nulls sort first.
    """
    if taken := {INDEX, "__part", "__at"} & set(df.columns):
        raise ValueError(f"these column names are taken: {sorted(taken)}")
    keys = [order_by] if isinstance(order_by, str) else list(order_by or [])
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    marked = write(placed.withColumn("__part", F.spark_partition_id()).withColumn("__at", place), "indexed").df
    sizes = marked.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # one row for each partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    return marked.join(F.broadcast(offsets), "__part").withColumn(INDEX, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")
