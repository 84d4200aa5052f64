"""Text normalisation with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare(column: Column | str) -> Column:
    """Lower case without any character that is neither a letter nor a digit; null counts as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", "")
