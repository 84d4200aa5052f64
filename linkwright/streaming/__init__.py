"""Linking micro-batches of a stream with a table, under a fitted model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from linkwright.operators.compare import Comparison
from linkwright.operators.link import Linkage
from linkwright.store import dropped_at_end


def link_batches(stream: DataFrame, table: DataFrame, fuzzy: Sequence[str], exact: Sequence[str], ksi: Sequence[float] | np.ndarray, sink: Callable[[DataFrame, int], None], *, block_on: Sequence[str] = (), order_by: str, threshold: float = 0.85) -> DataStreamWriter:
    """A writer that links each micro-batch with ``table`` and hands the matches to ``sink(df, batch id)``.

    The match probabilities are frozen; batches without a match hand on an empty table. The sink must
    have used the matches when it returns: what was written to find them is then removed.
    """

    def run(batch: DataFrame, number: int) -> None:
        with dropped_at_end():
            made = Comparison(batch, table, fuzzy, fuzzy, exact, exact, block_on=block_on, order_by_a=order_by, order_by_b=order_by).fit()
            sink(Linkage(made.a, made.b, made, ksi).transform(threshold, compat=False), number)

    return stream.writeStream.foreachBatch(run)
