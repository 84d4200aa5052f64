"""Tables that cut lineage, kept in the folder all executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset (tests, a single
machine) a local folder is made. Tables are Parquet, so that they are compressed, survive the loss
of an executor and can be dropped as soon as a later one replaces them.
"""

from __future__ import annotations

import gc
import itertools
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Runs after which the driver collects its garbage, the first one among them.
RUNS_TO_COLLECT = 8
_RUNS = itertools.count()
#: Spark's own setting by which the shuffle files of a run go with its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application, without a trailing slash."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder which all executors share")
        if "root" not in _LOCAL:
            _LOCAL["root"] = tempfile.mkdtemp(prefix="linkwright-")
        root = _LOCAL["root"]
    return f"{root.rstrip('/')}/linkwright/{spark.sparkContext.applicationId}"


class Table:
    """A written table: ``df`` reads it, ``drop`` removes its files."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def write(df: DataFrame, name: str = "t", partition_by: Sequence[str] = (), codec: str | None = None) -> Table:
    """Run ``df`` once and keep its rows as a table of the shared folder, compressed by ``codec`` or as the session does.

    The shuffle files of the run are removed as soon as it has ended: the rows are in the table.
    """
    spark = df.sparkSession
    table = Table(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    table.schema = df.schema
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(table.path, compression=codec)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    if next(_RUNS) % RUNS_TO_COLLECT == 0:
        # plans of many short runs: the driver's heap would sooner grow to its limit than let them go
        gc.collect()
        spark._jvm.System.gc()
    for kept in getattr(_SCOPE, "open", []):
        kept.append(table)
    return table


_SCOPE = threading.local()


@contextmanager
def dropped_at_end() -> Iterator[None]:
    """All tables that this thread writes inside go at the end; results must have been used by then."""
    tables: list[Table] = []
    _SCOPE.open = [*getattr(_SCOPE, "open", []), tables]
    try:
        yield
    finally:
        _SCOPE.open = _SCOPE.open[:-1]
        for table in tables:
            table.drop()
