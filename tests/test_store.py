"""Written tables."""

from linkwright.store import RUNS_TO_COLLECT, write


def _collections(spark):
    return sum(x.getCollectionCount() for x in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in x.getName() or "MarkSweep" in x.getName())


def test_the_driver_collects_its_garbage_while_many_tables_are_written(spark):
    before = _collections(spark)
    for n in range(2 * RUNS_TO_COLLECT):
        write(spark.range(n), "small").drop()
    assert _collections(spark) >= before + 2
