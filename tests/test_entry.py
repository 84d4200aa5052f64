from __future__ import annotations

import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 6
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert {"p4_found", "link_counts", "em_ksi"} <= set(names)
