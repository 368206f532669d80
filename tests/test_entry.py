from __future__ import annotations

import __spark_entry__ as entry


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_runs(spark, sf_dir):
    from tidewatch.plans import registry

    for name, query in registry.queries().items():
        assert query(spark, sf_dir).limit(1).collect() is not None, name
