import importlib


def test_entry_and_oracles(spark):
    entry = importlib.import_module("__spark_entry__")
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries)
    assert entry.entry(spark).count() > 0
