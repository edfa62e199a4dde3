import __spark_entry__ as entry


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["symbol", "source", "interval", "ts"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
