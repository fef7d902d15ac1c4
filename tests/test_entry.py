import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["node", "level"] and df.count() > 0


def test_queries_have_names():
    found = entry.queries()
    assert len(found) > 60 and not set(entry.oracle_sql()) - set(found)
