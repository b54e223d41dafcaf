import __spark_entry__ as driver


def test_entry_has_rows_and_a_stable_schema(spark):
    df = driver.entry(spark)
    assert df.columns == ["target", "near", "distance", "place"] and df.count() == 10


def test_sql_belongs_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())
