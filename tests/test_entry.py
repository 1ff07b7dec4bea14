import __spark_entry__ as e


def test_contract(spark):
    found, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(found) and all(callable(f) for f in found.values())
    assert e.entry(spark).columns == ["node", "load"]
