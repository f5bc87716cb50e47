import __spark_entry__ as contract


def test_contract(spark):
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries)
    assert all(any(n == f"p{k}_found" for n in queries) for k in range(1, 8))
    df = contract.entry(spark)
    assert df.columns == ["event_key", "session_start_us", "session_end_us", "duration_us", "n_events"] and df.count() > 0
