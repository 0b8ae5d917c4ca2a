import __spark_entry__ as E


def test_contract(spark):
    qs, oracle = E.queries(), E.oracle_sql()
    assert set(oracle) <= set(qs)
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["query_id", "doc_id", "combined_score", "rank", "title"]
    assert max(r["rank"] for r in rows) <= 3
