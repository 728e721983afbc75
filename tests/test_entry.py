import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    rows = entry.entry(spark).collect()
    assert {r["split"] for r in rows} == {"train", "val"}
    assert sum(r["n_docs"] for r in rows) == 200
