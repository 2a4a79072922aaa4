"""Driver contract: entry, queries and oracle SQL."""

import __spark_entry__ as entry


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert "risk_band" in df.columns


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_no_query_name_reuse():
    names = list(entry.queries())
    assert len(names) == len(set(names))
