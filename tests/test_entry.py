import duckdb

import __spark_entry__ as e

SMALL = "/root/testdata/sf0.001"


def test_names_match():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    assert e.entry(spark).limit(1).count() == 1


def test_component_sources_are_dealt_out(spark):
    """One file with one row group is not one task's work."""
    from revlens.source_queries import component_sources

    assert component_sources(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_anchored_sessions_are_those_of_their_sql(spark):
    """What sessions carry along for others is not handed on: the same columns in the same order, and the same rows."""
    got, con = e.queries()["anchored_sessions"](spark, SMALL), duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    want = con.execute(e.oracle_sql()["anchored_sessions"])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
