"""Every registered query against its DuckDB counterpart on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in check.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    ok, note, _ = check.compare(spark, con, SF, name, entry.oracle_sql().get(name))
    assert ok, note


LARGE = [
    "bh_fdr", "bh_fdr_by_group", "bh_fdr_log10p", "assoc_cis", "cis_pairs", "pair_span", "overlap_pairs",
    "interval_signal", "contact_lookup", "contact_oe", "signal_oe", "training_set", "io_sparse_contacts",
]


@pytest.mark.parametrize("name", LARGE)
def test_as_if_tables_were_large(spark, con, name, monkeypatch):
    """Hot keys are looked for and spread, derived inputs written, and nothing counts as small enough to broadcast."""
    from pairlift.operators import skew

    monkeypatch.setattr(skew, "SKEW_CHECK_BYTES", 0)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "shuffle_partitions", lambda _: 100)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ok, note, _ = check.compare(spark, con, SF, name, entry.oracle_sql()[name])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert ok, note


def test_every_counterpart_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["key", "p", "fdr"] and df.count() > 0
