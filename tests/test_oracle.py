"""Every registered query equals its DuckDB oracle on the smallest fixture."""

import pytest

import __spark_entry__ as E
from matchdesk.plans import catalog
from tests.conftest import SF_SMALL
from tools.oracle_check import compare

QUERIES = catalog.QUERIES
ORACLE = catalog.ORACLE


def test_every_query_is_registered():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


def test_every_query_has_oracle_or_is_rows_only():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck_small, name):
    r = compare(spark, SF_SMALL, name, QUERIES[name], ORACLE.get(name), duck_small)
    if ORACLE.get(name) is None:
        assert r["spark_rows"] >= 0
    else:
        assert r["schema"], r
        assert r["values"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 25
    assert df.columns[0] == "id"


@pytest.mark.parametrize("name", ["audit_rows", "audit_recent", "audit_volume", "validate_edits"])
def test_timestamps_ignore_session_time_zone(spark, duck_small, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        r = compare(spark, SF_SMALL, name, QUERIES[name], ORACLE[name], duck_small)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert r["values"], r
