"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
import check_oracles
from conftest import SMALL

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


def test_every_query_is_registered_with_callable():
    assert len(QUERIES) >= 80
    assert all(callable(f) for f in QUERIES.values())
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["state", "order_count", "total_units", "unique_items"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    r = check_oracles.compare(spark, duck, name, QUERIES[name], ORACLES.get(name), SMALL)
    assert r["status"] in ("match", "rows-only"), r


@pytest.mark.parametrize("name", ["flat_stream", "tumbling_1m", "instant_lookup", "read_from_timestamp",
                                  "stream_tumbling_1m"])
def test_results_do_not_depend_on_session_time_zone(spark, duck, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        r = check_oracles.compare(spark, duck, name, QUERIES[name], ORACLES.get(name), SMALL)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert r["status"] == "match", r
