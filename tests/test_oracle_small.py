"""Registered queries vs their DuckDB SQL on the smallest supplied tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

FAST = [
    "clean_stats", "clean_posts", "newest_posts", "conform_defaults", "collect_recent",
    "engagement_signal", "vocabulary", "tfidf_weights", "tfidf_gram", "composite_scores",
    "signals", "summary_report", "signal_histogram", "pie_sample",
]


@pytest.fixture(scope="module")
def duck():
    from check_oracle import duck_connect

    return duck_connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, duck, name):
    import __spark_entry__ as entry
    from check_oracle import compare

    res = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], "/root/testdata/sf0.001", duck, verbose=True)
    assert res["status"] == "ok", res


def test_entry_smoke(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() >= 0 and "trading_signal" in df.columns
