"""Cleaning: dedup keep-first, derived columns, statistics, conform."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from buzzscore.operators.clean import clean_posts, cleaning_stats, flat_stats
from buzzscore.schema import RAW_POST, conform


def _raw(spark, rows):
    return spark.createDataFrame(rows, RAW_POST)


def test_dedup_keeps_first_and_handles_offsets(spark):
    rows = [
        # same content and instant, written with different offsets
        (1, "a", "2025-09-01T10:00:00+00:00", "same", 1, 1, 1, None, None),
        (2, "b", "2025-09-01T15:30:00+05:30", "same", 2, 2, 2, None, None),
        # null content twice at one instant -> one row
        (3, "c", "2025-09-01 11:00:00", None, 0, 0, 0, None, None),
        (4, "d", "2025-09-01 11:00:00", None, 0, 0, 0, None, None),
        # same content, different instant -> both kept
        (5, "e", "2025-09-01 12:00:00", "other", 0, 0, 0, None, None),
        (6, "f", "2025-09-01 12:00:01", "other", 0, 0, 0, None, None),
        # equal only after normalisation
        (7, "g", "2025-09-01 13:00:00", "  x \u200c y ", 0, 0, 0, None, None),
        (8, "h", "2025-09-01 13:00:00", "\tx \u200c y\n", 0, 0, 0, None, None),
        # bad timestamp
        (9, "i", "not a date", "z", 0, 0, 0, None, None),
    ]
    clean = clean_posts(_raw(spark, rows))
    kept = sorted(r["post_id"] for r in clean.collect())
    assert kept == [1, 3, 5, 6, 7]
    stats = flat_stats(cleaning_stats(_raw(spark, rows), clean)).first()
    assert (stats.initial_count, stats.after_cleaning, stats.final_count, stats.duplicates_removed) == (9, 8, 5, 3)


def test_derived_columns(spark):
    rows = [
        (1, " U ", "2025-01-01", "\U0001f600 ok", 1, None, 3, None, " #x "),
        (2, "V", "2025-01-02", "abc", 1, 2, 3, " @m ", None),
    ]
    out = {r["post_id"]: r for r in clean_posts(_raw(spark, rows)).collect()}
    assert out[1]["content_length"] == 4  # emoji counts as one code point
    assert out[1]["total_engagement"] is None  # a null metric propagates
    assert out[2]["total_engagement"] == 6
    assert out[1]["hashtags"] == "#x" and out[1]["mentions"] == ""
    assert out[2]["mentions"] == "@m" and out[2]["hashtags"] == ""
    assert out[1]["username"] == "u"


def test_stats_date_range_and_empty_input(spark):
    rows = [(1, "a", "2025-01-01 00:00:00", "x", 1, 1, 1, None, None),
            (2, "b", "2025-01-03 05:06:07", "y", 1, 1, 1, None, None)]
    s = cleaning_stats(_raw(spark, rows), clean_posts(_raw(spark, rows))).first()
    assert s.data_quality.date_range.earliest == "2025-01-01 00:00:00"
    assert s.data_quality.date_range.latest == "2025-01-03 05:06:07"
    empty = _raw(spark, [])
    e = flat_stats(cleaning_stats(empty, clean_posts(empty))).first()
    assert e.initial_count == 0 and e.final_count == 0 and e.earliest is None


def test_conform_renames_and_defaults(spark):
    df = spark.createDataFrame([("2025-01-01", "someone", "hi", "12.5f")], "date string, user string, content string, likes string")
    out = conform(df, RAW_POST, coerce_metrics=True, default_signal=True).first()
    assert out.timestamp == "2025-01-01" and out.username == "someone"
    assert out.likes == 0 and out.retweets == 0 and out.mentions == ""
    assert out.trading_signal == "HOLD"
    with pytest.raises(ValueError):
        conform(spark.createDataFrame([("x",)], "content string"))


def test_clean_posts_partition_independent(spark):
    from buzzscore.sources.posts import posts_from_testdata

    raw = posts_from_testdata(spark, "/root/testdata/sf0.001")
    a = sorted(tuple(r) for r in clean_posts(raw).select("post_id", "content").collect())
    b = sorted(tuple(r) for r in clean_posts(raw.repartition(13).orderBy(F.rand(7))).select("post_id", "content").collect())
    assert a == b


def test_collect_recent_cap_and_window(spark):
    from buzzscore.operators.collect import collect_recent

    rows = [(i, dt.datetime(2024, 1, 2, 0, 0, i % 60), f"u{i}", f"c{i}", "#Alpha #beta" if i % 2 else "#alpha")
            for i in range(40)]
    rows.append((99, dt.datetime(2023, 12, 30), "old", "old", "#alpha"))
    posts = spark.createDataFrame(rows, "post_id long, date timestamp, user string, content string, hashtags string")
    got = collect_recent(posts, ["alpha", "beta"], as_of=dt.date(2024, 1, 2), cap=5).collect()
    by_tag = {}
    for r in got:
        by_tag.setdefault(r.tag, []).append(r)
    assert len(by_tag["alpha"]) == 5 and len(by_tag["beta"]) == 5
    assert all(r.user != "old" for r in got)
    none = collect_recent(posts, [], as_of=dt.date(2024, 1, 2))
    assert none.count() == 0 and none.columns == ["tag", "date", "user", "content"]


def test_union_sources_keeps_duplicates_and_fills_missing(spark):
    from buzzscore.sources.posts import union_sources

    a = spark.createDataFrame([(1, "x")], "post_id long, content string")
    b = spark.createDataFrame([(1, "x", "#t")], "post_id long, content string, hashtags string")
    out = union_sources(a, b).orderBy("hashtags").collect()
    assert len(out) == 2 and out[0].hashtags is None and out[1].hashtags == "#t"
