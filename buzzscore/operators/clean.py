"""Cleaning: normalise, parse, drop bad timestamps, keep-first dedup, derive.

Plan shape: one projection (codegen + one Arrow UDF stage for non-ASCII
text), a filter, and one shuffle for the dedup.  The dedup is a
``row_number() = 1`` window; Catalyst turns it into a ``WindowGroupLimit``
that keeps one row per (content, timestamp) *before* the shuffle as well as
after it, so a key holding a third of all rows costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buzzscore.functions.text import finish_text, nfc, py_lower, strip_ws
from buzzscore.functions.values import DEFAULT_TIMESTAMP_FORMATS, parse_timestamp


def normalize_posts(
    df: DataFrame, timestamp_formats: Sequence[str] = DEFAULT_TIMESTAMP_FORMATS
) -> DataFrame:
    """Column-wise normalisation; keeps every row (bad timestamps -> null).

    Staged projections: each expensive expression (regex strip, the UDF
    input) is materialised once and referenced by name afterwards, so
    Catalyst does not inline it into several places.
    """
    stripped = df.withColumns(
        {
            "username": strip_ws(F.col("username")),
            "content": strip_ws(F.col("content")),
            "mentions": strip_ws(F.coalesce(F.col("mentions"), F.lit(""))),
            "hashtags": strip_ws(F.coalesce(F.col("hashtags"), F.lit(""))),
            "timestamp": parse_timestamp(F.col("timestamp"), timestamp_formats),
        }
    )
    unicode_done = stripped.withColumns(
        {"username": py_lower(F.col("username")), "content": nfc(F.col("content"))}
    )
    return unicode_done.withColumn("content", finish_text(F.col("content")))


def _dedup_rank(order_by: Sequence[str]) -> Column:
    # The leading hash lets the sort decide on a long compare only on ties;
    # content itself stays in the key, so the result is collision-safe.
    w = Window.partitionBy(
        F.xxhash64("content"), F.col("timestamp"), F.col("content")
    ).orderBy(*order_by)
    return F.row_number().over(w)


def dedup_posts(df: DataFrame, order_by: Sequence[str] = ("post_id",)) -> DataFrame:
    """Keep the first post (by ``order_by``) of each (content, timestamp).

    Null content equals null content, as in pandas ``drop_duplicates``.
    """
    return df.withColumn("_rn", _dedup_rank(order_by)).filter(F.col("_rn") == 1).drop("_rn")


def derive_quality(df: DataFrame) -> DataFrame:
    """``content_length`` in code points; ``total_engagement`` null if any
    metric is null."""
    return df.withColumns(
        {
            "content_length": F.length("content"),
            "total_engagement": F.col("retweets") + F.col("likes") + F.col("replies"),
        }
    )


def clean_posts(
    raw: DataFrame, timestamp_formats: Sequence[str] = DEFAULT_TIMESTAMP_FORMATS
) -> DataFrame:
    """Raw posts -> cleaned posts (no global sort; see ``newest_first``)."""
    normed = normalize_posts(raw, timestamp_formats)
    valid = normed.filter(F.col("timestamp").isNotNull())
    return derive_quality(dedup_posts(valid))


def newest_first(df: DataFrame) -> DataFrame:
    """Newest first, ties by ``post_id`` (a range shuffle: use for export)."""
    return df.orderBy(F.col("timestamp").desc(), F.col("post_id"))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rows newest-first of the preview columns (top-k, no full sort)."""
    return newest_first(df).limit(n).select("username", "timestamp", "content", "total_engagement")


def cleaning_counts(raw: DataFrame, timestamp_formats=DEFAULT_TIMESTAMP_FORMATS) -> DataFrame:
    """``initial_count`` and ``after_cleaning`` from a narrow scan of raw rows."""
    ts = parse_timestamp(F.col("timestamp"), timestamp_formats)
    return raw.select(ts.alias("ts")).agg(
        F.count(F.lit(1)).alias("initial_count"),
        F.count("ts").alias("after_cleaning"),
    )


def cleaning_stats(
    raw: DataFrame,
    clean: DataFrame,
    output_file: str | None = None,
    timestamp_formats: Sequence[str] = DEFAULT_TIMESTAMP_FORMATS,
) -> DataFrame:
    """One-row statistics frame, nested like the reference's dict.

    Empty input gives null quality values instead of an error.
    """
    counts = cleaning_counts(raw, timestamp_formats)
    fmt = "yyyy-MM-dd HH:mm:ss"
    quality = clean.agg(
        F.count(F.lit(1)).alias("final_count"),
        F.avg("content_length").alias("avg_content_length"),
        F.avg("total_engagement").alias("avg_engagement"),
        F.count_distinct("username").alias("unique_users"),
        F.date_format(F.min("timestamp"), fmt).alias("earliest"),
        F.date_format(F.max("timestamp"), fmt).alias("latest"),
    )
    return counts.crossJoin(quality).select(
        "initial_count",
        "after_cleaning",
        "final_count",
        (F.col("after_cleaning") - F.col("final_count")).alias("duplicates_removed"),
        F.lit(output_file).cast("string").alias("output_file"),
        F.struct(
            "avg_content_length",
            "avg_engagement",
            "unique_users",
            F.struct("earliest", "latest").alias("date_range"),
        ).alias("data_quality"),
    )


def flat_stats(stats: DataFrame) -> DataFrame:
    """The statistics frame with its nested struct flattened."""
    return stats.select(
        "initial_count",
        "after_cleaning",
        "final_count",
        "duplicates_removed",
        "data_quality.avg_content_length",
        "data_quality.avg_engagement",
        "data_quality.unique_users",
        "data_quality.date_range.earliest",
        "data_quality.date_range.latest",
    )
