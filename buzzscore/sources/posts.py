"""Readers for post tables.

``read_posts`` reads CSV or Parquet with a declared schema (no inference).
``posts_from_testdata`` and ``tagged_events`` build post tables from the
supplied benchmark tables (``documents`` joined with ``events``), so every
query's work grows with those tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from buzzscore.schema import RAW_POST, TEXT_POST, conform
from buzzscore.sources.split_csv import read_split_csv

# --- fixed values -----------------------------------------------------------
# Strings read as missing in CSV input, besides the empty field.
CSV_MISSING = ("NA", "N/A", "NaN", "nan", "NULL", "null", "None", "n/a", "#N/A")
# ---------------------------------------------------------------------------


def read_posts(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    schema: StructType | None = None,
) -> DataFrame:
    """Read posts from CSV (header, quoted multi-line fields) or Parquet.

    CSV columns go by the names in the header, in any order; collector names
    (``date``, ``user``) are renamed, missing columns get ``conform``'s
    defaults, and a header without a time column is an error.  Every value is
    read as text and converted after that; metrics become doubles (``5.0`` and
    ``6.5`` are numbers) unless ``schema`` says otherwise.

    Files are read in any number of splits, also those with line breaks inside
    quoted fields (:mod:`buzzscore.sources.split_csv`).
    """
    if fmt == "parquet":
        return conform(spark.read.parquet(path), schema or RAW_POST)
    if fmt != "csv":
        raise ValueError(f"unsupported format: {fmt}")
    df = read_split_csv(spark, path)
    values = [F.when(~F.col(f"`{c}`").isin(*CSV_MISSING), F.col(f"`{c}`")).alias(c) for c in df.columns]
    return conform(df.select(*values), schema or TEXT_POST)


def deal_out(df: DataFrame) -> DataFrame:
    """Deal the rows of a file scan out to all cores if fewer splits than cores have rows.

    A row group cannot be read in parallel: it belongs to the split that its
    middle is in, and the other splits of its file have no rows.  Counting the
    splits that have some reads no column.  There are fewer of them than
    cores, each of at most ``spark.sql.files.maxPartitionBytes`` or one row
    group, so what is shuffled here is bounded by the cores, whatever the input.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.select(F.spark_partition_id().alias("split")).distinct().limit(cores).count()
    return df if splits >= cores else df.repartition(2 * cores)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def posts_from_testdata(spark: SparkSession, sf_dir: str, day_grain: bool = True) -> DataFrame:
    """Raw posts built from ``documents`` joined one-to-one with ``events``.

    Column rules (they exercise cleaning): padded usernames and content,
    every 97th-ish document has an unparseable timestamp, mentions are null
    for every third document.  ``day_grain`` truncates the time to the day,
    which creates (content, timestamp) duplicates; otherwise the full
    microsecond time is kept.
    """
    docs = deal_out(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars"))
    events = _read(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value"
    )
    j = docs.join(events, docs.doc_id == events.event_id)
    if day_grain:
        when_text = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" 00:00:00"))
    else:
        when_text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return j.select(
        F.col("doc_id").alias("post_id"),
        F.concat(F.lit("  User_"), F.col("user_id").cast("string"), F.lit(" ")).alias("username"),
        F.when(F.col("doc_id") % 97 == 13, F.lit("not a date"))
        .otherwise(when_text)
        .alias("timestamp"),
        F.concat(F.lit("  "), F.col("text"), F.lit(" ")).alias("content"),
        F.floor("value").cast("bigint").alias("retweets"),
        (F.col("n_chars") % 500).cast("bigint").alias("likes"),
        (F.col("doc_id") % 17).cast("bigint").alias("replies"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(" @"), F.col("lang")))
        .alias("mentions"),
        F.concat(F.lit("#"), F.col("event_type")).alias("hashtags"),
    )


def tagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as collected posts: one hashtag (the event type) per post."""
    e = _read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("post_id"),
        F.col("ts").cast("timestamp").alias("date"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user"),
        F.col("props").alias("content"),
        F.concat(F.lit("#"), F.col("event_type")).alias("hashtags"),
    )


def documents_as_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` alone: ``post_id`` and ``content`` (text features input)."""
    d = deal_out(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(F.col("doc_id").alias("post_id"), F.col("text").alias("content"))


def union_sources(*frames: DataFrame) -> DataFrame:
    """Union all of several post sources by column name; columns missing from
    a source are null there (no dedup: a post in two sources appears twice)."""
    if not frames:
        raise ValueError("no sources")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
