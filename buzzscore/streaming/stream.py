"""Structured Streaming: clean, score and count posts as they arrive.

* ``clean_stream``: the batch cleaning expressions (stateless) plus
  ``withWatermark`` + ``dropDuplicatesWithinWatermark(content, timestamp)``;
  duplicates later than the watermark are no longer caught (batch catches
  them), and the first *arriving* copy is kept.
* Scoring needs a fitted text model and global statistics, which are not
  defined on an unbounded stream, so both are **frozen**: fit once on a batch
  (``freeze``), then every micro-batch is scored against them.  Scoring runs
  in ``foreachBatch`` with the batch code; each micro-batch writes its own
  folder (``batch_id=N``, overwrite), so a retried batch replaces its output:
  exactly-once files with the checkpointed source offsets.
* ``label_counts``: tumbling event-time windows per label, watermarked,
  append mode (a window is emitted once the watermark passes its end).
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from buzzscore.operators.clean import derive_quality, normalize_posts
from buzzscore.operators.engagement import add_engagement, engagement_stats
from buzzscore.operators.lsa import TextModel
from buzzscore.operators.scoring import add_composite, composite_stats
from buzzscore.plans.text import add_text_features
from buzzscore.schema import ESSENTIAL, RAW_POST, fill_text_nulls
from buzzscore.session import checkpoint_dir


@dataclass
class FrozenScoring:
    model: TextModel
    engagement: dict
    composite: dict


def freeze(clean_posts: DataFrame, model: TextModel) -> FrozenScoring:
    """Fit the engagement and composite statistics on a batch of posts."""
    base = add_text_features(fill_text_nulls(clean_posts), model)
    eng = engagement_stats(base)
    return FrozenScoring(model, eng, composite_stats(add_engagement(base, stats=eng)))


def score_batch(posts: DataFrame, frozen: FrozenScoring) -> DataFrame:
    """Score cleaned posts against frozen model and statistics (no global
    aggregation over ``posts``)."""
    featured = add_text_features(fill_text_nulls(posts), frozen.model)
    scored = add_engagement(featured, stats=frozen.engagement)
    return add_composite(scored, frozen=frozen.composite)


def clean_stream(raw: DataFrame, watermark: str = "1 hour") -> DataFrame:
    normed = normalize_posts(raw).filter(F.col("timestamp").isNotNull())
    deduped = normed.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(
        ["content", "timestamp"]
    )
    return derive_quality(deduped)


def read_post_stream(spark: SparkSession, path: str, schema: StructType = RAW_POST) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def start_scoring(
    spark: SparkSession,
    source: str,
    sink: str,
    frozen: FrozenScoring,
    checkpoint: str | None = None,
    watermark: str = "1 hour",
    available_now: bool = True,
) -> StreamingQuery:
    """Clean + score a Parquet post directory into ``sink`` (Parquet)."""
    checkpoint = checkpoint or os.path.join(checkpoint_dir(spark), "stream-scoring")
    cleaned = clean_stream(read_post_stream(spark, source), watermark)

    def write(batch: DataFrame, batch_id: int) -> None:
        out = score_batch(batch, frozen).select("post_id", *ESSENTIAL)
        out.write.mode("overwrite").parquet(os.path.join(sink, f"batch_id={batch_id}"))

    writer = cleaned.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def label_counts(scored: DataFrame, window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Tumbling-window counts per label (works on streams and batches)."""
    return (
        scored.withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", window).alias("w"), "trading_signal")
        .agg(F.count(F.lit(1)).alias("posts"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "trading_signal", "posts")
    )


def start_label_counts(
    spark: SparkSession,
    scored_path: str,
    sink: str,
    schema: StructType,
    checkpoint: str | None = None,
    window: str = "1 hour",
    watermark: str = "1 hour",
) -> StreamingQuery:
    checkpoint = checkpoint or os.path.join(checkpoint_dir(spark), "stream-label-counts")
    scored = spark.readStream.schema(schema).parquet(scored_path)
    return (
        label_counts(scored, window, watermark)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
