"""Report tables over scored posts: summary, distribution, trend, histogram,
and the sampled chart data (scatter points, pie shares).

All are aggregations with map-side partial results (grouping keys have at
most 5 labels, 30 bins or one row per hour), so a label or bin that holds a
third of all rows costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buzzscore.operators.sampling import DEFAULT_SEED, exact_sample
from buzzscore.operators.scoring import MARGIN_Z
from buzzscore.operators.stats import scalars

# --- fixed values -----------------------------------------------------------
HISTOGRAM_BINS = 30
CHART_SAMPLE = 1000
HIGH_CONFIDENCE = 0.7
# ---------------------------------------------------------------------------


def summary(df: DataFrame, approx_users: bool = False) -> DataFrame:
    """One row: volume, time range, users, composite stats (with the 95 %
    margin of error of its mean) and confidence stats."""
    users = F.approx_count_distinct("username") if approx_users else F.count_distinct("username")
    n = F.count(F.lit(1))
    sd = F.stddev_samp("composite_signal")
    high = F.count_if(F.col("signal_confidence") > HIGH_CONFIDENCE)
    return df.agg(
        n.alias("total_posts"),
        F.min("timestamp").alias("earliest"),
        F.max("timestamp").alias("latest"),
        users.alias("unique_users"),
        F.avg("composite_signal").alias("composite_mean"),
        sd.alias("composite_std"),
        F.min("composite_signal").alias("composite_min"),
        F.max("composite_signal").alias("composite_max"),
        (F.lit(MARGIN_Z) * sd / F.sqrt(n.cast("double"))).alias("margin_of_error"),
        F.avg("signal_confidence").alias("avg_confidence"),
        high.alias("high_confidence"),
        (F.lit(100.0) * high / n).alias("high_confidence_pct"),
    )


def signal_distribution(df: DataFrame, label_col: str = "trading_signal") -> DataFrame:
    """Count and percent of all rows per label, most frequent first."""
    total = scalars(df, total=F.count(F.lit(1)))["total"]
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(
        label_col, "count", (F.lit(100.0) * F.col("count") / total).alias("percent")
    ).orderBy(F.col("count").desc(), F.col(label_col))


def hourly_trend(df: DataFrame, value_col: str = "composite_signal", every: str = "1 hour") -> DataFrame:
    """Per time bucket: posts, mean/min/max of the value (all rows, not a sample)."""
    return (
        df.groupBy(F.window("timestamp", every).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("posts"),
            F.avg(value_col).alias("mean_signal"),
            F.min(value_col).alias("min_signal"),
            F.max(value_col).alias("max_signal"),
        )
        .select(
            F.col("w.start").alias("bucket_start"),
            F.col("w.end").alias("bucket_end"),
            "posts",
            "mean_signal",
            "min_signal",
            "max_signal",
        )
    )


def histogram(df: DataFrame, value_col: str = "composite_signal", bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is closed.  A constant
    column uses the range [v - 0.5, v + 0.5], which puts every value in the
    middle bin.  Nulls are not counted."""
    s = scalars(df, lo=F.min(value_col), hi=F.max(value_col))
    span = s["hi"] - s["lo"]
    start = F.when(span == 0, s["lo"] - F.lit(0.5)).otherwise(s["lo"])
    width = F.when(span == 0, F.lit(1.0)).otherwise(span) / F.lit(float(bins))
    x = F.col(value_col)
    pos = F.floor((x - start) / width).cast("int") + F.lit(1)
    b = F.least(F.greatest(pos, F.lit(1)), F.lit(bins))
    counted = df.filter(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(
        "bin",
        (start + (F.col("bin") - 1) * width).alias("bin_lower"),
        (start + F.col("bin") * width).alias("bin_upper"),
        "count",
    )


def scatter_sample(df: DataFrame, n: int = CHART_SAMPLE, seed: int = DEFAULT_SEED) -> DataFrame:
    """Sampled points (signal, confidence, coloured by viral norm), oldest first."""
    pts = exact_sample(df, n, seed).select(
        "post_id", "timestamp", "composite_signal", "signal_confidence", "viral_score_norm"
    )
    return pts.orderBy("timestamp", "post_id")


def pie_shares(df: DataFrame, n: int = CHART_SAMPLE, seed: int = DEFAULT_SEED) -> DataFrame:
    """Label shares within the chart sample, percent with one decimal."""
    dist = signal_distribution(exact_sample(df, n, seed).select("post_id", "trading_signal"))
    return dist.select("trading_signal", "count", F.round("percent", 1).alias("percent"))


def signal_cube(df: DataFrame, label_col: str = "trading_signal", tag_col: str = "hashtags") -> DataFrame:
    """Posts over day x label x tag with all subtotals, and each cell's share of the cell with every label.

    ``level`` is the grouping id: 4, 2 and 1 where day, label and tag are totals;
    a null in a cell of a lower level is a missing value.  Rows are counted by
    (day, label, tag) before they are spread to the eight grouping sets; shares
    come from a window over the finished cube, so posts are read once.
    """
    cells = df.groupBy(F.to_date("timestamp").alias("day"), F.col(label_col).alias("label"), F.col(tag_col).alias("tag"))
    cells = cells.agg(F.count(F.lit(1)).alias("n"))
    cube = cells.cube("day", "label", "tag").agg(F.sum("n").alias("posts"), F.grouping_id().alias("level"))
    parent = F.max(F.when(F.col("level").bitwiseAND(2) == 2, F.col("posts"))).over(
        Window.partitionBy("day", "tag", F.col("level").bitwiseAND(5))
    )
    return cube.select("day", "label", "tag", "level", "posts", (F.lit(100.0) * F.col("posts") / parent).alias("percent"))
