"""Collection of recent posts per hashtag (re-aimed from a network search to a
query over a post table).

For each wanted tag: posts carrying the tag with ``date >= midnight UTC of
(as_of - 1 day)``, newest first, at most ``cap`` per tag, columns
``tag, date, user, content``.  A post with two wanted tags appears once per
tag.  The time bound is a literal, so Parquet sources get it as a pushed
filter; the per-tag cap is a ``row_number() <= cap`` window that Catalyst
turns into a ``WindowGroupLimit`` on both sides of the shuffle, so a tag
holding a third of all posts ships at most ``cap`` rows per task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

# --- fixed values -----------------------------------------------------------
DEFAULT_TAGS = ("nifty50", "sensex", "intraday", "banknifty")
DEFAULT_CAP = 501  # the loop stops once the 502nd item (index 501 > 500) arrives
# ---------------------------------------------------------------------------

COLLECTED = StructType(
    [
        StructField("tag", StringType()),
        StructField("date", TimestampType()),
        StructField("user", StringType()),
        StructField("content", StringType()),
    ]
)


def since_midnight(as_of: dt.datetime | dt.date | None = None) -> dt.datetime:
    """Midnight UTC of the day before ``as_of`` (default: now, UTC)."""
    if as_of is None:
        as_of = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    day = as_of if isinstance(as_of, dt.date) and not isinstance(as_of, dt.datetime) else as_of.date()
    return dt.datetime.combine(day - dt.timedelta(days=1), dt.time())


def post_tags(hashtags_col: str = "hashtags"):
    """Lower-cased tags of a post: words of the hashtag field, '#' removed."""
    words = F.split(F.lower(F.col(hashtags_col)), r"[\s,;]+")
    return F.array_distinct(
        F.filter(F.transform(words, lambda w: F.regexp_replace(w, "^#", "")), lambda w: w != "")
    )


def collect_recent(
    posts: DataFrame,
    tags: Sequence[str] = DEFAULT_TAGS,
    as_of: dt.datetime | dt.date | None = None,
    cap: int | None = DEFAULT_CAP,
    date_col: str = "date",
) -> DataFrame:
    """Posts per wanted tag since yesterday's UTC midnight, newest first."""
    wanted = [t.lower().lstrip("#") for t in tags]
    if not wanted:
        return posts.sparkSession.createDataFrame([], COLLECTED)
    since = since_midnight(as_of)
    recent = posts.filter(F.col(date_col) >= F.lit(since))
    tagged = recent.select(
        F.explode(post_tags()).alias("tag"),
        F.col(date_col).alias("date"),
        "user",
        "content",
        "post_id",
    ).filter(F.col("tag").isin(*wanted))
    if cap is not None:
        w = Window.partitionBy("tag").orderBy(F.col("date").desc(), F.col("post_id"))
        tagged = tagged.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap)
    return tagged.select("tag", "date", "user", "content")
