"""Post schemas and the ``conform`` step that maps any input onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from buzzscore.functions.values import to_double

METRICS = ("retweets", "likes", "replies")
SIGNAL_LABELS = ("STRONG_BUY", "BUY", "HOLD", "SELL", "STRONG_SELL")

# Raw post as read from CSV/Parquet (timestamp still text).  ``post_id`` is the
# stable row identity that replaces "file order" for keep-first dedup.
RAW_POST = StructType(
    [
        StructField("post_id", LongType()),
        StructField("username", StringType()),
        StructField("timestamp", StringType()),
        StructField("content", StringType()),
        StructField("retweets", LongType()),
        StructField("likes", LongType()),
        StructField("replies", LongType()),
        StructField("mentions", StringType()),
        StructField("hashtags", StringType()),
    ]
)

# The same with metrics as doubles: what text formats are read as, since a
# metric may be written as 5.0 or 6.5 there.
TEXT_POST = StructType(
    [StructField(f.name, DoubleType()) if f.name in METRICS else f for f in RAW_POST.fields]
)

# Columns of the exported signal file.
ESSENTIAL = (
    "username",
    "timestamp",
    "content",
    "retweets",
    "likes",
    "replies",
    "composite_signal",
    "signal_confidence",
    "trading_signal",
)

# Collector output names -> post names.
RENAMES = {"date": "timestamp", "user": "username"}


def conform(
    df: DataFrame,
    schema: StructType = RAW_POST,
    coerce_metrics: bool = False,
    default_signal: bool = False,
) -> DataFrame:
    """Map a frame onto ``schema``.

    * renames collector columns (``date`` -> ``timestamp``, ``user`` -> ``username``);
    * a missing ``timestamp`` is an error, other missing columns get defaults
      (metrics 0, text ``''``);
    * present columns are ``try_cast`` to the declared type; a metric keeps its
      value or is missing (12.7 and 1e30 are no bigint; use ``TEXT_POST``);
    * a missing ``post_id`` becomes a hash of the row, the same however the
      input is split: rows that are equal in every column share it;
    * ``coerce_metrics``: metrics that are unparseable or null become 0
      (numbers like ``'12.5f'`` count as unparseable);
    * ``default_signal``: add ``trading_signal='HOLD'`` where absent/null.

    Columns outside the schema are kept after the schema's columns.
    """
    for old, new in RENAMES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    if "timestamp" not in df.columns:
        raise ValueError("input has no 'timestamp' (or 'date') column")
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for field in schema.fields:
        name, dtype = field.name, field.dataType
        if name not in types:
            if name == "post_id":
                value = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
            elif name in METRICS:
                value = F.lit(0).cast(dtype)
            elif isinstance(dtype, StringType):
                value = F.lit("")
            else:
                value = F.lit(None).cast(dtype)
        elif name in METRICS and types[name] != dtype:
            number = to_double(F.col(name), types[name])
            if coerce_metrics:
                number = F.coalesce(number, F.lit(0.0))
            # a number that the type cannot hold exactly is missing, not cut
            held = number.try_cast(dtype)
            value = F.when(held.cast("double") == number, held)
            if coerce_metrics:
                value = F.coalesce(value, F.lit(0).cast(dtype))
        elif name in METRICS and coerce_metrics:
            value = F.coalesce(F.nanvl(F.col(name), F.lit(None).cast(dtype)) if dtype == DoubleType() else F.col(name), F.lit(0).cast(dtype))
        elif types[name] == dtype:
            value = F.col(name)
        else:
            value = F.col(name).try_cast(dtype)
        cols.append(value.alias(name))
    extra = [c for c in df.columns if c not in schema.fieldNames()]
    if default_signal and "trading_signal" not in extra:
        cols.append(F.lit("HOLD").alias("trading_signal"))
    out = df.select(*cols, *extra)
    if default_signal and "trading_signal" in extra:
        out = out.withColumn("trading_signal", F.coalesce("trading_signal", F.lit("HOLD")))
    return out


def cast_losses(df: DataFrame, schema: StructType = RAW_POST) -> DataFrame:
    """``(column, present, lost, example)``: values that ``conform`` makes null, per column of ``schema`` in ``df``.

    One aggregation, a row per task.  ``present`` counts values that are not
    null, ``example`` is the smallest lost one as text.  ``lost`` is 0 for a
    column of the right type.  Collector names count as their own.
    """
    for old, new in RENAMES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    names = [f.name for f in schema.fields if f.name in df.columns]
    before = {c: f"_before_{i}" for i, c in enumerate(names)}
    both = conform(df.withColumns({b: F.col(c) for c, b in before.items()}), schema)
    aggs, cells = [], []
    for i, (c, b) in enumerate(before.items()):
        lost = F.col(b).isNotNull() & F.col(c).isNull()
        aggs += [
            F.count(b).alias(f"p{i}"),
            F.count_if(lost).alias(f"l{i}"),
            F.min(F.when(lost, F.col(b).cast("string"))).alias(f"e{i}"),
        ]
        cells.append(
            F.struct(F.lit(c).alias("column"), F.col(f"p{i}").alias("present"), F.col(f"l{i}").alias("lost"), F.col(f"e{i}").alias("example"))
        )
    return both.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def fill_text_nulls(df: DataFrame, columns=("content", "username")) -> DataFrame:
    """Tolerant load rule: null text becomes ``''``."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in columns if c in df.columns})
