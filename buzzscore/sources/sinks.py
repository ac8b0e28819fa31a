"""Writers for cleaned posts and scored signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buzzscore.schema import ESSENTIAL


def write_posts(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by_day: bool = False,
    mode: str = "overwrite",
) -> str:
    """Write a post table.  Parquet by default (optionally one folder per UTC
    day for partition pruning); CSV keeps every column, header, RFC quoting."""
    writer_df = df
    if partition_by_day and fmt == "parquet":
        writer_df = df.withColumn("day", F.to_date("timestamp"))
    w = writer_df.write.mode(mode)
    if fmt == "parquet":
        if partition_by_day:
            w = w.partitionBy("day")
        w.parquet(path)
    elif fmt == "csv":
        (
            w.option("header", True)
            .option("escape", '"')
            .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")
            .csv(path)
        )
    else:
        raise ValueError(f"unsupported format: {fmt}")
    return path


def essential(df: DataFrame) -> DataFrame:
    """The nine exported columns (Catalyst prunes everything else upstream)."""
    return df.select(*ESSENTIAL)


def write_signals(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    return write_posts(essential(df), path, fmt=fmt, mode=mode)
