"""Distinct counts and quantiles of any range of days from one small row a day.

A day's row holds its count, a HyperLogLog sketch of the distinct keys and a
KLL sketch of the values.  Rows merge: a range of days is answered from its
days' rows, and a late batch of a day is one more row of that day, so posts are
read once.  Store the table with ``write.parquet``; a row has some tens of KB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a distinct count, and the size of a quantile sketch.
LG_REGISTERS = 14
QUANTILE_SIZE = 800


def distinct_error(lg_registers: int = LG_REGISTERS) -> float:
    """Standard error of a merged distinct count, as a share of it."""
    return 1.04 / 2 ** (lg_registers / 2)


def rank_error(size: int = QUANTILE_SIZE) -> float:
    """Error of a quantile's rank that 99 of 100 sketches keep, as a share of the values."""
    return 2.296 / size**0.9723


def day_sketches(posts: DataFrame, time: str, key: str, value: str) -> DataFrame:
    """``(day, n, keys, quantiles)``, one row a day; sketches are combined before the shuffle.

    A null time is a day of its own, in no range; null keys and null or NaN
    values are counted in ``n`` only.
    """
    number = F.col(value).cast("double")
    return posts.groupBy(F.to_date(time).alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg(F.col(key).cast("string"), LG_REGISTERS).alias("keys"),
        F.kll_sketch_agg_double(F.when(~F.isnan(number), number), QUANTILE_SIZE).alias("quantiles"),
    )


def over_ranges(sketches: DataFrame, ranges: DataFrame, ranks: tuple[float, ...] = (0.5,)) -> DataFrame:
    """``(first_day, last_day, n, distinct, quantiles)`` for each of ``ranges (first_day, last_day)``.

    ``quantiles`` has a value for each of ``ranks``, null where a range has no
    value; a range without a day in the table has no row.  Ranges meet the days'
    rows by day; what is shuffled are sketches, never posts.
    """
    days = ranges.distinct().withColumn("day", F.explode(F.sequence("first_day", "last_day")))
    met = days.join(sketches, "day")
    merged = met.groupBy("first_day", "last_day").agg(
        F.sum("n").alias("n"), F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_double("quantiles", QUANTILE_SIZE).alias("q")
    )
    at = [F.when(F.kll_sketch_get_n_double("q") > 0, F.kll_sketch_get_quantile_double("q", F.lit(float(r)))) for r in ranks]
    return merged.select("first_day", "last_day", "n", F.hll_sketch_estimate("keys").alias("distinct"), F.array(*at).alias("quantiles"))
