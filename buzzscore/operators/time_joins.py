"""Joins on time: sessions of a user's events, the latest earlier row, rows inside intervals.

All are written for keys that hold a third of all rows: what is sorted per key
is a set of instants or of cells of time, combined before the shuffle, and wide
rows meet their answers in equi-joins of written tables, which Spark can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buzzscore.session import written

#: Instants of the busiest key that one slice of time should hold.
SLICE_ROWS = 200_000


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def sessions(events: DataFrame, by: Sequence[str], time: str, gap_seconds: int) -> DataFrame:
    """``by..., session_start, session_end, n_events``: events of a key with no pause over the gap.

    A new session begins where the pause is longer than ``gap_seconds``.
    Events in the same cell of time, a gap wide, are in one session; so cells
    (first, last, count) are combined before the shuffle, and only they are
    sorted: a key has no more of them than gaps fit into its time.  Events
    without a time are left out; a null key is a key of its own.
    """
    gap = gap_seconds * 1_000_000
    at = _micros(F.col(time))
    cells = (
        events.where(F.col(time).isNotNull())
        .groupBy(*by, F.floor(at / F.lit(gap)).alias("_cell"))
        .agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.count(F.lit(1)).alias("_n"))
    )
    order = Window.partitionBy(*by).orderBy("_cell")
    begins = F.coalesce((F.col("_first") - F.lag("_last").over(order) > gap).cast("long"), F.lit(1))
    numbered = cells.withColumn("_new", begins).withColumn("_session", F.sum("_new").over(order))
    return numbered.groupBy(*by, "_session").agg(
        F.timestamp_micros(F.min("_first")).alias("session_start"),
        F.timestamp_micros(F.max("_last")).alias("session_end"),
        F.sum("_n").alias("n_events"),
    ).drop("_session")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    right_order: Sequence[str],
    strictly: bool = False,
    tolerance_seconds: int | None = None,
    name: str = "match",
    slice_seconds: int | None = None,
) -> DataFrame:
    """All rows of ``left`` with the struct ``name``: the latest row of ``right`` of the same key, up to their time.

    Among rows of one instant the largest by ``right_order`` is taken; with
    ``strictly`` the row must be earlier.  ``name`` is null where there is none,
    none within ``tolerance_seconds``, or the key or time is null.

    1. Only instants matter: (key, time) of the left, and of the right with
       its last row there; both are combined before the shuffle.
    2. Instants of both sides are united and sorted per key and slice of time.
       The width of a slice (``slice_seconds``) is taken from the busiest key:
       ``SLICE_ROWS`` instants if they are spread evenly.
    3. The last right row is carried on within each slice, and the slices of
       a key, a row each, are stitched: an instant before the first right row
       of its slice takes the last one of the slices before.
    4. Left rows meet their instant's answer by (key, time).
    """
    if name in left.columns:
        raise ValueError(f"the left side has a column {name!r}")
    keys = [f"_k{i}" for i in range(len(by))]
    payload = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    left_at, right_at = _micros(F.col(left_time)), _micros(F.col(right_time))
    known = lambda df, t: df.where(F.col(t).isNotNull()).dropna(subset=list(by))

    asked = known(left, left_time).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], left_at.alias("_t")).distinct()
    given = known(right, right_time).select(
        *[F.col(c).alias(k) for c, k in zip(by, keys)], right_at.alias("_t"), payload.alias("_row"), F.struct(*right_order).alias("_o")
    )
    given = given.groupBy(*keys, "_t").agg(F.max_by("_row", "_o").alias("_row"))
    # at one instant the right row comes first, unless it must be earlier
    first, second = (1, 0) if strictly else (0, 1)
    both = asked.select(*keys, "_t", F.lit(second).alias("_side"), F.lit(None).cast(given.schema["_row"].dataType).alias("_row"))
    both = written(both.unionByName(given.select(*keys, "_t", F.lit(first).alias("_side"), "_row")), "instants")

    if slice_seconds is None:
        per_key = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max("_t") - F.min("_t") + 1).alias("span"))
        wide = F.ceil(F.col("span") * F.lit(float(SLICE_ROWS)) / F.col("n"))
        width = per_key.agg(F.max_by(wide, F.struct("n", "span"))).first()[0] or 1
    else:
        width = slice_seconds * 1_000_000
    sliced = both.withColumn("_s", F.expr(f"_t div {int(width)}L"))
    carry = Window.partitionBy(*keys, "_s").orderBy("_t", "_side")
    within = sliced.withColumn("_m", F.last("_row", ignorenulls=True).over(carry)).where(F.col("_side") == second)
    ends = sliced.where(F.col("_side") == first).groupBy(*keys, "_s").agg(F.max_by("_row", "_t").alias("_end"))
    # every slice that asks, with the last right row of the slices before it
    slices = sliced.groupBy(*keys, "_s").agg(F.max(F.col("_side") == second).alias("asks")).join(ends, [*keys, "_s"], "left")
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    stitched = slices.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).where("asks").drop("asks", "_end")
    stitched = written(stitched, "slices")
    answers = written(within.select(*keys, "_s", "_t", "_m"), "within").join(stitched, [*keys, "_s"])
    answers = written(answers.select(*keys, "_t", F.coalesce("_m", "_before").alias("_m")), "answers")

    l = left.alias("l")
    on = [F.col(f"l.`{c}`") == F.col(k) for c, k in zip(by, keys)] + [_micros(F.col(f"l.`{left_time}`")) == F.col("_t")]
    out = l.join(answers, on, "left")
    found = F.col("_m")
    if tolerance_seconds is not None:
        age = F.col("_t") - _micros(F.col("_m")[right_time])
        found = F.when(age <= tolerance_seconds * 1_000_000, found)
    return out.select(*[F.col(f"l.`{c}`") for c in left.columns], found.alias(name))


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    time: str,
    start: str,
    end: str,
    by: Sequence[str] = (),
    bin_seconds: int = 60,
) -> DataFrame:
    """Every pair of a point and an interval with ``start <= time <= end`` (and equal ``by``).

    The result has the points' columns and the intervals' but ``by``; their
    names must differ.  Without ``by`` all points meet all intervals in time.

    Levels of bins, each twice as wide as the one before, hold intervals by
    length: at its own level an interval touches two bins at most, so a long
    one is never dealt over many.  A point stands once in each level that
    holds an interval.  Pairs come from an equi-join on (level, bin, ``by``) of
    written tables: no loop over pairs, and a busy bin can be split.  An
    interval that ends before it starts, or lacks an end, holds no point; null
    keys meet nothing.
    """
    clash = (set(points.columns) & set(intervals.columns)) - set(by)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    base = bin_seconds * 1_000_000
    a, b = _micros(F.col(start)), _micros(F.col(end))
    bins = (b - a) / F.lit(float(base))
    # the least level whose bins are as wide as the interval
    level = F.when(bins <= 1, 0).otherwise(F.ceil(F.log2(F.greatest(bins, F.lit(1.0)))).cast("int"))
    width = F.lit(base) * F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_level"))
    place = lambda t: F.floor(t / width)
    spans = intervals.where(a <= b).withColumn("_level", level)
    spans = spans.withColumn("_bin", F.explode(F.array_distinct(F.array(place(a), place(b)))))
    spans = written(spans, "spans")
    levels = sorted(r["_level"] for r in spans.select("_level").distinct().collect())  # 63 at most
    at = _micros(F.col(time))
    spread = points.where(at.isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    spread = written(spread.withColumn("_bin", place(at)), "points")
    pairs = spread.join(spans, [*by, "_level", "_bin"])
    return pairs.where((F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end))).drop("_level", "_bin")
