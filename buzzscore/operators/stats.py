"""Global statistics for column expressions.

``scalars(df, name=agg, ...)`` runs one aggregation job (map-side partial
aggregates, one row per task into the final step) and returns its single
row as literal Columns.  The outer plan therefore carries constants, not
nested subqueries: later statistics that depend on earlier ones (composite
score -> its own mean/σ) stay flat plans, and codegen folds the constants.
Never an unpartitioned window over all rows, never a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType


def collect_stats(df: DataFrame, **aggs: Column) -> dict:
    """One aggregation job; its single row as a dict of Python numbers."""
    row = df.agg(*[agg.alias(name) for name, agg in aggs.items()]).first()
    out = {}
    for name in aggs:
        value = row[name]
        out[name] = float(value) if isinstance(value, float) else value
    return out


def as_literals(values: dict) -> dict[str, Column]:
    """Python numbers -> typed literal Columns (None -> null double)."""
    out = {}
    for name, value in values.items():
        if value is None or isinstance(value, float):
            out[name] = F.lit(value).cast(DoubleType())
        elif isinstance(value, int):
            out[name] = F.lit(value).cast(LongType())
        else:
            out[name] = F.lit(value)
    return out


def scalars(df: DataFrame, **aggs: Column) -> dict[str, Column]:
    """Map each name to a literal Column holding ``aggs[name]`` over ``df``."""
    return as_literals(collect_stats(df, **aggs))


def zscore(x: Column, mean: Column, sd: Column, mode: str) -> Column:
    """Standardise ``x``.

    * ``"scaler"``: population σ, σ = 0 (or null) divides by 1 (fitted scaler);
    * ``"safe"``: σ > 0 ? (x - mean)/σ : 0;
    * ``"strict"``: (x - mean)/σ, null when σ is 0 or null.
    """
    if mode == "scaler":
        scale = F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)
        return (x - mean) / scale
    if mode == "safe":
        return F.when(sd > 0, (x - mean) / sd).otherwise(F.lit(0.0))
    if mode == "strict":
        return F.try_divide(x - mean, F.when(sd != 0, sd))
    raise ValueError(mode)
