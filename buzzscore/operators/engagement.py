"""Engagement features: standardised metrics, viral score and its min-max norm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, NumericType

from buzzscore.functions.values import nan_to_null, to_double_or_zero
from buzzscore.operators.stats import as_literals, collect_stats, zscore
from buzzscore.schema import METRICS

# --- fixed values -----------------------------------------------------------
VIRAL_WEIGHTS = {"retweets": 0.4, "likes": 0.3, "replies": 0.3}
DEGENERATE_VIRAL_NORM = 0.5  # tolerant value when every viral score is equal
# ---------------------------------------------------------------------------


def coerce_metrics(df: DataFrame) -> DataFrame:
    """Tolerant input rule: missing metric columns are 0, unparseable or null
    values are 0.  Numeric columns keep their type."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for m in METRICS:
        if m not in types:
            out[m] = F.lit(0).cast("bigint")
        elif isinstance(types[m], FractionalType):
            out[m] = to_double_or_zero(F.col(m), types[m])  # NaN is missing, too
        elif isinstance(types[m], NumericType):
            out[m] = F.coalesce(F.col(m), F.lit(0).cast(types[m]))
        else:
            out[m] = to_double_or_zero(F.col(m), types[m])
    return df.withColumns(out)


def viral_score(weights=VIRAL_WEIGHTS):
    expr = None
    for m, w in weights.items():
        term = F.col(m).cast("double") * F.lit(float(w))
        expr = term if expr is None else expr + term
    return expr


def _with_viral(df: DataFrame, strict: bool, weights) -> DataFrame:
    if strict:
        missing = [m for m in METRICS if m not in df.columns]
        if missing:
            raise ValueError(f"missing metric columns: {missing}")
        # a NaN is left out of the fits and gives no score, like a null
        types = {f.name: f.dataType for f in df.schema.fields}
        floats = [m for m in METRICS if isinstance(types[m], FractionalType)]
        df = df.withColumns({m: nan_to_null(F.col(m).cast("double")) for m in floats})
    else:
        df = coerce_metrics(df)
    return df.withColumn("viral_score", viral_score(weights))


def _engagement_aggs() -> dict:
    aggs = {}
    for m in METRICS:
        x = F.col(m).cast("double")
        aggs[f"{m}_mean"] = F.avg(x)
        aggs[f"{m}_sd"] = F.stddev_pop(x)
    aggs["viral_min"] = F.min("viral_score")
    aggs["viral_max"] = F.max("viral_score")
    return aggs


def engagement_stats(df: DataFrame, strict: bool = False, weights=VIRAL_WEIGHTS) -> dict:
    """Fitted scaler means/σ and the viral range, as plain numbers."""
    return collect_stats(_with_viral(df, strict, weights), **_engagement_aggs())


def add_engagement(
    df: DataFrame, strict: bool = False, weights=VIRAL_WEIGHTS, stats: dict | None = None
) -> DataFrame:
    """Add ``engagement_signal``, ``viral_score``, ``viral_score_norm``.

    engagement_signal = mean of the three metric z-scores (population σ,
    σ = 0 -> 0); null if any metric is null (strict mode only — tolerant mode
    coerces nulls to 0 first).  viral_score_norm = min-max of viral_score;
    all-equal scores give 0.5 (tolerant) or null (strict).  ``stats`` (from
    ``engagement_stats``) freezes the statistics, e.g. for streams.
    """
    df = _with_viral(df, strict, weights)
    if stats is None:
        stats = collect_stats(df, **_engagement_aggs())
    s = as_literals(stats)
    z = [zscore(F.col(m).cast("double"), s[f"{m}_mean"], s[f"{m}_sd"], "scaler") for m in METRICS]
    engagement = (z[0] + z[1] + z[2]) / F.lit(3.0)
    span = s["viral_max"] - s["viral_min"]
    shifted = F.col("viral_score") - s["viral_min"]
    if strict:
        norm = F.try_divide(shifted, F.when(span != 0, span))
    else:
        norm = F.when(span == 0, F.lit(DEGENERATE_VIRAL_NORM)).otherwise(shifted / span)
    return df.withColumns({"engagement_signal": engagement, "viral_score_norm": norm})
