"""Composite score, confidence and the five-way classification.

Global statistics are collected eagerly (one row each, see ``operators.stats``)
or given as ``frozen``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buzzscore.operators.stats import as_literals, collect_stats, zscore

# --- fixed values -----------------------------------------------------------
COMPONENT_WEIGHTS = {"text": 0.5, "engagement": 0.3, "viral": 0.2}
TOP_FEATURES = 5
CONFIDENCE_SPREAD = 3.0  # confidence = 1 - |s - mean| / (3 σ)
MARGIN_Z = 1.96
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Thresholds:
    """Classification cut-offs; every comparison is strict."""

    strong: float = 0.5
    weak: float = 0.2
    strong_confidence: float = 0.7
    weak_confidence: float = 0.6


def feature_columns(df: DataFrame, prefix: str = "text_feature_") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def rank_features(df: DataFrame, feature_cols: Sequence[str]) -> list[tuple[str, float | None]]:
    """Features ordered by sample variance, largest first (null/NaN last,
    ties in column order).  One aggregation, one row to the driver."""
    if not feature_cols:
        return []
    row = df.agg(*[F.var_samp(c).alias(c) for c in feature_cols]).first()
    def key(item):
        pos, name = item
        v = row[name]
        missing = v is None or (isinstance(v, float) and math.isnan(v))
        return (1 if missing else 0, 0.0 if missing else -v, pos)

    ranked = sorted(enumerate(feature_cols), key=key)
    return [(name, row[name]) for _, name in ranked]


def top_features(df: DataFrame, feature_cols: Sequence[str] | None = None, n: int = TOP_FEATURES) -> list[str]:
    cols = list(feature_cols) if feature_cols is not None else feature_columns(df)
    return [name for name, _ in rank_features(df, cols)[: min(n, len(cols))]]


def row_mean(cols: Sequence[str]) -> Column:
    """Mean of the non-null values among ``cols`` (null if all are null)."""
    total = None
    count = None
    for c in cols:
        v = F.coalesce(F.col(c), F.lit(0.0))
        k = F.when(F.col(c).isNotNull(), F.lit(1)).otherwise(F.lit(0))
        total = v if total is None else total + v
        count = k if count is None else count + k
    return F.try_divide(total, F.when(count > 0, count.cast("double")))


def classify(s: Column, c: Column, t: Thresholds = Thresholds()) -> Column:
    """First match wins; null or NaN score or confidence -> HOLD."""
    s, c = F.nanvl(s, F.lit(None).cast("double")), F.nanvl(c, F.lit(None).cast("double"))
    return (
        F.when((s > t.strong) & (c > t.strong_confidence), F.lit("STRONG_BUY"))
        .when((s > t.weak) & (c > t.weak_confidence), F.lit("BUY"))
        .when((s < -t.strong) & (c > t.strong_confidence), F.lit("STRONG_SELL"))
        .when((s < -t.weak) & (c > t.weak_confidence), F.lit("SELL"))
        .otherwise(F.lit("HOLD"))
    )


def clip01(x: Column) -> Column:
    """Clip to [0, 1]; null stays null (``greatest``/``least`` skip nulls)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def add_composite(
    df: DataFrame,
    feature_cols: Sequence[str] | None = None,
    weights: dict[str, float] = COMPONENT_WEIGHTS,
    thresholds: Thresholds = Thresholds(),
    strict: bool = False,
    frozen: dict | None = None,
) -> DataFrame:
    """Add ``text_component``, ``composite_signal``, ``signal_confidence`` and
    ``trading_signal`` to a frame that has engagement columns and (optionally)
    text features.

    Tolerant: σ = 0 components contribute 0, composite σ = 0 gives
    confidence 1, no text features gives a 0 text component.  Strict: those
    cases give null, and null scores classify as HOLD.

    ``frozen`` (from ``composite_stats``) supplies the chosen features and
    every statistic instead of computing them from ``df`` (streams, or
    scoring new batches against an earlier fit).
    """
    if frozen is None:
        frozen = {}
        df = _apply_composite(df, feature_cols, weights, thresholds, strict, frozen)
        return df
    return _apply_composite(df, feature_cols, weights, thresholds, strict, dict(frozen))


def composite_stats(
    df: DataFrame,
    feature_cols: Sequence[str] | None = None,
    weights: dict[str, float] = COMPONENT_WEIGHTS,
    strict: bool = False,
) -> dict:
    """Fit the scoring statistics on ``df`` (with engagement columns)."""
    frozen: dict = {}
    _apply_composite(df, feature_cols, weights, Thresholds(), strict, frozen)
    return frozen  # filled while the plan was built


def _apply_composite(df, feature_cols, weights, thresholds, strict, frozen: dict) -> DataFrame:
    cols = list(feature_cols) if feature_cols is not None else feature_columns(df)
    if "top_features" not in frozen:
        frozen["top_features"] = top_features(df, cols)
    chosen = frozen["top_features"]
    if chosen:
        text = row_mean(chosen)
    else:
        text = F.lit(None).cast("double") if strict else F.lit(0.0)
    df = df.withColumn("text_component", text)
    if "components" not in frozen:
        frozen["components"] = collect_stats(
            df,
            t_mean=F.avg("text_component"),
            t_sd=F.stddev_samp("text_component"),
            e_mean=F.avg("engagement_signal"),
            e_sd=F.stddev_samp("engagement_signal"),
            v_mean=F.avg("viral_score_norm"),
            v_sd=F.stddev_samp("viral_score_norm"),
        )
    s = as_literals(frozen["components"])
    mode = "strict" if strict else "safe"
    composite = (
        F.lit(float(weights["text"])) * zscore(F.col("text_component"), s["t_mean"], s["t_sd"], mode)
        + F.lit(float(weights["engagement"]))
        * zscore(F.col("engagement_signal"), s["e_mean"], s["e_sd"], mode)
        + F.lit(float(weights["viral"])) * zscore(F.col("viral_score_norm"), s["v_mean"], s["v_sd"], mode)
    )
    df = df.withColumn("composite_signal", composite)
    if "composite" not in frozen:
        frozen["composite"] = collect_stats(
            df, c_mean=F.avg("composite_signal"), c_sd=F.stddev_samp("composite_signal")
        )
    c = as_literals(frozen["composite"])
    spread = F.lit(CONFIDENCE_SPREAD) * c["c_sd"]
    raw_conf = F.lit(1.0) - F.abs(F.col("composite_signal") - c["c_mean"]) / spread
    if strict:
        conf = clip01(F.lit(1.0) - F.try_divide(F.abs(F.col("composite_signal") - c["c_mean"]), F.when(spread != 0, spread)))
    else:
        conf = F.when(F.col("composite_signal").isNull(), F.lit(None).cast("double")).when(
            c["c_sd"] > 0, clip01(raw_conf)
        ).otherwise(F.lit(1.0))
    df = df.withColumn("signal_confidence", conf)
    return df.withColumn(
        "trading_signal", classify(F.col("composite_signal"), F.col("signal_confidence"), thresholds)
    )
