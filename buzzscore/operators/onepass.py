"""All scoring statistics from a single aggregation pass (tolerant path).

Every quantity the composite needs is linear in x = (features, retweets,
likes, replies): the engagement signal, the min-max viral norm, the text
component (mean of the top-variance features) and the composite itself.  So
one pass — means, the sample covariance matrix C of x and the viral min/max —
gives every mean and σ in closed form: var(aᵀx) = aᵀ C a.  Each task folds its rows into (count,
mean, centred co-moment matrix) with numpy (``mapInPandas``, pairwise
merges, numerically stable); groups of 64 tasks are merged again, and the
driver merges the rest, (k+3)² numbers each.  That replaces
four sequential passes over the table with one.  It assumes no nulls (true
after tolerant coercion and zero-filled features); the result plugs into the frozen-apply
path of ``add_engagement(stats=...)`` / ``add_composite(frozen=...)``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buzzscore.functions.pyhelpers import merge_moments, merge_partials, moment_partials
from buzzscore.operators.engagement import VIRAL_WEIGHTS
from buzzscore.operators.scoring import COMPONENT_WEIGHTS, TOP_FEATURES, feature_columns
from buzzscore.schema import METRICS

# A variance below this fraction of the magnitude of its terms is rounding
# noise of a quantity that is exactly constant.
RELATIVE_ZERO = 1e-12
#: Tasks whose moments are merged before they come to the driver.
MERGED_TASKS = 64


def _quad(a: np.ndarray, c: np.ndarray) -> float:
    value = float(a @ c @ a)
    scale = float(np.abs(a) @ np.abs(c) @ np.abs(a))
    return 0.0 if value <= RELATIVE_ZERO * scale else value


def fit_scoring_stats(
    df: DataFrame,
    feature_cols: Sequence[str] | None = None,
    weights: dict[str, float] = COMPONENT_WEIGHTS,
    viral_weights: dict[str, float] = VIRAL_WEIGHTS,
) -> tuple[dict, dict]:
    """Return ``(engagement_stats, composite_frozen)`` from one pass."""
    feats = list(feature_cols) if feature_cols is not None else feature_columns(df)
    cols = feats + list(METRICS)
    m = len(cols)
    narrow = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    weights_v = [float(viral_weights[name]) for name in METRICS]
    moments = "n long, mean array<double>, m2 array<double>, vmin double, vmax double"
    each = narrow.mapInPandas(moment_partials(m, weights_v), moments)  # one small row per task
    each = each.withColumn("part", F.spark_partition_id())
    # two levels: the driver merges one row per MERGED_TASKS tasks
    groups = each.groupBy(F.floor(F.col("part") / MERGED_TASKS).alias("g"))
    parts = groups.applyInPandas(merge_partials(m), moments).collect()
    n, mu, m2 = merge_moments([(p["n"], p["mean"], p["m2"]) for p in parts], m)
    cov = m2 / (n - 1) if n > 1 else np.zeros((m, m))
    row = {
        "vmin": min((p["vmin"] for p in parts), default=None),
        "vmax": max((p["vmax"] for p in parts), default=None),
    }
    k = len(feats)
    idx = {c: i for i, c in enumerate(cols)}

    # fitted scaler (population σ; σ = 0 -> scale 1)
    eng_stats: dict = {}
    a_e = np.zeros(m)
    for name in METRICS:
        i = idx[name]
        pop_var = cov[i, i] * (n - 1) / n if n > 1 else (0.0 if n == 1 else None)
        sd = math.sqrt(pop_var) if pop_var is not None else None
        eng_stats[f"{name}_mean"] = float(mu[i]) if n else None
        eng_stats[f"{name}_sd"] = sd
        a_e[i] = 1.0 / (3.0 * (sd if sd else 1.0))
    eng_stats["viral_min"] = row["vmin"]
    eng_stats["viral_max"] = row["vmax"]

    # viral norm
    a_v = np.zeros(m)
    for name, w in viral_weights.items():
        a_v[idx[name]] = float(w)
    vmin, vmax = row["vmin"], row["vmax"]
    if vmin is None or vmax == vmin:
        v_mean, v_var, a_vn = (0.5 if vmin is not None else None), 0.0, np.zeros(m)
    else:
        span = vmax - vmin
        a_vn = a_v / span
        v_mean = (float(a_v @ mu) - vmin) / span
        v_var = _quad(a_vn, cov)

    # top features by sample variance (ties: column order)
    ranked = sorted(range(k), key=lambda i: (-cov[i, i], i))
    chosen = [feats[i] for i in ranked[: min(TOP_FEATURES, k)]]
    a_t = np.zeros(m)
    for c in chosen:
        a_t[idx[c]] = 1.0 / len(chosen)
    t_mean = float(a_t @ mu) if chosen else 0.0
    t_var = _quad(a_t, cov) if chosen else 0.0
    e_var = _quad(a_e, cov)

    def sd_or_none(var):
        return math.sqrt(var) if n > 1 else None

    comps = {
        "t_mean": t_mean if n else None,
        "t_sd": sd_or_none(t_var),
        "e_mean": 0.0 if n else None,
        "e_sd": sd_or_none(e_var),
        "v_mean": v_mean if n else None,
        "v_sd": sd_or_none(v_var),
    }
    a_s = np.zeros(m)
    for a, w, var in ((a_t, weights["text"], t_var), (a_e, weights["engagement"], e_var), (a_vn, weights["viral"], v_var)):
        if var > 0 and n > 1:
            a_s += float(w) * a / math.sqrt(var)
    s_var = _quad(a_s, cov)
    frozen = {
        "top_features": chosen,
        "components": comps,
        "composite": {"c_mean": 0.0 if n else None, "c_sd": sd_or_none(s_var)},
    }
    return eng_stats, frozen
