"""End-to-end plans: cleaning, scoring, and both together.

Scale notes:
* cleaning is one Arrow-UDF projection plus one shuffle (the dedup);
* the cleaned posts and their terms are written once, as Parquet in the shared
  folder; vocabulary, Gram matrix and statistics read the columns they need;
* features, engagement, composite and label are one projection over that
  table: no join and no shuffle after the dedup.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from buzzscore.operators.clean import clean_posts, cleaning_stats
from buzzscore.operators.engagement import add_engagement, coerce_metrics
from buzzscore.operators.lsa import TextModel, feature_names
from buzzscore.operators.onepass import fit_scoring_stats
from buzzscore.operators.scoring import Thresholds, add_composite
from buzzscore.operators.tfidf import TfidfParams
from buzzscore.plans.text import add_text_features, fit_and_featurize
from buzzscore.schema import ESSENTIAL, fill_text_nulls
from buzzscore.sources.sinks import write_posts

@dataclass
class ScoringConfig:
    strict: bool = False
    tfidf: TfidfParams = field(default_factory=TfidfParams)
    fit_sample: int | None = None  # fit on every post, unless a sample is asked for
    seed: int = 42
    thresholds: Thresholds = field(default_factory=Thresholds)
    one_pass: bool = True  # tolerant path: all statistics from one aggregation


def run_cleaning(raw: DataFrame, output_path: str | None = None, fmt: str = "parquet"):
    """Clean raw posts; optionally write them.  Returns ``(clean, stats)``.

    When a path is given the statistics are computed from the written table,
    so the cleaning work is not repeated."""
    clean = clean_posts(raw)
    if output_path:
        write_posts(clean, output_path, fmt=fmt)
        reader = clean.sparkSession.read
        clean = reader.parquet(output_path) if fmt == "parquet" else clean
    return clean, cleaning_stats(raw, clean, output_file=output_path)


def run_scoring(
    posts: DataFrame, config: ScoringConfig | None = None, model: TextModel | None = None
) -> tuple[DataFrame, TextModel]:
    """Score cleaned posts.  Returns ``(scored posts, text model)``.

    Every row is scored by itself, so null or repeated ids are no problem.
    """
    config = config or ScoringConfig()
    if not config.strict:
        posts = fill_text_nulls(coerce_metrics(posts))
    if model is None:
        model, featured = fit_and_featurize(
            posts,
            config.tfidf,
            strict=config.strict,
            sample_size=None if config.strict else config.fit_sample,
            seed=config.seed,
        )
    else:
        featured = add_text_features(posts, model)
    names = feature_names(model.k)
    if config.one_pass and not config.strict:
        eng, frozen = fit_scoring_stats(featured, names)
        scored = add_composite(
            add_engagement(featured, stats=eng), names, thresholds=config.thresholds, frozen=frozen
        )
    else:
        scored = add_composite(
            add_engagement(featured, strict=config.strict),
            names,
            strict=config.strict,
            thresholds=config.thresholds,
        )
    return scored, model


def signals(scored: DataFrame) -> DataFrame:
    return scored.select("post_id", *ESSENTIAL)


def run_all(raw: DataFrame, config: ScoringConfig | None = None) -> tuple[DataFrame, TextModel]:
    """Raw posts -> cleaned -> scored (all columns)."""
    return run_scoring(clean_posts(raw), config or ScoringConfig())


__all__ = ["ScoringConfig", "run_cleaning", "run_scoring", "run_all", "signals"]
