"""One-pass closed-form statistics equal the direct multi-pass ones."""

import pytest
from pyspark.sql import functions as F

from buzzscore.operators.engagement import add_engagement, engagement_stats
from buzzscore.operators.onepass import fit_scoring_stats
from buzzscore.operators.scoring import add_composite, composite_stats
from buzzscore.plans import queries as Q


@pytest.fixture(scope="module")
def featured(spark):
    from buzzscore.operators.clean import clean_posts
    from buzzscore.sources.posts import posts_from_testdata

    sf = "/root/testdata/sf0.001"
    posts = clean_posts(posts_from_testdata(spark, sf))
    return Q.fixture_features(posts, spark.read.parquet(f"{sf}/documents.parquet")).checkpoint(eager=True)


def test_closed_form_matches_direct(spark, featured):
    eng_direct = engagement_stats(featured)
    frozen_direct = composite_stats(add_engagement(featured, stats=eng_direct))
    eng_fast, frozen_fast = fit_scoring_stats(featured)
    for key, value in eng_direct.items():
        assert eng_fast[key] == pytest.approx(value, rel=1e-9, abs=1e-12), key
    assert frozen_fast["top_features"] == frozen_direct["top_features"]
    for part in ("components", "composite"):
        for key, value in frozen_direct[part].items():
            assert frozen_fast[part][key] == pytest.approx(value, rel=1e-9, abs=1e-9), (part, key)
    direct = add_composite(add_engagement(featured, stats=eng_direct), frozen=frozen_direct)
    fast = add_composite(add_engagement(featured, stats=eng_fast), frozen=frozen_fast)
    a = {r.post_id: (r.trading_signal, r.composite_signal) for r in direct.collect()}
    b = {r.post_id: (r.trading_signal, r.composite_signal) for r in fast.collect()}
    assert a.keys() == b.keys()
    for pid in a:
        assert a[pid][0] == b[pid][0]
        assert a[pid][1] == pytest.approx(b[pid][1], abs=1e-9)


def test_closed_form_constant_inputs(spark):
    df = spark.createDataFrame([(i, 1, 2, 3, 0.0) for i in range(5)], "post_id long, retweets long, likes long, replies long, text_feature_1 double")
    eng, frozen = fit_scoring_stats(df)
    assert frozen["components"]["e_sd"] == 0.0 and frozen["components"]["t_sd"] == 0.0
    out = add_composite(add_engagement(df, stats=eng), frozen=frozen).collect()
    assert all(r.composite_signal == 0.0 and r.signal_confidence == 1.0 for r in out)
