"""Plan shape: what shuffles, what is broadcast, and partition independence."""

from pyspark.sql import functions as F

from buzzscore.operators.clean import clean_posts
from buzzscore.operators.collect import collect_recent
from buzzscore.plans import queries as Q
from buzzscore.sources.posts import posts_from_testdata, tagged_events


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_limits_rows_before_the_shuffle(spark):
    plan = _plan(clean_posts(posts_from_testdata(spark, Q_SF)))
    assert plan.count("WindowGroupLimit") >= 2  # partial (map side) + final


def test_collect_cap_is_a_group_limit_and_time_bound_is_pushed(spark):
    import datetime as dt

    df = collect_recent(tagged_events(spark, Q_SF), ["click"], as_of=dt.date(2024, 1, 2))
    plan = _plan(df)
    assert "WindowGroupLimit" in plan
    assert "GreaterThanOrEqual(ts," in plan  # the time bound reaches the Parquet scan


def test_scoring_plan_has_no_single_partition_exchange_over_rows(spark):
    df = Q.scored_fixture(spark, Q_SF)
    plan = _plan(df.select("post_id", "trading_signal"))
    assert "SinglePartition" not in plan  # statistics arrive as constants


def test_signals_partition_independent(spark):
    from buzzscore.operators.engagement import add_engagement
    from buzzscore.operators.scoring import add_composite

    posts = Q.fixture_features(clean_posts(posts_from_testdata(spark, Q_SF)), spark.read.parquet(f"{Q_SF}/documents.parquet"))
    posts = posts.checkpoint(eager=True)
    a = add_composite(add_engagement(posts)).select("post_id", "trading_signal", F.round("composite_signal", 9).alias("s"))
    b = add_composite(add_engagement(posts.repartition(17, "post_id"))).select("post_id", "trading_signal", F.round("composite_signal", 9).alias("s"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


Q_SF = "/root/testdata/sf0.001"
