"""Layouts, numbers and identities of input: headers, metrics, NaN, ids."""

import pytest
from pyspark.sql import functions as F

from buzzscore.operators.clean import clean_posts
from buzzscore.operators.engagement import add_engagement
from buzzscore.operators.scoring import classify
from buzzscore.operators.tfidf import TfidfParams
from buzzscore.plans.pipeline import ScoringConfig, run_scoring
from buzzscore.schema import RAW_POST, TEXT_POST, conform
from buzzscore.sources.posts import deal_out, posts_from_testdata, read_posts

SF = "/root/testdata/sf0.001"


def _csv(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text)
    return str(path)


def test_csv_goes_by_the_header(spark, tmp_path):
    path = _csv(tmp_path, "username,timestamp,content,likes\nann,2025-09-01 10:00:00,hello world,6.5\nbob,2025-09-02,hi,5.0\n")
    rows = read_posts(spark, path).orderBy("username").collect()
    assert [(r.username, r.timestamp, r.content, r.likes, r.retweets) for r in rows] == [
        ("ann", "2025-09-01 10:00:00", "hello world", 6.5, 0.0),
        ("bob", "2025-09-02", "hi", 5.0, 0.0),
    ]
    assert clean_posts(read_posts(spark, path)).count() == 2
    with pytest.raises(ValueError):
        read_posts(spark, _csv(tmp_path, "a,b\n1,2\n"))


def test_one_row_group_in_several_splits_is_dealt_out(spark, tmp_path):
    """All rows of a row group belong to one split, however many splits its file gives."""
    path = str(tmp_path / "one.parquet")
    spark.range(20_000).selectExpr("id", "repeat(uuid(), 20) AS text").coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        df = spark.read.parquet(path)
        filled = lambda d: d.select(F.spark_partition_id().alias("p")).distinct().count()
        assert df.rdd.getNumPartitions() > 1 and filled(df) == 1
        assert filled(deal_out(df)) >= spark.sparkContext.defaultParallelism
        many = spark.read.parquet(path).repartition(50)
        assert deal_out(many) is many
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("value, as_long, as_double", [("12.7", None, 12.7), ("1e30", None, 1e30), ("12", 12, 12.0), ("12.5f", None, None), ("NaN", None, None)])
def test_metrics_are_never_cut(spark, value, as_long, as_double):
    df = spark.createDataFrame([("2025-01-01", value)], "timestamp string, likes string")
    assert conform(df, RAW_POST).first().likes == as_long
    assert conform(df, TEXT_POST).first().likes == as_double
    assert conform(df, RAW_POST, coerce_metrics=True).first().likes == (as_long or 0)
    assert conform(df, TEXT_POST, coerce_metrics=True).first().likes == (as_double or 0.0)


def test_missing_ids_do_not_depend_on_the_split(spark):
    raw = posts_from_testdata(spark, SF).drop("post_id")
    one = clean_posts(conform(raw)).select("post_id", "content", "likes")
    two = clean_posts(conform(raw.repartition(11).orderBy(F.rand(3)))).select("post_id", "content", "likes")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_nan_is_missing(spark):
    nan = float("nan")
    rows = [(i, 1.0 + i, 2.0 * i, 3.0) for i in range(19)] + [(19, nan, 4.0, 1.0)]
    df = spark.createDataFrame(rows, "post_id long, retweets double, likes double, replies double")
    tolerant = add_engagement(df).collect()
    assert all(r.engagement_signal == r.engagement_signal for r in tolerant)
    strict = {r.post_id: r for r in add_engagement(df, strict=True).collect()}
    assert strict[19].engagement_signal is None and strict[0].engagement_signal is not None
    scores = spark.createDataFrame([(nan, 0.9), (0.9, nan), (None, 0.9), (0.9, 0.9)], "s double, c double")
    assert [r[0] for r in scores.select(classify(F.col("s"), F.col("c"))).collect()] == ["HOLD", "HOLD", "HOLD", "STRONG_BUY"]


@pytest.mark.parametrize("post_id", ["CAST(NULL AS bigint)", "post_id div 2"])
def test_scoring_keeps_rows_whatever_their_ids(spark, post_id):
    posts = clean_posts(posts_from_testdata(spark, SF))
    want, model = run_scoring(posts, ScoringConfig(tfidf=TfidfParams(max_features=50)))
    got, _ = run_scoring(posts.withColumn("post_id", F.expr(post_id)), ScoringConfig(), model=model)
    key = lambda df: sorted((r.content, str(r.timestamp), round(r.composite_signal, 9)) for r in df.collect())
    assert key(got) == key(want)


def test_scoring_moves_no_text_after_the_dedup(spark):
    scored, _ = run_scoring(clean_posts(posts_from_testdata(spark, SF)))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
