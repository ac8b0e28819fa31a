"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame
over the supplied tables (whole tables, no row caps beyond the feature's own
limit).  Output doubles are rounded to 6 places and UTC timestamps are shown
as wall-clock ``timestamp_ntz`` so results compare across engines.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, TimestampType

from buzzscore.operators import clean as C
from buzzscore.operators.collect import collect_recent
from buzzscore.operators.day_sketches import day_sketches, distinct_error, over_ranges, rank_error
from buzzscore.operators.engagement import add_engagement, coerce_metrics
from buzzscore.operators.incremental_dedup import CleanPosts
from buzzscore.operators.lsa import feature_names, gram_matrix
from buzzscore.operators.onepass import fit_scoring_stats
from buzzscore.operators.sampling import exact_sample
from buzzscore.operators.tfidf import (
    TfidfParams,
    fit_vocabulary,
    row_vectors,
    token_terms,
    with_terms,
    with_tokens,
)
from buzzscore.operators.time_joins import asof_join, interval_join, sessions
from buzzscore.operators.top_terms import fit_vocabulary_by_summary
from buzzscore.operators.reports import (
    histogram,
    hourly_trend,
    pie_shares,
    scatter_sample,
    signal_cube,
    signal_distribution,
    summary,
)
from buzzscore.operators.scoring import TOP_FEATURES, add_composite, feature_columns, rank_features
from buzzscore.plans.pipeline import ScoringConfig, run_all, signals
from buzzscore.plans.text import fit_and_featurize
from buzzscore.sources.sinks import essential, write_posts, write_signals
from buzzscore.schema import METRICS, RAW_POST, cast_losses, conform, fill_text_nulls
from buzzscore.session import prepare, scratch_path, written
from buzzscore.sources.posts import documents_as_posts, posts_from_testdata, read_posts, tagged_events
from buzzscore.sources.split_csv import read_split_csv
from buzzscore.sources.type_inference import account, decide, merge
from buzzscore.sources.variant_props import fit_account, key_kinds, shred
from buzzscore.streaming.session_stream import run_sessions, stitch

ROUND = 6


def finalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DoubleType):
            c = F.round(c, ROUND) + F.lit(0.0)  # + 0.0 turns -0.0 into 0.0
        elif isinstance(f.dataType, TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _raw(spark: SparkSession, sf_dir: str, day_grain: bool = True) -> DataFrame:
    prepare(spark)
    return posts_from_testdata(spark, sf_dir, day_grain=day_grain)


def _clean(spark: SparkSession, sf_dir: str, day_grain: bool = True) -> DataFrame:
    return C.clean_posts(_raw(spark, sf_dir, day_grain))


# --- cleaning -----------------------------------------------------------------


def q_clean_stats(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return finalize(C.flat_stats(C.cleaning_stats(raw, C.clean_posts(raw))))


def q_clean_posts(spark, sf_dir):
    return finalize(_clean(spark, sf_dir))


def q_dedup_posts(spark, sf_dir):
    normed = C.normalize_posts(_raw(spark, sf_dir)).filter(F.col("timestamp").isNotNull())
    return finalize(C.dedup_posts(normed).select("post_id", "timestamp", "content"))


#: Batches that the posts arrive in, by ranges of their ids.
ARRIVALS = 4


def q_dedup_incremental(spark, sf_dir):
    """The posts in batches as they arrive, each cleaned and compared with the
    clean posts before it; equal posts are far apart, so most meet across batches."""
    raw = _raw(spark, sf_dir)
    first, last = raw.agg(F.min("post_id"), F.max("post_id")).first()
    home = scratch_path(spark, f"clean-posts-{uuid.uuid4().hex}")
    schema = C.normalize_posts(raw).select("post_id", "timestamp", "content").schema
    clean = CleanPosts(spark, home, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields), partitions=16)
    step = ((last or 0) - (first or 0)) // ARRIVALS + 1
    for k in range(ARRIVALS):
        begin = (first or 0) + k * step
        arrived = raw.where((F.col("post_id") >= begin) & (F.col("post_id") < begin + step))
        normed = C.normalize_posts(arrived).where(F.col("timestamp").isNotNull())
        clean.add(k, normed.select("post_id", "timestamp", "content"))
    return finalize(clean.posts(ARRIVALS))


def q_newest_posts(spark, sf_dir):
    return finalize(C.preview(_clean(spark, sf_dir)))


# --- conform / collection / engagement ------------------------------------------

TAGS_WANTED = ("click", "purchase", "signup", "view")


def q_conform_defaults(spark, sf_dir):
    prepare(spark)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    partial = d.select(
        F.col("doc_id").alias("post_id"),
        F.col("text").alias("content"),
        F.col("lang").alias("user"),
        F.concat(F.lit("2024-01-"), F.lpad(((F.col("doc_id") % 28) + 1).cast("string"), 2, "0")).alias(
            "date"
        ),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("n_chars").cast("string"), F.lit("f")))
        .otherwise(F.col("n_chars").cast("string"))
        .alias("retweets"),
    )
    out = fill_text_nulls(conform(partial, RAW_POST, coerce_metrics=True, default_signal=True))
    return finalize(out)


def _collect(spark, sf_dir, as_of):
    prepare(spark)
    posts = tagged_events(spark, sf_dir)
    return finalize(collect_recent(posts, TAGS_WANTED, as_of=as_of))


def q_collect_recent(spark, sf_dir):
    """as_of 2024-01-02: about 2,000 posts per tag qualify, the cap of 501 bites."""
    return _collect(spark, sf_dir, dt.date(2024, 1, 2))


def q_collect_recent_window(spark, sf_dir):
    """as_of 2024-01-29: a couple of hundred posts per tag, the cap is idle."""
    return _collect(spark, sf_dir, dt.date(2024, 1, 29))


def _metrics(clean):
    """Ids and metrics, written once: the statistics and the scores read them, and posts are not cleaned twice."""
    return written(clean.select("post_id", *METRICS), "metrics")


def q_engagement_signal(spark, sf_dir):
    df = add_engagement(_metrics(_clean(spark, sf_dir)))
    return finalize(df.select("post_id", "engagement_signal"))


def q_viral_norm(spark, sf_dir):
    df = add_engagement(_metrics(_clean(spark, sf_dir)))
    return finalize(df.select("post_id", "viral_score", "viral_score_norm"))


# --- text features ----------------------------------------------------------------


def _docs(spark, sf_dir):
    prepare(spark)
    return documents_as_posts(spark, sf_dir)


def _vocab(spark, sf_dir, params=None):
    """The documents' terms that are in the vocabulary, and the vocabulary; their tokens are written once."""
    params = params or TfidfParams()
    rows = written(with_tokens(_docs(spark, sf_dir), params).drop("content"), "tokens")
    vocab = fit_vocabulary(rows, rows.count(), params)
    return token_terms(rows, params, only=vocab.table["term"].tolist()), vocab


def q_vocabulary(spark, sf_dir):
    _, vocab = _vocab(spark, sf_dir)
    return vocab.to_spark(spark).select("term", "term_id", "df", "cf")


def q_vocabulary_by_summary(spark, sf_dir):
    """The vocabulary from frequent-items summaries, exact counts for candidates only."""
    params = TfidfParams()
    rows = written(with_terms(_docs(spark, sf_dir), params).drop("content"), "terms")
    vocab, _ = fit_vocabulary_by_summary(rows, rows.count(), params)
    return vocab.to_spark(spark).select("term", "term_id", "df", "cf")


def q_idf_table(spark, sf_dir):
    _, vocab = _vocab(spark, sf_dir)
    return finalize(vocab.to_spark(spark).select("term", "idf"))


def q_tfidf_weights(spark, sf_dir):
    rows, vocab = _vocab(spark, sf_dir)
    vectors = row_vectors(rows, vocab).select("post_id", F.arrays_zip("term_ids", "weights").alias("e"))
    cells = vectors.select("post_id", F.explode("e").alias("e")).select(
        F.col("post_id").alias("doc_id"), F.col("e.term_ids").alias("term_id"), F.col("e.weights").alias("weight")
    )
    names = F.broadcast(vocab.to_spark(spark).select("term_id", "term"))  # at most max_features rows
    return finalize(cells.join(names, "term_id").select("doc_id", "term", "weight"))


def q_tfidf_gram(spark, sf_dir):
    rows, vocab = _vocab(spark, sf_dir)
    g = gram_matrix(row_vectors(rows, vocab), vocab.size, vocab.n_docs)
    return finalize(
        g.select(
            F.col("i").alias("term_id_i"), F.col("j").alias("term_id_j"), F.col("g").alias("gram")
        )
    )


def q_text_features(spark, sf_dir):
    model, feats = fit_and_featurize(_docs(spark, sf_dir))
    return finalize(
        feats.select(F.col("post_id").alias("doc_id"), *feature_names(model.k))
    )


# --- scoring and reports on fixed numeric features --------------------------------

# Fixed feature fixture: eight doubles per post from integer arithmetic on
# doc_id, n_chars and length(source); (a, b, c, scale) per feature, value =
# ((a*doc_id + b*n_chars + c*length(source)) % 100) * scale.
FEATURE_FIXTURE = (
    (7, 1, 0, 0.3),
    (11, 3, 1, 0.8),
    (13, 0, 5, 0.1),
    (17, 7, 0, 0.6),
    (19, 1, 3, 0.5),
    (23, 9, 0, 0.2),
    (29, 0, 1, 0.7),
    (31, 5, 2, 0.4),
)


def fixture_features(posts, documents):
    d = documents.select("doc_id", "n_chars", "source")
    j = posts.join(d, posts.post_id == d.doc_id).drop("doc_id")
    cols = {}
    for i, (a, b, c, scale) in enumerate(FEATURE_FIXTURE, start=1):
        raw = (F.col("post_id") * a + F.col("n_chars") * b + F.length("source") * c) % 100
        cols[f"text_feature_{i}"] = raw.cast("double") * F.lit(scale)
    return j.withColumns(cols).drop("n_chars", "source")


def scored_fixture(spark, sf_dir, day_grain=True):
    posts = _clean(spark, sf_dir, day_grain)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # The statistics pass and the result read this table, each its columns.
    featured = written(fixture_features(posts, docs), "featured")
    names = feature_columns(featured)
    eng, frozen = fit_scoring_stats(coerce_metrics(featured), names)
    return add_composite(add_engagement(featured, stats=eng), names, frozen=frozen)


def q_top_features(spark, sf_dir):
    posts = _clean(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    feats = fixture_features(posts, docs)
    ranked = rank_features(feats, feature_columns(feats))[:TOP_FEATURES]
    rows = [(name, float(var), rank) for rank, (name, var) in enumerate(ranked, start=1)]
    return finalize(spark.createDataFrame(rows, "feature string, variance double, rank int"))


def q_composite_scores(spark, sf_dir):
    df = scored_fixture(spark, sf_dir)
    return finalize(
        df.select("post_id", "text_component", "composite_signal", "signal_confidence")
    )


def q_signals(spark, sf_dir):
    return finalize(essential(scored_fixture(spark, sf_dir)))


def q_signal_distribution(spark, sf_dir):
    return finalize(signal_distribution(scored_fixture(spark, sf_dir)))


def q_summary_report(spark, sf_dir):
    return finalize(summary(scored_fixture(spark, sf_dir)))


def q_hourly_trend(spark, sf_dir):
    return finalize(hourly_trend(scored_fixture(spark, sf_dir, day_grain=False)))


def q_signal_histogram(spark, sf_dir):
    return finalize(histogram(scored_fixture(spark, sf_dir)))


def q_scatter_sample(spark, sf_dir):
    return finalize(scatter_sample(scored_fixture(spark, sf_dir, day_grain=False)))


def q_pie_sample(spark, sf_dir):
    return finalize(pie_shares(scored_fixture(spark, sf_dir, day_grain=False)))


def q_full_pipeline(spark, sf_dir):
    """Raw posts -> clean -> TF-IDF/SVD features -> engagement -> composite -> signals."""
    raw = _raw(spark, sf_dir)
    scored, _ = run_all(raw, ScoringConfig())
    return finalize(signals(scored))


# --- sources and sinks ------------------------------------------------------------


def q_csv_roundtrip(spark, sf_dir):
    """Raw posts written as CSV (quoted, multi-line fields) into the shared
    checkpoint folder, read back with the declared schema, then cleaned."""
    raw = _raw(spark, sf_dir)
    path = scratch_path(spark, f"csv-roundtrip-{uuid.uuid4().hex}")
    write_posts(raw, path, fmt="csv")
    return finalize(C.clean_posts(read_posts(spark, path, fmt="csv", schema=RAW_POST)))


def q_csv_split(spark, sf_dir):
    """Every field quoted, so that all line breaks of the texts are inside
    quotes, read back in splits that begin anywhere, then cleaned."""
    path = scratch_path(spark, f"csv-split-{uuid.uuid4().hex}")
    _raw(spark, sf_dir).write.options(header=True, quoteAll=True, escape='"').csv(path)
    return finalize(C.clean_posts(read_posts(spark, path, fmt="csv", schema=RAW_POST)))


def _through_csv(spark, df, name: str, schema=None):
    """``df`` written as CSV into the shared folder and read back by its header."""
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    write_posts(df, path, fmt="csv")
    return read_posts(spark, path, fmt="csv", schema=schema)


def q_csv_reordered(spark, sf_dir):
    """Columns in another order than the schema's."""
    raw = _raw(spark, sf_dir)
    back = _through_csv(spark, raw.select(*reversed(raw.columns)), "csv-reordered", RAW_POST)
    return finalize(C.clean_posts(back))


def q_csv_without_id(spark, sf_dir):
    """No ``post_id``: ids come from the rows.  Which of several equal posts is
    kept shows in none of these columns."""
    back = _through_csv(spark, _raw(spark, sf_dir).drop("post_id"), "csv-without-id")
    return finalize(C.clean_posts(back).select("timestamp", "content", "content_length"))


def q_csv_collector(spark, sf_dir):
    """The collector's layout: ``date, user, content``."""
    raw = _raw(spark, sf_dir)
    got = raw.select(F.col("timestamp").alias("date"), F.col("username").alias("user"), "content")
    back = fill_text_nulls(_through_csv(spark, got, "csv-collector"))
    return finalize(C.normalize_posts(back).select("username", "timestamp", "content", "retweets", "hashtags"))


def q_csv_float_metrics(spark, sf_dir):
    """Metrics written as ``5.5``: read as they are, never cut to integers."""
    raw = _raw(spark, sf_dir).select(
        "post_id", "timestamp", (F.col("retweets") + 0.5).alias("retweets"), F.col("likes").cast("double").alias("likes"), "replies"
    )
    back = _through_csv(spark, raw, "csv-float")
    return finalize(back.select("post_id", "retweets", "likes", "replies"))


def q_parquet_roundtrip(spark, sf_dir):
    path = scratch_path(spark, f"clean-{uuid.uuid4().hex}")
    write_posts(_clean(spark, sf_dir), path, partition_by_day=True)
    return finalize(spark.read.parquet(path).drop("day"))


def q_signals_csv(spark, sf_dir):
    """The nine exported columns, written as CSV and read back."""
    path = scratch_path(spark, f"signals-{uuid.uuid4().hex}")
    scored = scored_fixture(spark, sf_dir)
    write_signals(scored, path)
    schema = essential(scored).schema
    options = {"header": True, "multiLine": True, "escape": '"', "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX"}
    return finalize(spark.read.options(**options).schema(schema).csv(path))


def _with_nan(spark, sf_dir):
    clean = _clean(spark, sf_dir)
    nan = F.when(F.col("post_id") % 7 == 3, F.lit(float("nan"))).otherwise(F.col("retweets").cast("double"))
    return _metrics(clean.withColumn("retweets", nan))


def q_engagement_nan(spark, sf_dir):
    """A NaN metric counts as 0, and no score becomes NaN."""
    df = add_engagement(_with_nan(spark, sf_dir))
    return finalize(df.select("post_id", "engagement_signal", "viral_score"))


def q_engagement_nan_strict(spark, sf_dir):
    """Strict: a NaN is left out of the fits and gives no score."""
    df = add_engagement(_with_nan(spark, sf_dir), strict=True)
    return finalize(df.select("post_id", "engagement_signal", "viral_score"))


def q_svd_isometry(spark, sf_dir):
    """With as many components as terms the projection is a rotation: norms, and
    products of neighbouring posts, are those of the TF-IDF rows."""
    _, feats = fit_and_featurize(_docs(spark, sf_dir), TfidfParams(max_features=20))
    names = [c for c in feats.columns if c.startswith("text_feature_")]
    f = feats.select("post_id", F.array(*names).alias("f"))
    g = feats.select((F.col("post_id") + 1).alias("post_id"), F.array(*names).alias("g"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return finalize(
        f.join(g, "post_id", "left").select(
            F.col("post_id").alias("doc_id"), dot("f", "f").alias("norm2"), F.coalesce(dot("f", "g"), F.lit(0.0)).alias("with_previous")
        )
    )


def q_svd_randomized(spark, sf_dir):
    """The randomized solver on up to 20,000 terms: components are orthonormal,
    features uncorrelated with their singular values as norms; the posts' norms add up to ``total``."""
    model, feats = fit_and_featurize(_docs(spark, sf_dir), TfidfParams(max_features=20_000))
    names = feature_names(model.k)
    pairs = [(i, j) for i in range(model.k) for j in range(i, model.k)]
    sigma = model.singular_values
    products = feats.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs])
    inner = model.components.T @ model.components
    per_pair = [
        F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(inner[i, j])).alias("orthonormal"),
            (F.col(f"p{i}_{j}") / F.lit(float(sigma[i] * sigma[j]))).alias("uncorrelated"),
        )
        for i, j in pairs
    ]
    rows = products.select(F.explode(F.array(*per_pair)).alias("c")).select("c.*")
    # all posts' squared norms: each post with a term has 1; the components have a part of that
    vectors = row_vectors(with_terms(_docs(spark, sf_dir), model.params, only=model.vocab.table["term"].tolist()).select("terms"), model.vocab)
    total = vectors.agg(F.sum(F.aggregate("weights", F.lit(0.0), lambda a, w: a + w * w))).first()[0]
    captured = float((sigma**2).sum())
    return finalize(rows.withColumns({"total": F.lit(total), "captured": F.lit(0 < captured < total)}))


def q_signals_strict(spark, sf_dir):
    """The strict path (nulls propagate, σ = 0 -> null -> HOLD) on the same
    posts; with no degenerate statistics here it must equal ``signals``."""
    posts = _clean(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    featured = written(fixture_features(posts, docs), "featured")
    scored = add_composite(add_engagement(featured, strict=True), strict=True)
    return finalize(essential(scored))


# --- types, losses, a model fitted on a sample -----------------------------------------


def q_inferred_types(spark, sf_dir):
    """Types of two CSV sources' columns, each from its own account of all values, merged:
    posts, and events under the posts' names (``value`` as retweets, their own times)."""
    posts = _raw(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("post_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.when(F.col("event_id") % 2 == 0, F.col("value").cast("decimal(20,2)").cast("string")).alias("retweets"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        (F.col("event_type") == "purchase").alias("paid"),
        F.col("user_id").alias("hashtags"),
    )
    accounts = []
    for name, df in (("posts", posts.drop("content")), ("events", events)):
        path = scratch_path(spark, f"types-{name}-{uuid.uuid4().hex}")
        write_posts(df, path, fmt="csv")
        accounts.append(account(read_split_csv(spark, path)))
    # spaces around a value in a quoted field belong to it, but not to its kind
    return decide(merge(*accounts))


def q_cast_losses(spark, sf_dir):
    """What the storage schema would lose of text metrics: fractions, words, numbers beyond 64 bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = docs.select(
        F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("id"), F.col("doc_id").cast("string")))
        .otherwise(F.col("doc_id").cast("string")).alias("post_id"),
        F.lit("2024-01-01").alias("timestamp"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("n_chars").cast("string"), F.lit(".5")))
        .otherwise(F.col("n_chars").cast("string")).alias("retweets"),
        F.when(F.col("n_chars") > 1000, F.lit("99999999999999999999")).when(F.col("doc_id") % 2 == 0, "7").alias("likes"),
        F.lit("12").alias("replies"),
    )
    return cast_losses(raw)


def q_vocabulary_on_sample(spark, sf_dir):
    """A model's terms and idf when it is fitted on half of the posts, and the posts of the rest weighed with them."""
    docs, params = _docs(spark, sf_dir), TfidfParams()
    n = docs.count() // 2
    vocab = fit_vocabulary(with_tokens(exact_sample(docs, n), params), n, params)
    known = with_terms(docs, params, only=vocab.table["term"].tolist()).drop("content")
    vectors = row_vectors(known, vocab)
    total = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w)
    return finalize(vectors.select(F.col("post_id").alias("doc_id"), F.size("weights").alias("n_terms"), total.alias("weight")))


# --- metrics and tags out of JSON -------------------------------------------------------

PROPS = {"k": ("$.k", "bigint"), "likes": ("$.m.likes", "bigint"), "score": ("$.score", "double"), "tags": ("$.tags", "array<string>")}


def _props(spark, sf_dir):
    """``events`` with its ``props`` in seven states: as they are, as text, nested, misfit, cut off, with JSON nulls, null."""
    prepare(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    state = F.pmod("event_id", F.lit(7))
    k = F.regexp_extract("props", "([0-9]+)", 1)
    texts = [
        F.col("props"),
        F.concat(F.lit('{"k": "'), k, F.lit('", "tags": ["a", "'), "event_type", F.lit('"]}')),
        F.concat(F.lit('{"m": {"likes": '), k, F.lit('}, "score": '), k, F.lit(".5}")),
        F.concat(F.lit('{"k": "n/a", "m": {"likes": "'), "event_type", F.lit('"}, "score": "x", "tags": []}')),
        F.concat(F.lit('{"k": '), k),
        F.lit('{"k": null, "m": null, "score": 7}'),
    ]
    made = F.when(state == 0, texts[0])
    for i, text in enumerate(texts[1:], 1):
        made = made.when(state == i, text)
    return events.select("event_id", made.alias("props"))


def q_props_shredded(spark, sf_dir):
    """Typed columns of the props, stored as Parquet and read back."""
    table = written(shred(_props(spark, sf_dir), "props", PROPS).drop("props"), "props")
    return finalize(
        table.select("event_id", "k", "likes", "score", F.array_join("tags", ",").alias("tags"), "malformed", F.array_join("misfits", ",").alias("misfits"))
    )


def q_props_account(spark, sf_dir):
    return fit_account(shred(_props(spark, sf_dir), "props", PROPS), PROPS)


def q_props_kinds(spark, sf_dir):
    return key_kinds(_props(spark, sf_dir), "props")


# --- time ------------------------------------------------------------------------------

#: A user's session ends with a pause longer than this.
SESSION_GAP = 6 * 3600


def _events(spark, sf_dir):
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _post_times(spark, sf_dir):
    """Posts with their user, at the full minute of their time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("event_id"))
    at = F.date_trunc("minute", "ts").alias("posted")
    return docs.join(_events(spark, sf_dir), "event_id").select(F.col("event_id").alias("post_id"), "user_id", at)


def q_sessions(spark, sf_dir):
    return finalize(sessions(_events(spark, sf_dir), ["user_id"], "ts", SESSION_GAP))


#: Parts in which ``events`` arrives, by time.
ARRIVALS = 4


def q_sessions_stream(spark, sf_dir):
    """The sessions of a stream: ``events`` arrives in parts by time, each a micro-batch, then a row that closes the last slices."""
    events = _events(spark, sf_dir).select("user_id", "ts").where("ts IS NOT NULL").withColumn("_closes", F.lit(False))
    first, last = events.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    if first is None:
        return finalize(sessions(events, ["user_id"], "ts", SESSION_GAP))
    home = scratch_path(spark, f"sessions-stream-{uuid.uuid4().hex}")
    source, width = f"{home}/arrivals", (last - first) // ARRIVALS // 1_000_000 + 1
    at = lambda i: F.timestamp_micros(F.lit(first + i * width * 1_000_000))
    for i in range(ARRIVALS):
        part = events.where((F.col("ts") >= at(i)) & (F.col("ts") < at(i + 1)))
        part.write.mode("append").parquet(source)
    files = len(spark.read.parquet(source).inputFiles())
    # after all slices and the time in which rows may still come
    end = F.timestamp_micros(F.lit(last + (width + 17 * SESSION_GAP) * 1_000_000))
    closing = spark.range(1).select(F.lit(None).cast(events.schema["user_id"].dataType).alias("user_id"), end.alias("ts"), F.lit(True).alias("_closes"))
    closing.write.mode("append").parquet(source)
    # a part may be several files, read in any order: rows may come late by a part
    run_sessions(
        spark, source, home, events.schema, ["user_id"], "ts", SESSION_GAP, lateness_seconds=width, files_per_batch=-(-files // ARRIVALS)
    )
    return finalize(stitch(spark.read.parquet(f"{home}/partials"), ["user_id"], SESSION_GAP))


def q_asof_event(spark, sf_dir):
    """Each post with the latest earlier event of its user, and the latest within a day."""
    events = _events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type")
    posts = _post_times(spark, sf_dir)
    out = asof_join(posts, events, ["user_id"], "posted", "ts", ["event_id"], strictly=True)
    return finalize(
        out.select(
            "post_id", "user_id", "posted", F.col("match.event_id").alias("event_id"), F.col("match.ts").alias("ts"),
            F.col("match.event_type").alias("event_type"),
        )
    )


def q_posts_in_sessions(spark, sf_dir):
    """Posts with the sessions of their user that they fall into; users with most events are active nearly always."""
    spans = sessions(_events(spark, sf_dir), ["user_id"], "ts", SESSION_GAP)
    return finalize(interval_join(_post_times(spark, sf_dir), spans, "posted", "session_start", "session_end", by=["user_id"], bin_seconds=3600))


def q_signal_cube(spark, sf_dir):
    return finalize(signal_cube(scored_fixture(spark, sf_dir, day_grain=False)))


def q_week_sketches(spark, sf_dir):
    """Users and median value of every seven days, merged from a stored row a day, and whether
    each is within its error of the exact one (which the query counts beside it)."""
    events = _events(spark, sf_dir)
    daily = written(day_sketches(events, "ts", "user_id", "value"), "day-sketches")
    week = lambda day: F.struct(F.date_sub(day, 6).alias("first_day"), day.alias("last_day"))
    estimates = over_ranges(daily, daily.where("day IS NOT NULL").select(week(F.col("day")).alias("w")).select("w.*"))
    # exact: each day's users and values, combined, stand in the seven weeks that hold the day
    ends = daily.select(F.col("day").alias("last_day"))
    in_weeks = lambda df: df.withColumn("last_day", F.explode(F.expr("sequence(day, date_add(day, 6))"))).join(ends, "last_day")
    day = F.to_date("ts").alias("day")
    users = in_weeks(events.select(day, "user_id").distinct()).groupBy("last_day").agg(F.count_distinct("user_id").alias("users"))
    values = in_weeks(events.groupBy(day, "value").agg(F.count("value").alias("c")))
    q, c = F.col("quantiles")[0], F.col("c")
    ranks = values.join(estimates.select("last_day", "quantiles"), "last_day").groupBy("last_day").agg(
        (F.sum(F.when(F.col("value") < q, c).otherwise(0)) / F.sum(c)).alias("below"),
        (F.sum(F.when(F.col("value") <= q, c).otherwise(0)) / F.sum(c)).alias("upto"),
    )
    off = F.abs(F.col("distinct") - F.col("users"))
    return estimates.join(users, "last_day").join(ranks, "last_day").select(
        "first_day", "last_day", F.col("n").alias("posts"), "users",
        (off <= F.greatest(F.lit(1.0), 4 * distinct_error() * F.col("users"))).alias("users_within"),
        F.lit(0.5).between(F.col("below") - 2 * rank_error(), F.col("upto") + 2 * rank_error()).alias("median_within"),
    )
