"""TF-IDF over post text, expressed as DataFrame operations.

Per document, in the row (no shuffle): lowercase + accent fold, tokenise, then
drop stop words, add bigrams and count each term in a small Arrow function.

Fit: a task adds up its documents' terms, at most some ``HELD_TERMS`` at a time;
one ``groupBy(term)`` over that gives document frequency and corpus count (of many
posts only for terms that may be kept, see ``frequent_term_stats``);
pruning and the ``max_features`` cut run on that
table, and only the kept vocabulary (at most ``max_features`` rows) comes to
the driver.  Transform: each row's weights come from its own term array; the
vocabulary (size bounded by ``max_features``) travels with the function.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buzzscore.functions.pyhelpers import bigram_counts, combine_terms, count_terms, weigh_terms, word_and_bucket_counts
from buzzscore.functions.text import fold_accents, spark_stop_words, tokenize
from buzzscore.session import written

# Largest vocabulary that is collected to the driver and sent to the tasks.
MAX_BROADCAST_TERMS = 100_000
# Up to this one the SVD comes from the Gram matrix, a dense F x F matrix (32 MB
# at this bound) in each task; beyond it from the randomized solver.
MAX_GRAM_TERMS = 2048

# Terms that a task adds up before it gives them out, some 300 bytes each.
HELD_TERMS = 300_000
# Posts a partition of the terms' shuffle: their distinct terms, some hundred a post, fit a task.
POSTS_PER_PARTITION = 20_000
# Posts up to which all terms are counted in one pass; beyond, bigrams that may be in the vocabulary only.
ONE_PASS_POSTS = 20_000
# Buckets that all bigrams are counted by: 2^20, 8 bytes each in a task.
BUCKET_BITS = 20


@dataclass(frozen=True)
class TfidfParams:
    max_features: int = 1000
    min_df: float = 3  # int: document count; float in (0, 1): fraction
    max_df: float = 0.85
    bigrams: bool = True
    stop_words: tuple[str, ...] = field(default_factory=spark_stop_words)
    accent_fold: bool = True

    def __post_init__(self):
        if not 1 <= self.max_features <= MAX_BROADCAST_TERMS:
            raise ValueError(f"max_features must be in [1, {MAX_BROADCAST_TERMS}]")


def _count_threshold(value: float, n_docs: int) -> float:
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    return float(value) * n_docs


def with_tokens(df: DataFrame, params: TfidfParams, text_col: str = "content") -> DataFrame:
    """Add ``_tokens``: the folded tokens of each post, joined by blanks."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    prepped = fold_accents(text) if params.accent_fold else F.lower(text)
    folded = df.withColumn("_text", prepped)
    return folded.select(*df.columns, F.array_join(tokenize(F.col("_text")), " ").alias("_tokens"))


def token_terms(df: DataFrame, params: TfidfParams, terms_col: str = "terms", only: Sequence[str] | None = None) -> DataFrame:
    """Replace ``_tokens`` by ``terms``; see ``with_terms``."""
    count = F.arrow_udf(count_terms(params.stop_words, params.bigrams, only), "array<struct<term:string,tf:bigint>>")
    return df.select(*[c for c in df.columns if c != "_tokens"], count("_tokens").alias(terms_col))


def with_terms(
    df: DataFrame,
    params: TfidfParams,
    text_col: str = "content",
    terms_col: str = "terms",
    only: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``terms``: each post's distinct unigrams and bigrams with their counts,
    sorted, as ``array<struct<term, tf>>``.  Nothing leaves the row.

    With ``only``, the terms of a vocabulary, all others are dropped before
    they are sorted: weights need no more.
    """
    return token_terms(with_tokens(df, params, text_col), params, terms_col, only)


def exploded_terms(df: DataFrame, id_col: str = "post_id", terms_col: str = "terms") -> DataFrame:
    """``(post_id, term, tf)`` of a frame that has ``terms``."""
    # inline_outer, then drop the empty-post row: a plain inline makes
    # Catalyst infer ``size(terms) > 0`` and push that filter below the
    # projections, re-running the whole per-row pipeline inside it.
    out = df.select(F.col(id_col).alias("post_id"), F.inline_outer(terms_col))
    return out.filter(F.col("term").isNotNull()).select("post_id", "term", "tf")


def doc_terms(df: DataFrame, params: TfidfParams, id_col: str = "post_id", text_col: str = "content") -> DataFrame:
    """``(post_id, term, tf)``: raw counts of unigrams and bigrams per post."""
    narrow = df.select(F.col(id_col).alias("post_id"), F.col(text_col).alias("content"))
    return exploded_terms(with_terms(narrow, params))


@dataclass
class Vocabulary:
    """Kept terms with ids (alphabetical rank), df, corpus count and idf."""

    table: pd.DataFrame  # term, term_id, df, cf, idf
    n_docs: int

    @property
    def size(self) -> int:
        return len(self.table)

    def to_spark(self, spark: SparkSession) -> DataFrame:
        pdf = self.table[["term", "term_id", "df", "cf", "idf"]]
        return spark.createDataFrame(
            pdf, "term string, term_id int, df bigint, cf bigint, idf double"
        )


def term_stats(terms: DataFrame) -> DataFrame:
    """Document frequency and corpus count per term (map-side combined)."""
    return terms.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")
    )


def row_term_stats(rows: DataFrame, n_docs: int, params: TfidfParams) -> DataFrame:
    """``term_stats`` of a frame that has ``_tokens``.

    Tasks add up their rows' terms in bounded memory; the shuffle has more
    partitions the more posts there are, so a task's part of the terms stays as it is.
    """
    combine = combine_terms(params.stop_words, params.bigrams, HELD_TERMS)
    parts = rows.select("_tokens").mapInArrow(combine, "term string, df long, cf long")
    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartition(max(shuffles, -(-n_docs // POSTS_PER_PARTITION)), "term")
    return dealt.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def frequent_term_stats(rows: DataFrame, n_docs: int, params: TfidfParams) -> DataFrame:
    """``row_term_stats`` of all terms that may be in the vocabulary, in two passes over the rows.

    Most bigrams come once or twice, and to add up all of them costs more than all else.
    The first pass counts single words, and bigrams by buckets of a hash.  If as many words
    as the vocabulary has places pass the document frequencies, the last of them has t
    occurrences, and so no term of fewer gets a place; with fewer words a bigram needs
    ``min_df`` occurrences.  A bucket holds all occurrences of its bigrams, so those of a
    bucket of fewer are none of them in the vocabulary.  The second pass counts the others.
    """
    spark = rows.sparkSession
    shuffles = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_docs // POSTS_PER_PARTITION))
    # a task a core at most: each gives out as many buckets, however few its posts
    tokens = rows.select("_tokens").coalesce(max(1, spark.sparkContext.defaultParallelism))
    high, low = _count_threshold(params.max_df, n_docs), _count_threshold(params.min_df, n_docs)
    sums = [F.sum("df").alias("df"), F.sum("cf").alias("cf")]

    first = tokens.mapInArrow(word_and_bucket_counts(params.stop_words, params.bigrams, HELD_TERMS, BUCKET_BITS), "term string, bucket int, df long, cf long")
    counts = first.repartition(shuffles, "term", "bucket").groupBy("term", "bucket").agg(*sums)
    counts = written(counts.where(F.col("bucket").isNotNull() | F.col("df").between(low, high)), "counts")
    words = counts.where("bucket IS NULL").select("term", "df", "cf")
    places = words.orderBy(F.col("cf").desc()).limit(params.max_features).agg(F.count(F.lit(1)), F.min("cf")).first()
    least = max(low, places[1]) if places[0] == params.max_features else low
    enough = F.col("cf") >= least
    if not params.bigrams:
        return words.where(enough)
    full = counts.where(F.col("bucket").isNotNull() & enough).select("bucket").toPandas()  # 2^BUCKET_BITS at most
    wanted = np.zeros(1 << BUCKET_BITS, bool)
    wanted[full["bucket"].to_numpy()] = True
    second = tokens.mapInArrow(bigram_counts(params.stop_words, HELD_TERMS, BUCKET_BITS, np.packbits(wanted).tobytes()), "term string, df long, cf long")
    bigrams = second.repartition(shuffles, "term").groupBy("term").agg(*sums)
    return words.union(bigrams).where(enough)


def fit_vocabulary(terms: DataFrame, n_docs: int, params: TfidfParams) -> Vocabulary:
    """Prune by document frequency, keep the ``max_features`` most frequent
    terms (ties: alphabetical), number them alphabetically, compute idf.

    ``terms`` has ``post_id, term, tf``, or a row a post with its ``_tokens``."""
    high = _count_threshold(params.max_df, n_docs)
    low = _count_threshold(params.min_df, n_docs)
    if high < low:
        raise ValueError("max_df corresponds to < documents than min_df")
    if "_tokens" in terms.columns:
        stats = (row_term_stats if n_docs <= ONE_PASS_POSTS else frequent_term_stats)(terms, n_docs, params)
    else:
        stats = term_stats(terms)
    stats = stats.filter((F.col("df") >= low) & (F.col("df") <= high))
    top = stats.orderBy(F.col("cf").desc(), F.col("term")).limit(params.max_features)
    rows = top.collect()  # at most max_features rows
    if not rows:
        raise ValueError(
            "TF-IDF produced 0 features. Relax the vectoriser parameters "
            "(lower min_df, raise max_df or max_features)."
        )
    return number_terms(rows, n_docs)


def number_terms(rows: list, n_docs: int) -> Vocabulary:
    """The vocabulary of the kept ``term, df, cf`` rows: alphabetical ids and idf."""
    pdf = pd.DataFrame([r.asDict() for r in rows]).sort_values("term", kind="mergesort")
    pdf = pdf.reset_index(drop=True)
    pdf["term_id"] = np.arange(len(pdf), dtype=np.int32)
    pdf["idf"] = np.log((1.0 + n_docs) / (1.0 + pdf["df"].astype(np.float64))) + 1.0
    return Vocabulary(pdf, n_docs)


def row_vectors(df: DataFrame, vocab: Vocabulary, terms_col: str = "terms") -> DataFrame:
    """Add ``term_ids`` and ``weights``: the L2-normalised TF-IDF row of each post,
    from its ``terms`` alone (vocabulary terms only, by id; none: empty arrays)."""
    kind = "struct<term_ids:array<int>,weights:array<double>>"
    weigh = F.arrow_udf(weigh_terms(vocab.table["term"].tolist(), vocab.table["idf"].to_numpy()), kind)
    out = df.withColumn("_v", weigh(F.col(terms_col)))
    return out.select(*df.columns, "_v.term_ids", "_v.weights")
