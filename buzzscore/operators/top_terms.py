"""The most frequent terms without shuffling every distinct term.

Counting all terms exactly sends each task's distinct bigrams, most of which
occur once, through the shuffle.  Here a task keeps at most ``capacity``
counters, a mergeable frequent-items summary: whenever it has more, the
``capacity + 1``-th largest count is taken off all of them and what is left of
nothing goes.  What is taken off adds up to at most N / (capacity + 1) over all
tasks, N occurrences in all; a term's sum over the tasks is too small by no more
than that.

1. Summaries are added up by term: tasks x capacity rows at most.
2. The terms with the largest sums are candidates, and their document and
   corpus counts are taken exactly in a second pass.
3. Any other term has at most U occurrences: the largest sum that is no
   candidate's, plus all that was taken off.  If the last term of the result has
   more than U, no term is missing: that is the proof.  Otherwise the same again
   with more counters; when nothing is taken off, U is an exact count.

The counters that a proof needs do not grow with the corpus, since N and the
counts of frequent terms grow together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buzzscore.functions.pyhelpers import frequent_items
from buzzscore.operators.tfidf import TfidfParams, Vocabulary, _count_threshold, exploded_terms, number_terms, term_stats
from buzzscore.session import written

CAPACITY = 1 << 16
#: Candidates for each term wanted, at first.
SPARE = 3
#: Most candidates that go to every task, some 40 bytes each.
MAX_CANDIDATES = 2_000_000


@dataclass(frozen=True)
class Proof:
    """Why no term is missing: the rarest one kept occurs more often than any that was not counted exactly."""

    capacity: int
    summary_rows: int
    candidates: int
    taken_off: int
    others_at_most: int
    rarest_kept: int


def summarise(rows: DataFrame, capacity: int) -> DataFrame:
    """``(term, n)``: a count of each task's frequent terms, too small by what the task's row with a null term says."""
    return rows.select("terms").mapInArrow(frequent_items(capacity), "term string, n long")


def fit_vocabulary_by_summary(
    rows: DataFrame, n_docs: int, params: TfidfParams, capacity: int = CAPACITY, spare: int = SPARE
) -> tuple[Vocabulary, Proof]:
    """The vocabulary of ``fit_vocabulary`` for a written table of posts with ``terms``, and its proof.

    Posts without terms, or a null list of them, count as posts only.
    """
    high, low = _count_threshold(params.max_df, n_docs), _count_threshold(params.min_df, n_docs)
    if high < low:
        raise ValueError("max_df corresponds to < documents than min_df")
    terms = exploded_terms(rows.select(F.lit(0).alias("post_id"), "terms"))
    wanted = spare * params.max_features
    while True:
        parts = written(summarise(rows, capacity), "summaries")
        taken_off = parts.where("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        sums = written(parts.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n")), "sums")
        cut = sums.orderBy(F.col("n").desc()).limit(wanted + 1).agg(F.min("n"), F.count(F.lit(1))).first()
        every = cut[1] <= wanted  # all terms in the summaries are candidates
        bound = 0 if every else cut[0]
        candidates = sums.where(F.col("n") > bound) if not every else sums
        n_candidates = candidates.count()
        if n_candidates > MAX_CANDIDATES:
            raise ValueError(f"{n_candidates} candidates; ask for fewer terms")
        chosen = F.broadcast(candidates.select("term"))  # bounded by MAX_CANDIDATES
        stats = term_stats(terms.join(chosen, "term")).where((F.col("df") >= low) & (F.col("df") <= high))
        kept = stats.orderBy(F.col("cf").desc(), F.col("term")).limit(params.max_features).collect()
        others = bound + taken_off
        rarest = kept[-1].cf if kept else 0
        if (len(kept) == params.max_features and rarest > others) or others == 0:
            if not kept:
                raise ValueError("TF-IDF produced 0 features. Relax the vectoriser parameters (lower min_df, raise max_df or max_features).")
            proof = Proof(capacity, parts.count(), n_candidates, taken_off, others, rarest)
            return number_terms(kept, n_docs), proof
        # more of what keeps the bound up
        if taken_off * 2 >= others:
            capacity *= 4
        if bound * 2 >= others:
            wanted *= 4


__all__ = ["Proof", "fit_vocabulary_by_summary", "summarise"]
