"""The corpus pipeline: raw documents in, a training mixture out.

``STAGES`` are applied in order; each takes what its predecessor kept.  A
result is written as Parquet to the shared folder and read again before the
next stage, so that a lost executor never sends work back past one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buzzscore.llm import decontaminate, jaccard_join, line_dedup, queries, toxicity
from buzzscore.llm.common import drop_scratch, fresh, keyed, read_table, scratch_mark, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model, learned from ``labels``, rejects."""
    labels = read_table(spark, sf_dir, "labels").where(~queries.held_out(F.col("doc_id")))
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model).where(F.col(fresh(docs, "predicted")) == 0).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat an earlier passage of three lines.

    A document that loses all its lines goes; one that had none to lose stays.
    """
    lines, gone = fresh(docs, "n_lines"), fresh(docs, "n_removed")
    return line_dedup.dedup_lines(docs).where((F.col(gone) == 0) | (F.col(gone) < F.col(lines))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of similar texts."""
    key = fresh(docs, "rk")
    table = keyed(docs, key)
    similar = jaccard_join.similar_texts(table, key_col=key)
    others = written(similar.where("NOT first").select(F.col("rk").alias(key)), "others")
    return table.join(others, key, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    found = decontaminate.find_items(docs, queries.benchmark_index(spark, sf_dir))
    return found.where(F.size(fresh(docs, "item_ids")) == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document and epoch of the mixture."""
    return queries.mix_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; tables written before a stage's result go once that is stored."""
    docs, begin = read_table(spark, sf_dir, "documents"), scratch_mark()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        drop_scratch(spark, begin, -1)
    return docs


#: Null: SQL cannot express the toxicity model.
ORACLE_SQL = None
