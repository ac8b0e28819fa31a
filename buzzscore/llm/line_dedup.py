"""Removal of lines that repeat an earlier passage of three lines.

Every run of three consecutive lines is a window.  Windows are compared by two
64-bit hashes over the lines' hashes; the first window in the order (id, row,
line) stays and every later one covers its three lines.  A text loses the lines
that at least one of its windows covers.

Plan: windows are narrow rows (key, line, two hashes), so that the search for
repeats shuffles no text.  The minimum per hash is combined in the map tasks
and written; flagging is a join of two tables as read, which adaptive execution
can split where one window is in a large share of all texts.  Texts are shuffled once, to meet their flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buzzscore.llm.common import fresh, keyed, let, written

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(docs: DataFrame) -> DataFrame:
    """``(rk, id, pos, h1, h2)``: a row for each three consecutive lines that are not all blank."""

    def hashes(lines: Column) -> Column:
        at = lambda i, k: F.get(lines, i + k)
        starts = F.when(F.size(lines) >= WINDOW, F.sequence(F.lit(0), F.size(lines) - WINDOW)).otherwise(
            F.array().cast("array<int>")
        )
        filled = F.filter(starts, lambda i: F.trim(F.concat(*[at(i, k) for k in range(WINDOW)])) != "")
        return F.transform(
            filled,
            lambda i: F.struct(
                i.alias("pos"),
                F.xxhash64(*[at(i, k) for k in range(WINDOW)], F.lit(1)).alias("h1"),
                F.xxhash64(F.lit(2), *[x for k in range(WINDOW) for x in (at(i, k), F.lit(k))]).alias("h2"),
            ),
        )

    return docs.select("rk", "id", F.explode(let(_lines(F.col("text")), hashes)).alias("w")).select(
        "rk", "id", "w.pos", "w.h1", "w.h2"
    )


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``(rk, pos)`` of every window that repeats an earlier one; ``docs`` has ``rk, id, text``."""
    windows = _windows(docs)
    place = F.struct(F.col("id").isNull().alias("last"), "id", "rk", "pos")
    first = (
        windows.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("h1", "h2", F.col("first.rk").alias("first_rk"), F.col("first.pos").alias("first_pos"))
    )
    # written, so that the join has shuffles of its own: Spark can split a hot window there
    first = written(first, "first")
    return (
        windows.join(first, ["h1", "h2"])
        .where((F.col("rk") != F.col("first_rk")) | (F.col("pos") != F.col("first_pos")))
        .select("rk", "pos")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, the text without its covered lines, and
    ``n_lines``, ``n_removed``, ``n_spans`` (maximal runs of removed lines).

    * A null text stays null with 0 lines; an empty text is one blank line.
    * Texts of fewer than three lines have no window and stay as they are, as
      do windows of blank lines only.
    * Lines are compared as they are, case and blanks included.
    * Rows with a null id come last; rows with equal ids, repeated rows too,
      follow the order in which they are read, and the first keeps its lines.
    * Columns of ``docs`` that have the names of the three counts are kept;
      the counts then carry underscores in front.
    * A text of any length is read whole: its lines, and what is covered of
      them, are together in the row's task.
    """
    key = fresh(docs, "rk")
    table = keyed(docs, key)
    narrow = table.select(F.col(key).alias("rk"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = repeated_windows(narrow).groupBy("rk").agg(F.collect_list("pos").alias("marks"))
    marks = marks.select(F.col("rk").alias(key), F.col("marks").alias(fresh(docs, "marks")))
    marked = F.col(marks.columns[1])

    covered = F.coalesce(
        F.array_distinct(F.flatten(F.transform(marked, lambda p: F.array(*[p + k for k in range(WINDOW)])))),
        F.array().cast("array<int>"),
    )

    def cut(lines: Column) -> Column:
        everything = F.sequence(F.lit(0), F.size(lines) - 1)

        def apply(gone: Column) -> Column:
            kept = F.array_except(everything, gone)
            starts = F.array_except(gone, F.transform(gone, lambda p: p + 1))
            return F.struct(
                F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("text"),
                F.size(lines).cast("long").alias("n_lines"),
                F.size(gone).cast("long").alias("n_removed"),
                F.size(starts).cast("long").alias("n_spans"),
            )

        return let(covered, apply)

    text = F.col(text_col)
    touched = F.when(marked.isNotNull(), let(_lines(text), cut))
    done = fresh(docs, "done")
    out = table.join(marks, key, "left").withColumn(done, touched)
    zero = F.lit(0).cast("long")
    counts = {
        "n_lines": F.when(text.isNull(), zero).otherwise(
            F.coalesce(F.col(f"{done}.n_lines"), F.size(_lines(text)).cast("long"))
        ),
        "n_removed": F.coalesce(F.col(f"{done}.n_removed"), zero),
        "n_spans": F.coalesce(F.col(f"{done}.n_spans"), zero),
    }
    return out.select(
        *[
            F.when(marked.isNotNull(), F.col(f"{done}.text")).otherwise(text).alias(c) if c == text_col else F.col(c)
            for c in docs.columns
        ],
        *[c.alias(fresh(docs, name)) for name, c in counts.items()],
    )
