"""Deterministic exact-size sampling.

A row's sampling key is ``md5(seed || '|' || id)``; the sample of size n is
the n rows with the smallest keys.  Any engine that has md5 picks the same
rows.  The n-th smallest key is found by counting rows per leading hex digits,
then inside the one group where it lies; those passes read the id alone and
return counts.  The sample itself is a filter: rows are neither sorted nor
shuffled, whatever their width and whatever n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SEED = 42

#: Hex digits by which one pass divides the keys (4,096 counts come back).
DIGITS = 3
#: Keys of a group that are listed instead of being divided further.
LISTED = 4096


def sample_key(seed: int = DEFAULT_SEED, id_col: str = "post_id") -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.lit("|"), F.col(id_col).cast("string")))


def _group_with(counts: list, n: int) -> tuple[str, int, int]:
    """Of ascending ``(key, rows)``, the key with the n-th row, the rows before it and its own."""
    before = 0
    for key, rows in counts:
        if before + rows >= n:
            return key, before, rows
        before += rows
    raise ValueError("fewer rows than n")


def exact_sample(df: DataFrame, n: int, seed: int = DEFAULT_SEED, id_col: str = "post_id") -> DataFrame:
    """The ``min(n, rows)`` rows with the smallest sampling keys.

    Rows without an id come first.  Rows of one id have one key: where only
    some of them fit into the sample, any of them are taken.  ``n < 1`` gives
    no row.
    """
    if n < 1:
        return df.limit(0)
    key = F.coalesce(sample_key(seed, id_col), F.lit(""))
    counted = lambda rows, k: sorted(map(tuple, rows.groupBy(k.alias("k")).count().collect()))
    keys, prefix, wanted = df.select(key.alias("k")), "", n
    while True:
        group = keys.where(F.col("k").startswith(prefix)) if prefix else keys
        counts = counted(group, F.substring("k", 1, len(prefix) + DIGITS))
        if not prefix and sum(c for _, c in counts) <= n:
            return df  # every row is in the sample
        prefix, before, rows = _group_with(counts, wanted)
        wanted -= before
        if rows <= LISTED or len(prefix) in (0, 32):
            break
    # keys of the group: as many as LISTED, or one that many rows share
    cut, before, rows = _group_with(counted(keys.where(F.col("k").startswith(prefix) if prefix else F.col("k") == ""), F.col("k")), wanted)
    if before + rows == wanted:
        return df.where(key <= cut)
    return df.where(key < cut).unionByName(df.where(key == cut).limit(wanted - before))
