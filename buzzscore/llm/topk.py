"""Exact top-k search by inner product, on a bit-sliced index.

Components are quantised to integers.  A block of rows is stored as slices:
bitmap ``b`` of dimension ``d`` holds bit ``b`` of that component of every row.
For a query, each of its components is written in signed digits; every digit
adds that dimension's slices, shifted, to the sum (a negative digit adds their
complements, which a constant makes up for).  The additions are full adders on
whole bitmaps.  The k best rows are then selected from the most significant
slice of the sum downward; rows that are still equal after the last slice are
the boundary, resolved by their ids.

Every block meets every chunk of queries in a task of its own, whose memory is
bounded by ``block_rows`` and about ``query_chunk``; what leaves a task is k
rows per query.  No index is approximate, none is held by the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buzzscore.llm.common import with_row_key


def signed_digits(value: int) -> list[tuple[int, int]]:
    """``(sign, shift)`` of the digits of ``value``, no two neighbours (non-adjacent form)."""
    sign, value, out, shift = (-1, -value, [], 0) if value < 0 else (1, value, [], 0)
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            out.append((sign * digit, shift))
            value -= digit
        value >>= 1
        shift += 1
    return out


class BitSlicedBlock:
    """Rows of equal length, as bitmaps of 64-bit words."""

    def __init__(self, rows: np.ndarray):
        self.n = len(rows)
        top = max(int(rows.max(initial=0)), -int(rows.min(initial=0)) - 1, 0)
        self.width = top.bit_length() + 1  # with the sign
        self.offset = 1 << (self.width - 1)
        shifted = (rows.astype(np.int64) + np.int64(self.offset)).astype(np.uint64)
        pad = -self.n % 64
        bits = [((shifted >> np.uint64(b)) & np.uint64(1)).astype(np.uint8) for b in range(self.width)]
        pack = lambda x: np.packbits(np.pad(x, ((0, pad), (0, 0))), axis=0, bitorder="little")
        # [bit][dimension] -> words
        self.slices = [np.ascontiguousarray(pack(x).T).view(np.uint64) for x in bits]
        self.inverse = [~x for x in self.slices]
        everyone = np.packbits(np.pad(np.ones(self.n, np.uint8), (0, pad)), bitorder="little")
        self.everyone = everyone.view(np.uint64)

    def scores(self, query: Iterable[int]) -> tuple[list[np.ndarray], int]:
        """Slices, least first, of a sum that is the score of each row plus the constant returned."""
        columns: list[list[np.ndarray]] = []
        constant = 0
        for d, q in enumerate(query):
            for sign, shift in signed_digits(int(q)):
                source = self.slices if sign > 0 else self.inverse
                columns.extend([] for _ in range(shift + self.width - len(columns)))
                for b in range(self.width):
                    columns[shift + b].append(source[b][d])
                constant += (self.offset << shift) if sign > 0 else ((self.offset - 1) << shift)
        out, i = [], 0
        while i < len(columns):
            column = columns[i]
            if i + 1 == len(columns) and len(column) > 1:
                columns.append([])
            while len(column) > 2:  # full adders: three bitmaps of a weight give a sum and a carry
                a, b, c = column.pop(), column.pop(), column.pop()
                ab = a ^ b
                carry = a & b
                carry |= ab & c
                ab ^= c
                column.insert(0, ab)
                columns[i + 1].append(carry)
            if len(column) == 2:
                a, b = column
                columns[i + 1].append(a & b)
                column = [a ^ b]
            out.append(column[0] if column else np.zeros_like(self.everyone))
            i += 1
        return out, constant

    def top(self, slices: list[np.ndarray], k: int, without: int | None, ids: np.ndarray) -> np.ndarray:
        """The k best rows, all if there are fewer; equal rows by ``ids``, which are distinct ranks."""
        equal = self.everyone.copy()
        if without is not None:
            equal[without >> 6] &= ~(np.uint64(1) << np.uint64(without & 63))
        sure = np.zeros_like(equal)
        for s in reversed(slices):
            ones = equal & s
            n = int(np.bitwise_count(sure | ones).sum())
            if n > k:
                equal = ones
            else:
                sure |= ones
                equal &= ~s
                if n == k:
                    equal[:] = 0
                    break
        listed = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
        rows, boundary = listed(sure), listed(equal)
        room = k - len(rows)
        if room < len(boundary):
            boundary = boundary[np.argsort(ids[boundary], kind="stable")[:room]]
        return np.concatenate([rows, boundary])

    def values(self, slices: list[np.ndarray], constant: int, rows: np.ndarray) -> list[int]:
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        out = [-constant] * len(rows)
        for i, s in enumerate(slices):
            for j, one in enumerate((s[word] >> bit) & np.uint64(1)):
                if one:
                    out[j] += 1 << i
        return out


_RESULT = "query_rk long, query_id long, rk long, vec_id long, score long"


def _matrix(table: pa.Table) -> np.ndarray:
    column = table["q"].combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _search_block(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in ("query_rk", "query_id", "rk", "vec_id", "score")}
        # the side that has no row of a key may be a table without columns
        if all("rk" in t.column_names and len(t) for t in (rows, queries)):
            ids, rks = rows["vec_id"].to_pylist(), np.asarray(rows["rk"])
            # smaller id first, null ids last, then the order of the rows
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, rks[i]))
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            place = {int(r): i for i, r in enumerate(rks)}
            block = BitSlicedBlock(_matrix(rows))
            for rk, qid, q in zip(queries["rk"].to_pylist(), queries["vec_id"].to_pylist(), _matrix(queries), strict=True):
                slices, constant = block.scores(q)
                best = block.top(slices, k, place.get(rk), rank)
                out["query_rk"] += [rk] * len(best)
                out["query_id"] += [qid] * len(best)
                out["rk"] += rks[best].tolist()
                out["vec_id"] += [ids[i] for i in best]
                out["score"] += [(v + (1 << 63)) % (1 << 64) - (1 << 63) for v in block.values(slices, constant, best)]
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run


def quantise(vector: Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of each component; null for a null vector or one with a null or non-finite part."""
    x = lambda v: v.cast("double")
    sound = F.forall(vector, lambda v: F.coalesce(~F.isnan(x(v)) & (F.abs(x(v)) < F.lit(float("inf"))), F.lit(False)))
    return F.when(sound, F.transform(vector, lambda v: F.floor(x(v) * scale).cast("long")))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    block_rows: int = 1 << 15,
    query_chunk: int = 1 << 8,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest inner products of each query.

    The queries are the rows for which ``is_query`` holds; candidates are all
    rows but the query's own.  Ties go to the smaller id, null ids last, then
    to the order in which the rows are read.

    * Vectors that are null or empty, or hold a null or non-finite component,
      take no part; a query meets candidates of its own length only.
    * Rows with equal ids are different rows: each is a candidate for the
      other, and each is a query with its own k results.
    * An empty table, or no query, gives an empty result.  Other columns play
      no part.  Scores are 64-bit and wrap around beyond that.
    """
    keyed = with_row_key(
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("asks"))
    )
    rows = keyed.select("rk", "vec_id", quantise(F.col("v"), scale).alias("q"), "asks").where("size(q) > 0")
    n, asking = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    blocks, chunks = max(1, -(-n // block_rows)), max(1, -(-asking // query_chunk))
    dim = F.size("q").alias("dim")
    dealt = lambda parts: F.pmod(F.xxhash64("rk"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = rows.select("rk", "vec_id", "q", dim, dealt(blocks).alias("block"), each(chunks).alias("chunk"))
    right = rows.where("asks").select("rk", "vec_id", "q", dim, each(blocks).alias("block"), dealt(chunks).alias("chunk"))
    key = ["dim", "block", "chunk"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_search_block(k), _RESULT)
    order = Window.partitionBy("query_rk").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rk")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
