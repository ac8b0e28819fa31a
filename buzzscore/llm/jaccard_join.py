"""Similarity join on word shingles, by chosen paths.

1. Sets.  A text's set is its distinct runs of five words.  Equal sets are one
   class; from here on a class is one set, so copies cost nothing.  A set is
   embedded by one-permutation hashing: ``COORDINATES`` tokens, the smallest
   hash in each range of hashes.
2. Chosen paths.  In each run a set goes, for every token that a hash of its
   path selects with probability ``1 / (similarity * tokens)``, into the bucket
   of the path so far and that token: sets that share a selected token meet.
   Buckets of up to ``BUCKET`` sets are searched by brute force on the
   embedding.  Larger ones are split by further tokens; a set that is very near
   to the bucket's pivot is linked to it and goes no further (by the triangle
   inequality, all that is near to it is linked to the pivot too).  Pivots and
   the roots of links are the first in one order of all sets, so that the
   buckets in which a group meets again and again give the same links.  What is
   still large at the last level is searched in tiles, a pair of blocks at a
   time.  The number of runs follows from the recall asked for.
3. Check.  Linked sets form components.  A component's texts meet in tiles of
   two blocks, where the exact similarity of every pair is computed: the
   candidates are only as good as their components, the links are exact.

What leaves a task is never a list of pairs: searches return a spanning forest
of what they linked, checks a count per set.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buzzscore.llm.common import connected_components, keyed, sorted_groups, word_hashes, written

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 128
BUCKET = 200
LEVELS = 4
#: Sets, and shingles, that a block of a component may have.
BLOCK_SETS, BLOCK_SHINGLES = 128, 1 << 20
#: Estimates from the embedding (standard error 0.035 at similarity 0.8).
NEAR, PIVOT_NEAR, PIVOT_SAME = 0.62, 0.4, 0.7

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_EMPTY = np.uint32(0xFFFFFFFF)


def runs_for(recall: float, similarity: float = SIMILARITY, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold is found with probability ``recall``.

    A pair shares as many selected tokens per level as a Poisson variable of
    mean 1; the chance that a path survives ``levels`` of them follows level by
    level.
    """
    alive = 1.0
    for _ in range(levels):
        alive = 1 - math.exp(-alive)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - alive)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def shingle_sets(words: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each list of word hashes.

    A text of fewer than five words is one shingle, a text without words none.
    """
    # a slice of a list array has all its values: take those of its own lists only
    starts = words.offsets.to_numpy()
    flat = words.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]].view(np.uint64)
    starts = starts - starts[0]
    n = len(flat) - SHINGLE + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE):
        if n > 0:
            grams = _mix(grams * _C + flat[k : n + k])
    for s, e in zip(starts[:-1], starts[1:], strict=True):
        if e - s >= SHINGLE:
            yield np.unique(grams[s : e - SHINGLE + 1])
        elif e > s:
            whole = np.uint64(e - s)
            for w in flat[s:e]:
                whole = _mix(np.array([whole], np.uint64) * _C + w)[0]
            yield np.array([whole], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def embed(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash in each of the ranges; sorted shingles are in the order of the ranges."""
    out = np.full(COORDINATES, _EMPTY, np.uint32)
    bits = COORDINATES.bit_length() - 1
    ranges = (shingles >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(ranges, prepend=-1))
    out[ranges[first]] = np.minimum((shingles[first] << np.uint64(bits)) >> np.uint64(32), _EMPTY - np.uint32(1))
    return out


_SKETCH = "rk long, id long, size int, s1 long, s2 long, embedding binary, codes binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, s1, s2, embedding, codes = [], [], [], [], []
        for shingles in shingle_sets(batch.column(2)):
            size.append(len(shingles))
            s1.append(int(_mix(shingles ^ _C).sum(dtype=np.uint64).view(np.int64)))
            s2.append(int(_mix(shingles * _C + _A).sum(dtype=np.uint64).view(np.int64)))
            embedded = embed(shingles)
            embedding.append(embedded.tobytes())
            codes.append(_bytes(embedded).tobytes())
        columns = [batch.column(0), batch.column(1), pa.array(size, pa.int32()), pa.array(s1, pa.int64())]
        columns += [pa.array(s2, pa.int64()), pa.array(embedding, pa.binary()), pa.array(codes, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["rk", "id", "size", "s1", "s2", "embedding", "codes"])


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _bytes(embedding: np.ndarray) -> np.ndarray:
    """A byte per coordinate, 0 where it is empty."""
    short = 1 + ((embedding.astype(np.uint64) * np.uint64(255)) >> np.uint64(32))
    return np.where(embedding == _EMPTY, 0, short).astype(np.uint8)


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of the rows of two byte matrices: equal coordinates of those not empty in both."""
    return ((a == b) & (a != 0)).sum(axis=1) / np.maximum(((a | b) != 0).sum(axis=1), 1)


def _children(path: np.ndarray, embedding: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """``(row, path)`` of the buckets that rows go to from their paths."""
    filled = embedding != _EMPTY
    chance = 1 / (similarity * np.maximum(filled.sum(axis=1), 1))
    draw = _mix(path[:, None] + np.arange(1, COORDINATES + 1, dtype=np.uint64) * _B)
    row, at = np.nonzero(filled & ((draw >> np.uint64(11)) * 2.0**-53 < chance[:, None]))
    return row, _mix(draw[row, at] + (embedding[row, at].astype(np.uint64) + np.uint64(1)) * _C)


def _first_level(runs: int, similarity: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = _mix(np.arange(1, runs + 1, dtype=np.uint64) * _A)
        for batch in batches:
            ids, embedding = batch.column(0).to_numpy(), _matrix(batch.column(1), np.uint32)
            for root in roots:
                row, path = _children(np.full(len(ids), root), embedding, similarity)
                yield pa.RecordBatch.from_pydict({"set": ids[row], "path": path.view(np.int64)})

    return run


def _next_level(similarity: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, ids, pivot = (batch.column(k).to_numpy() for k in range(3))
            embedding = _matrix(batch.column(3), np.uint32)
            near = _estimate(_bytes(embedding), _bytes(_matrix(batch.column(4), np.uint32)))
            linked = (near >= PIVOT_NEAR) & (ids != pivot)
            stays = np.flatnonzero((near < PIVOT_SAME) | (ids == pivot))
            row, child = _children(path[stays].view(np.uint64), embedding[stays], similarity)
            row = stays[row]
            yield pa.RecordBatch.from_pydict(
                {
                    "set": np.concatenate([ids[linked], ids[row]]),
                    "path": pa.array(np.concatenate([pivot[linked], child.view(np.int64)])),
                    "link": np.concatenate([np.ones(linked.sum(), bool), np.zeros(len(row), bool)]),
                }
            )

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows is connected with by the pairs ``(a, b)``."""
    root = np.arange(n)
    while len(a):
        was = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(was, root):
            break
    return root


def _pairs(starts: np.ndarray, n: int, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of a group, for some groups at a time (one at least)."""
    sizes = np.diff(np.append(starts, n))
    upto = np.cumsum(sizes * (sizes - 1) // 2)
    begin = 0
    while begin < len(starts):
        before = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, before + most, side="right")))
        first = np.arange(starts[begin], starts[begin] + sizes[begin:end].sum())
        ends = np.repeat(starts[begin:end] + sizes[begin:end], sizes[begin:end])
        more = ends - first - 1  # rows of its group after each row
        a = np.repeat(first, more)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(more) - more, more)
        yield a, b
        begin = end


def _search_buckets(similarity: float) -> Callable:
    """Rows ``path, low, high, block, set, size, codes`` -> links ``a, b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in sorted_groups(batches, 3):
            low, high, block, ids, size = (batch.column(k).to_numpy() for k in (1, 2, 3, 4, 5))
            codes = _matrix(batch.column(6), np.uint8)
            for a, b in _pairs(starts, len(ids)):
                # blocks of one number have met in a tile of their own
                fits = (low[a] == high[a]) | (block[a] != block[b])
                fits &= np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])
                a, b = a[fits], b[fits]
                near = np.concatenate(
                    [_estimate(codes[a[k : k + 50_000]], codes[b[k : k + 50_000]]) for k in range(0, len(a), 50_000)] or [np.zeros(0)]
                )
                root = _roots(len(ids), a[near >= NEAR], b[near >= NEAR])
                hit = np.flatnonzero(root != np.arange(len(ids)))
                yield pa.RecordBatch.from_pydict({"a": ids[hit], "b": ids[root[hit]]})

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs."""
    token, back, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = often[back] > 1
    column = (np.cumsum(often > 1) - 1)[back[shared]]
    of = of[shared]
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    out = np.zeros((len(sets), len(sets)))
    n = int(column[-1]) + 1 if len(column) else 0
    for k in range(0, n, 4096):
        s, e = np.searchsorted(column, (k, k + 4096))
        part = np.zeros((len(sets), min(4096, n - k)), np.float32)
        part[of[s:e], column[s:e] - k] = 1
        out += part @ part.T
    return out


def _check_tiles(similarity: float) -> Callable:
    """Rows ``component, low, high, block, set, copies, words`` -> ``set, texts, documents, root``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in sorted_groups(batches, 3):
            low, high, block, ids, copies = (batch.column(k).to_numpy() for k in (1, 2, 3, 4, 5))
            for s, e in zip(starts, np.append(starts[1:], len(ids)), strict=True):
                sets = list(shingle_sets(batch.column(6).slice(s, e - s)))
                size = np.array([len(x) for x in sets])
                both = _common(sets)
                linked = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9
                np.fill_diagonal(linked, False)
                if low[s] != high[s]:
                    linked &= block[s:e][:, None] != block[s:e][None, :]
                a, b = np.nonzero(linked)
                root = _roots(e - s, a, b)
                hit = np.flatnonzero(linked.any(axis=1))
                yield pa.RecordBatch.from_pydict(
                    {
                        "set": ids[s:e][hit],
                        "texts": linked.sum(axis=1)[hit].astype(np.int64),
                        "documents": (linked @ copies[s:e]).astype(np.int64)[hit],
                        "root": ids[s:e][root[hit]],
                    }
                )

    return run


def _tiles(rows: DataFrame, blocks: str) -> DataFrame:
    """A row for each tile of two blocks (``low <= high``) that a row's block is part of."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("set"), F.col(blocks)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr(f"sequence(0, CAST({blocks} AS int) - 1)")))
    return rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")


def candidate_links(sets: DataFrame, runs: int, similarity: float = SIMILARITY, levels: int = LEVELS) -> DataFrame:
    """Links ``(a, b)`` between ``sets (set, size, embedding, codes)``: near pairs are connected by them."""
    first = sets.select("set", "embedding").mapInArrow(_first_level(runs, similarity), "set long, path long")
    found, links = [], []
    for level in range(1, levels + 1):
        rows = written(first, "paths")
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = written(sizes, "buckets")
        small = sizes if level == levels else sizes.where(F.col("n") <= BUCKET)
        found.append(rows.join(small, "path"))
        large = sizes.where(F.col("n") > BUCKET).select("path")
        if level == levels or large.isEmpty():
            break
        pivot = F.min(F.struct(F.xxhash64("set").alias("o"), "set", "embedding")).alias("p")
        members = rows.join(large, "path").join(sets.select("set", "embedding"), "set")
        pivots = members.groupBy("path").agg(pivot).select(
            "path", F.col("p.set").alias("pivot"), F.col("p.embedding").alias("pivot_embedding")
        )
        split = members.join(pivots, "path").select("path", "set", "pivot", "embedding", "pivot_embedding")
        split = written(split.mapInArrow(_next_level(similarity), "set long, path long, link boolean"), "split")
        links.append(split.where("link").select(F.col("set").alias("a"), F.col("path").alias("b")))
        first = split.where("NOT link").select("set", "path")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    rows = _tiles(rows.withColumn("blocks", F.ceil(F.col("n") / BUCKET)), "blocks")
    rows = rows.join(sets.select("set", "size", "codes"), "set")
    rows = rows.repartition("path", "low", "high").sortWithinPartitions("path", "low", "high", F.xxhash64("set"))
    out = rows.select("path", "low", "high", "block", "set", "size", "codes")
    out = out.mapInArrow(_search_buckets(similarity), "a long, b long")
    for more in links:
        out = out.union(more)
    return written(out.distinct(), "links")


def similar_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    recall: float = 0.99,
    key_col: str | None = None,
) -> DataFrame:
    """A row per row of ``docs``: ``rk, id, class_id, group_id, n_copies, n_texts, n_links, first``.

    Two rows are linked if the Jaccard similarity of their sets of five-word
    shingles is ``similarity`` or more.  ``class_id`` is the smallest id with
    the same set, ``group_id`` the smallest of all that are connected by links;
    ``n_copies`` counts the other rows with the same set, ``n_texts`` the other
    sets linked, ``n_links`` the other rows linked; ``first`` marks the one row
    that stands for its group.  ``rk`` is the key of :func:`keyed`,
    or ``key_col``: a unique long that ``docs`` has already, in a written table.

    * Words are lower-cased runs between blanks.  A text of fewer than five
      words is one shingle; a null, empty or blank text has none, is linked to
      nothing and is a class and a group of its own.
    * Rows with equal ids are different rows; null ids come last, and ties
      follow the order in which the rows are read.
    * Other columns of ``docs`` play no part.
    * A text of any length is read whole: all its shingles are together in a
      task.
    """
    narrow = [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")]
    table = docs.select(F.col(key_col).alias("rk"), *narrow) if key_col else keyed(docs.select(*narrow))
    hashed = table.select("rk", "id", word_hashes(F.col("text")).alias("words"))
    sketches = written(hashed.mapInArrow(_sketch, _SKETCH), "sketches")

    place = F.struct(F.col("id").isNull().alias("last"), "id", "rk")
    classes = (
        sketches.where("size > 0")
        .groupBy("s1", "s2", "size")
        .agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"), F.first("codes").alias("codes"))
    )
    sets = written(
        classes.select(F.col("p.rk").alias("set"), F.col("p.id").alias("set_id"), "size", "copies", "s1", "s2", "embedding", "codes"),
        "sets",
    )
    links = candidate_links(sets.select("set", "size", "embedding", "codes"), runs_for(recall, similarity), similarity)
    component = connected_components(links).withColumnRenamed("id", "set")

    # the exact check, in tiles of the components; texts meet their members by a shuffle at any size
    members = component.join(sets.select("set", "size", "copies"), "set")
    weight = F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("size") / BLOCK_SHINGLES)
    blocks = members.groupBy("component").agg(F.ceil(weight).alias("blocks"))
    # written, as the heads below, so that the joins have shuffles of their own: Spark can split a hot component
    blocks = written(blocks, "blocks")
    members = written(members.join(blocks, "component"), "members")
    texts = table.select(F.col("rk").alias("set"), "text").join(members.hint("merge"), "set")
    tiles = _tiles(texts, "blocks").repartition("component", "low", "high").sortWithinPartitions("component", "low", "high")
    tiles = tiles.select("component", "low", "high", "block", "set", "copies", word_hashes(F.col("text")).alias("words"))
    checked = written(
        tiles.mapInArrow(_check_tiles(similarity), "set long, texts long, documents long, root long"), "checked"
    )
    linked = checked.groupBy("set").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    groups = connected_components(checked.where("set <> root").select(F.col("set").alias("a"), F.col("root").alias("b")))
    groups = groups.withColumnRenamed("id", "set")

    known = sets.select("set", "set_id", "s1", "s2", "size", "copies").join(linked, "set", "left").join(groups, "set", "left")
    known = written(known.withColumn("component", F.coalesce("component", "set")), "known")
    heads = known.groupBy("component").agg(
        F.min(F.struct(F.col("set_id").isNull().alias("last"), F.col("set_id").alias("id"), F.col("set").alias("rk"))).alias("head")
    )
    known = known.join(written(heads, "heads"), "component").select(
        "s1", "s2", "size", "set_id", "copies", "texts", "documents", F.col("head.id").alias("head_id"), F.col("head.rk").alias("head_rk")
    )
    zero = F.lit(0).cast("long")
    none = F.col("size") == 0
    out = sketches.select("rk", "id", "size", "s1", "s2").join(known, ["s1", "s2", "size"], "left")
    return out.select(
        "rk",
        "id",
        F.when(none, F.col("id")).otherwise(F.col("set_id")).alias("class_id"),
        F.when(none, F.col("id")).otherwise(F.col("head_id")).alias("group_id"),
        F.when(none, zero).otherwise(F.col("copies") - 1).alias("n_copies"),
        F.coalesce("texts", zero).alias("n_texts"),
        F.when(none, zero).otherwise(F.col("copies") - 1 + F.coalesce("documents", zero)).alias("n_links"),
        (none | (F.col("rk") == F.col("head_rk"))).alias("first"),
    )
