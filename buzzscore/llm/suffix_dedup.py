"""Removal of byte strings that occur more than once, by a sparse suffix array.

``length`` bytes (400) are to be found wherever they repeat.  Of all suffixes
only those at anchors are looked at: the anchor of a window of ``length`` bytes
is the start of the ``KMER``-byte string in it with the smallest hash, so equal
windows have equal anchors at equal places.  Anchors with one hash form a
family.

Within a family, the suffixes from the anchors are sorted (right contexts),
their common prefixes computed, and a scan with a stack gives the tree of
common-prefix intervals.  Each interval is tested for how far its members agree
to the left: its members in the order of their left contexts, again with the
stack scan, give the groups whose left extensions differ beyond that, the
maximal repeats, with all members.  A member is covered as far as its groups of
``length`` bytes or more reach.

Contexts end where no window of the anchor can reach, so occurrences with equal
contexts are one member: copies cost no more than a count.  Families of one
context need no sorting at all.  Families of more than ``FAMILY`` contexts do
not go to one task; their windows are compared by hash, a row for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buzzscore.llm.common import fresh, keyed, sorted_groups, written

LENGTH = 400
KMER = 128
#: Contexts that a family may have to be sorted in one task: some 100 MB, and about a second.
FAMILY = 50_000
#: Bytes whose hashes are computed at once.
CHUNK = 1 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _kmer_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``KMER`` bytes (a power of two) at each place; doubled, not rolled."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _A
    h ^= h >> np.uint64(32)
    step = 1
    while step < KMER:
        h = (h[:-step] * _B + h[step:]) * _A
        h ^= h >> np.uint64(29)
        step *= 2
    return h


def _anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows inside the pieces ``starts .. ends``."""
    windows = length - KMER + 1
    n = len(data) - length + 1  # windows
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _kmer_hashes(data)
    # the place in the low bits: of equal hashes the first is smallest
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    key = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(key) // windows)
    grid = np.full(rows * windows, np.iinfo(np.uint64).max)
    grid[: len(key)] = key
    grid = grid.reshape(rows, windows)
    upto = np.minimum.accumulate(grid, axis=1).ravel()
    onward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(onward[:n], upto[windows - 1 : windows - 1 + n])
    inside = np.zeros(len(data) + 1, np.int8)
    long_ = ends - starts >= length
    np.add.at(inside, starts[long_], 1)
    np.add.at(inside, ends[long_] - length + 1, -1)
    least = least[np.cumsum(inside, dtype=np.int8)[:n].astype(bool)]
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = at[np.diff(at, prepend=-1) != 0]
    return at, h[at]


_ANCHORS = "rk long, p int, family long, context long, l int, r int"


def _find_anchors(length: int) -> Callable:
    reach = length - KMER  # bytes of a window beyond its anchor, on both sides together

    def rows(rk: np.ndarray, texts: list[bytes], base: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of pieces of texts: ``base`` is a piece's place in its text, ``last`` its text's latest anchor."""
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        data = np.frombuffer(b"".join(texts), np.uint8)
        at, h = _anchors(data, starts, ends, length)
        of = np.searchsorted(starts, at, side="right") - 1
        p = at - starts[of] + base[of]
        new = p > last[of]
        of, p, h = of[new], p[new], h[new]
        np.maximum.at(last, of, p)
        yield of, p, h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end]) <= CHUNK):
                    size += len(texts[end])
                    end += 1
                group = texts[begin:end]
                last = np.full(len(group), -1, np.int64)
                if size <= CHUNK:
                    pieces = [(group, np.zeros(len(group), np.int64))]
                else:  # one long text, in overlapping pieces
                    step = range(0, max(1, size - length + 1), CHUNK)
                    pieces = [([group[0][s : s + CHUNK + length - 1]], np.array([s])) for s in step]
                for piece, base in pieces:
                    for of, p, h in rows(keys[begin:end], piece, base, last):
                        ends = np.array([len(t) for t in group])[of]
                        l, r = np.minimum(p, reach), np.minimum(ends - p - KMER, reach)  # noqa: E741
                        context = [
                            xxhash.xxh3_64_intdigest(group[i][a:b], seed=s)
                            for i, a, b, s in zip(of.tolist(), (p - l).tolist(), (p + KMER + r).tolist(), l.tolist(), strict=True)
                        ]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "rk": keys[begin:end][of],
                                "p": pa.array(p, pa.int32()),
                                "family": h.view(np.int64),
                                "context": np.array(context, np.uint64).view(np.int64),
                                "l": pa.array(l, pa.int32()),
                                "r": pa.array(r, pa.int32()),
                            }
                        )
                begin = end

    return run


def lcp_intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """``(depth, first, last)`` of the common-prefix intervals of at least ``least``, by a stack scan.

    ``lcp[i]`` is what the sorted entries ``i`` and ``i + 1`` have in common.
    Inner intervals come before those that hold them.
    """
    stack: list[tuple[int, int]] = []  # (depth, first)
    for i, depth in enumerate([*lcp.tolist(), -1]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            if d >= least:
                yield d, first, i
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))


class Contexts:
    """Strings, sorted, and what neighbours have in common."""

    def __init__(self, strings: list[bytes]):
        self.width = max(map(len, strings))
        self.order = np.array(sorted(range(len(strings)), key=strings.__getitem__))
        self.rank = np.empty(len(strings), np.int64)
        self.rank[self.order] = np.arange(len(strings))
        self.size = np.array([len(s) for s in strings])
        self.bytes = np.frombuffer(b"".join(s.ljust(self.width, b"\0") for s in strings), np.uint8).reshape(len(strings), -1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefixes of strings ``a[i]`` and ``b[i]``."""
        differ = self.bytes[a] != self.bytes[b]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), self.width) if self.width else np.zeros(len(a), np.int64)
        return np.minimum(first, np.minimum(self.size[a], self.size[b]))


def maximal_repeats(left: list[bytes], right: list[bytes], length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(bytes to the left, bytes to the right, members)`` of the maximal repeats of ``length`` bytes or more.

    ``left`` has the contexts before the anchors, reversed; ``right`` those from the anchors on.
    """
    rights, lefts = Contexts(right), Contexts(left)
    order = rights.order
    for depth, first, last in lcp_intervals(rights.common(order[:-1], order[1:]), KMER):
        members = order[first : last + 1]
        members = members[np.argsort(lefts.rank[members], kind="stable")]
        agree = lefts.common(members[:-1], members[1:])
        if agree.max() < length - depth:
            continue
        for shared, begin, end in lcp_intervals(agree, max(0, length - depth)):
            yield shared, depth, members[begin : end + 1]


def _cover_families(length: int) -> Callable:
    """Rows ``family, context, left, right`` sorted by family -> ``family, context, l, r`` covered around the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in sorted_groups(batches, 1):
            family, context = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            cover = np.full((len(family), 2), -1, np.int64)
            for s, e in zip(starts, np.append(starts[1:], len(family)), strict=True):
                if e - s > 1:
                    for l, r, members in maximal_repeats([x[::-1] for x in left[s:e]], right[s:e], length):  # noqa: E741
                        cover[s + members] = np.maximum(cover[s + members], (l, r - KMER))
            hit = np.flatnonzero(cover[:, 0] >= 0)
            yield pa.RecordBatch.from_pydict(
                {
                    "family": family[hit],
                    "context": context[hit],
                    "l": pa.array(cover[hit, 0], pa.int32()),
                    "r": pa.array(cover[hit, 1], pa.int32()),
                }
            )

    return run


def _windows(length: int) -> Callable:
    """Rows ``family, context, left, right`` -> a row ``h1, h2, family, context, o`` for each window of the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for family, context, left, right in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                whole, begin = left + right, range(max(0, len(left) + len(right) - length + 1))
                begin = [b for b in begin if b <= len(left)]
                digests = [xxhash.xxh3_128_digest(whole[b : b + length]) for b in begin]
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_pydict(
                    {
                        "h1": h[:, 0],
                        "h2": h[:, 1],
                        "family": pa.array([family] * len(begin), pa.int64()),
                        "context": pa.array([context] * len(begin), pa.int64()),
                        "o": pa.array([len(left) - b for b in begin], pa.int32()),
                    }
                )

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(rk, start, stop)`` of bytes that repeated strings of ``length`` bytes cover; ``docs (rk, data)``.

    The spans of a row may overlap; together they are all that is covered.
    """
    if length <= KMER:
        raise ValueError(f"the length must be more than {KMER}")
    reach = length - KMER
    anchors = written(docs.select("rk", "data").mapInArrow(_find_anchors(length), _ANCHORS), "anchors")
    families = (
        anchors.groupBy("family")
        .agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("a"), F.max("context").alias("b"))
        .where("n > 1")
        .select("family", (F.col("a") != F.col("b")).alias("mixed"))
    )
    # written, so that the join has a shuffle of its own: Spark can split a hot family's anchors there
    families = written(families, "families")
    found = written(anchors.join(families, "family"), "found")

    contexts = (
        found.where("mixed")
        .groupBy("family", "context")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rk", "p", "l", "r")).alias("one"))
    )
    contexts = written(contexts.select("family", "context", "n", "one.*"), "contexts")
    sizes = written(contexts.groupBy("family").agg(F.count(F.lit(1)).alias("members")), "sizes")
    of_text = contexts.join(sizes, "family").groupBy("rk").agg(
        F.collect_list(F.struct("family", "context", "members", "p", "l", "r")).alias("all")
    )
    cut = lambda start, size: F.substr("data", (start + 1).cast("int"), size.cast("int"))
    strings = docs.select("rk", "data").join(of_text, "rk").select("data", F.explode("all").alias("c"))
    strings = written(
        strings.select(
            "c.family",
            "c.context",
            "c.members",
            cut(F.col("c.p") - F.col("c.l"), F.col("c.l")).alias("left"),
            cut(F.col("c.p"), F.col("c.r") + KMER).alias("right"),
        ),
        "strings",
    )
    sorted_ = strings.where(F.col("members") <= FAMILY).select("family", "context", "left", "right")
    sorted_ = sorted_.repartition("family").sortWithinPartitions("family")
    cover = sorted_.mapInArrow(_cover_families(length), "family long, context long, l int, r int")
    hot = strings.where(F.col("members") > FAMILY).select("family", "context", "left", "right")
    windows = hot.mapInArrow(_windows(length), "h1 long, h2 long, family long, context long, o int")
    # one string at one place around the anchor: a window with two anchors is not its own repeat
    same = ["h1", "h2", "family", "o"]
    again = windows.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*same)
    hot_cover = windows.join(again, same).groupBy("family", "context").agg(
        F.max("o").alias("l"), (F.lit(reach) - F.min("o")).alias("r")
    )
    # a context that occurs twice is covered whole, if it is long enough
    twice = contexts.where((F.col("n") > 1) & (F.col("l") + F.col("r") >= reach)).select("family", "context", "l", "r")
    cover = cover.unionByName(hot_cover).unionByName(twice)
    cover = cover.groupBy("family", "context").agg(F.max("l").alias("cl"), F.max("r").alias("cr"))
    cover = written(cover, "cover")  # as above: copies of one context are a hot key

    mixed = found.where("mixed").select("rk", "p", "family", "context").join(cover, ["family", "context"])
    alone = found.where(~F.col("mixed") & (F.col("l") + F.col("r") >= reach))
    span = lambda l, r: [(F.col("p") - l).alias("start"), (F.col("p") + KMER + r).alias("stop")]  # noqa: E731, E741
    return mixed.select("rk", *span(F.col("cl"), F.col("cr"))).union(alone.select("rk", *span(F.col("l"), F.col("r"))))


def _remove(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """``(data, spans)`` -> merged spans and what they leave."""
    kind = pa.struct([("kept", pa.binary()), ("whole", pa.string()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32()))])
    for data, spans in batches:
        out = []
        for text, all_ in zip(data.to_pylist(), spans.to_pylist(), strict=True):
            if text is None or not all_:
                out.append(None)
                continue
            merged: list[list[int]] = []
            for s in sorted((x["start"], x["stop"]) for x in all_):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            edges = [0, *[x for m in merged for x in m], len(text)]
            runs = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
            whole = "".join(run.decode("utf-8", "ignore") for run in runs)
            out.append({"kept": b"".join(runs), "whole": whole, "starts": [m[0] for m in merged], "stops": [m[1] for m in merged]})
        yield pa.array(out, kind)


def dedup_substrings(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """All rows and columns of ``docs``, and ``kept`` (binary), ``kept_text, n_bytes, n_removed, n_spans, starts, stops``.

    A text is its UTF-8 bytes.  Every byte goes that is covered by a string of
    ``length`` bytes that starts anywhere else too, in any text, overlapping
    included; all copies go, the first one as well.  ``starts`` and ``stops``
    are the maximal runs removed; ``kept_text`` is what is left as text, without
    the rest of a character that a cut divides.

    * A null text counts as empty; texts shorter than ``length`` keep all.
    * Repeated rows are texts of their own, so they remove each other.
    * Texts of any length are read whole, in pieces that overlap.
    * Columns of ``docs`` that have a result's name are kept; the result then
      carries underscores in front.
    """
    key, data, marks, done = (fresh(docs, n) for n in ("rk", "data", "marks", "done"))
    table = keyed(docs, key)
    binary = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    spans = repeated_spans(table.select(F.col(key).alias("rk"), binary.alias("data")), length)
    of_text = spans.groupBy(F.col("rk").alias(key)).agg(F.collect_list(F.struct("start", "stop")).alias(marks))
    remove = F.arrow_udf(
        _remove, "struct<kept:binary,whole:string,starts:array<int>,stops:array<int>>", F.ArrowUDFType.SCALAR_ITER
    )
    out = table.withColumn(data, binary).join(of_text, key, "left")
    out = out.withColumn(done, remove(F.when(F.col(marks).isNotNull(), F.col(data)), F.col(marks)))
    kept = F.coalesce(F.col(f"{done}.kept"), F.col(data))
    n_bytes = F.octet_length(F.col(data)).cast("long")
    none = F.array().cast("array<int>")
    results = {
        "kept": kept,
        "kept_text": F.coalesce(F.col(f"{done}.whole"), F.col(text_col), F.lit("")),
        "n_bytes": n_bytes,
        "n_removed": n_bytes - F.octet_length(kept),
        "n_spans": F.coalesce(F.size(f"{done}.starts"), F.lit(0)).cast("long"),
        "starts": F.coalesce(F.col(f"{done}.starts"), none),
        "stops": F.coalesce(F.col(f"{done}.stops"), none),
    }
    return out.select(*[F.col(c) for c in docs.columns], *[v.alias(fresh(docs, k)) for k, v in results.items()])
