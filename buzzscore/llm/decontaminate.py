"""Benchmark decontamination: which documents hold test items, question and answer.

The test items are the indexed side: a BM25 inverted index, each posting's
impact divided by the score that the item's own text gets, so that one
threshold serves all items.  Postings are in blocks with their largest impact.
Every passage of every document queries the index by block-max WAND, which
returns all items from the threshold on; what it returns is verified by the
share of the question's and of the answer's word trigrams in the passage.

Passages are windows of two strides, a stride being the longest item: an item
copied anywhere lies whole in one window.  Most passages can reach no item: an
upper bound over the terms that matter (the rest cannot sum up to half the
threshold in any item) is computed for a whole Arrow batch at once.

The index goes to the tasks in shards of at most ``MAX_POSTINGS``; documents
are read once, whatever the number of shards, and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buzzscore.llm.common import fresh, with_row_key, written

K1, B = 1.2, 0.75
BLOCK = 64
#: Words of texts that are looked up at once.
CHUNK = 1 << 19
#: Postings that a shard of the index may have; about 24 bytes each.
MAX_POSTINGS = 1_000_000
#: Postings, and words of items, that the whole index may have (some 300 MB); more are refused.
MAX_INDEX = 8_000_000
GRAM = 3


def tokens(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits; none for a null text."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1)
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def question_and_answer(text: Column) -> tuple[Column, Column]:
    """The answer is the last sentence; an item of one sentence is all question."""
    pattern = r"(?s)\A(.*[.!?\n])\s*(\S.*?)\s*\z"
    # without its own full stop, the last sentence is what follows the last one before
    trimmed = F.regexp_replace(text, r"(?s)[.!?\s]+\z", "")
    first, last = F.regexp_extract(trimmed, pattern, 1), F.regexp_extract(trimmed, pattern, 2)
    return F.when(last != "", first).otherwise(trimmed), F.when(last != "", last).otherwise("")


def item_parts(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, item_id, question, answer)``, the last two as token arrays."""
    question, answer = question_and_answer(F.coalesce(F.col(text_col), F.lit("")))
    return with_row_key(
        items.select(F.col(id_col).cast("long").alias("item_id"), tokens(question).alias("question"), tokens(answer).alias("answer")),
        "item",
    )


def postings(parts: DataFrame) -> DataFrame:
    """``(item, term, impact)``; an item's impacts sum up to 1."""
    words = parts.select("item", F.concat("question", "answer").alias("t")).where("size(t) > 0")
    n, average = words.agg(F.count(F.lit(1)), F.avg(F.size("t"))).first()
    tf = words.select("item", F.size("t").alias("len"), F.explode("t").alias("term"))
    tf = tf.groupBy("item", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.col("len") / F.lit(average or 1.0))
    scored = tf.join(df, "term").select("item", "term", (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("score"))
    whole = scored.groupBy("item").agg(F.sum("score").alias("whole"))
    return scored.join(whole, "item").select("item", "term", (F.col("score") / F.col("whole")).alias("impact"))


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words."""
    w = words.view(np.uint64)
    out = np.zeros(max(0, len(w) - n + 1), np.uint64)
    for k in range(n):
        out = (out ^ w[k : len(w) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Index:
    """A shard of the inverted index; items are numbered 0, 1, ..."""

    def __init__(self, item: np.ndarray, term: np.ndarray, impact: np.ndarray, parts: list[tuple], threshold: float):
        order = np.lexsort((item, term))
        item, term, impact = item[order], term[order], impact[order]
        self.threshold = threshold - 1e-9
        self.terms, self.start = np.unique(term, return_index=True)
        self.end = np.append(self.start[1:], len(term))
        self.item, self.impact = item, impact
        self.most = np.maximum.reduceat(impact, self.start) if len(term) else np.zeros(0)
        self.blocks = [
            (item[np.minimum(np.arange(s, e, BLOCK) + BLOCK, e) - 1], np.maximum.reduceat(impact[s:e], np.arange(0, e - s, BLOCK)))
            for s, e in zip(self.start, self.end, strict=True)
        ]
        self.ids = [p[0] for p in parts]
        self.verify = [tuple(self._wanted(np.asarray(x, np.int64)) for x in p[1:]) for p in parts]
        self.side = self._minor()

    @staticmethod
    def _wanted(words: np.ndarray) -> tuple[int, set[int]]:
        n = min(GRAM, len(words))
        return n, set(_grams(words, n).tolist()) if n else set()

    def _minor(self) -> np.ndarray:
        """Mark terms as minor, those with the longest postings first, as long as they cannot sum up to
        half the threshold in any item; returns what they sum up to in each item."""
        room = np.zeros(int(self.item.max(initial=-1)) + 1)
        self.major = np.ones(len(self.terms), bool)
        for t in np.argsort(self.start - self.end, kind="stable"):
            at = slice(self.start[t], self.end[t])
            grown = room[self.item[at]] + self.impact[at]
            if grown.max() <= self.threshold / 2:
                room[self.item[at]] = grown
                self.major[t] = False
        return room

    def search(self, terms: np.ndarray) -> list[int]:
        """All items that the distinct ``terms`` (places in ``self.terms``) score from the threshold on."""
        item, impact, out = self.item, self.impact, []
        # a cursor: [current item, place, end, term]
        cursors = [[int(item[self.start[t]]), int(self.start[t]), int(self.end[t]), int(t)] for t in terms]

        def forward(c: list, to: int) -> None:
            c[1] += int(np.searchsorted(item[c[1] : c[2]], to))
            c[0] = int(item[c[1]]) if c[1] < c[2] else -1

        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += self.most[c[3]]
                if bound >= self.threshold:
                    pivot = i
                    break
            if pivot < 0:
                break
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            # the blocks that would hold the pivot's item
            in_block, border = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else None
            for c in cursors[: pivot + 1]:
                last, most = self.blocks[c[3]]
                b = int(np.searchsorted(last, at))
                if b < len(last):
                    in_block += most[b]
                    border = int(last[b]) + 1 if border is None else min(border, int(last[b]) + 1)
            if in_block < self.threshold:
                to = at + 1 if border is None else max(border, at + 1)
                moved = cursors[: pivot + 1]
            elif cursors[0][0] == at:
                score = sum(impact[c[1]] for c in cursors[: pivot + 1])
                if score >= self.threshold:
                    out.append(at)
                to, moved = at + 1, cursors[: pivot + 1]
            else:
                to, moved = at, [c for c in cursors[: pivot + 1] if c[0] < at]
            for c in moved:
                if c[0] < to:
                    forward(c, to)
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def holds(self, words: np.ndarray, item: int, question: float, answer: float) -> bool:
        for (n, wanted), share in zip(self.verify[item], (question, answer), strict=True):
            if wanted:
                there = wanted.intersection(_grams(words, n).tolist())
                if len(there) < share * len(wanted):
                    return False
        return True

    def all_passages(self, flat: np.ndarray, starts: np.ndarray, stride: int) -> Iterator[tuple[int, int]]:
        """:meth:`passages` of the texts, some at a time: as many as have ``CHUNK`` words, one at least."""
        begin = 0
        while begin < len(starts) - 1:
            end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + CHUNK, side="right")) - 1)
            part = flat[starts[begin] : starts[end]]
            for text, block in self.passages(part, starts[begin : end + 1] - starts[begin], stride):
                yield begin + text, block
            begin = end

    def passages(self, flat: np.ndarray, starts: np.ndarray, stride: int) -> list[tuple[int, int]]:
        """``(text, block)`` of the windows, blocks ``block`` and the next, that may reach the threshold.

        A window's bound for an item: its distinct major terms' impacts, and all
        that the minor terms have in the item.
        """
        if not len(self.terms) or not len(flat):
            return []
        place = np.minimum(np.searchsorted(self.terms, flat), len(self.terms) - 1)
        hits = np.flatnonzero((self.terms[place] == flat) & self.major[place])
        if not len(hits):
            return []
        text = np.searchsorted(starts, hits, side="right") - 1
        first = (starts[:-1] // stride) + np.arange(len(starts) - 1)  # blocks of the texts, numbered without overlap
        block = first[text] + (hits - starts[text]) // stride
        earlier = block > first[text]  # the window that begins one block before
        window = np.concatenate([block, block[earlier] - 1])
        term = np.concatenate([place[hits], place[hits][earlier]])
        window, term = np.divmod(np.unique(window * len(self.terms) + term), len(self.terms))
        size = self.end[term] - self.start[term]
        row = np.repeat(np.arange(len(term)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[term], size)
        key, back = np.unique(window[row] * len(self.side) + self.item[at], return_inverse=True)
        total = np.bincount(back, weights=self.impact[at])
        blocks = np.unique(key[total + self.side[key % len(self.side)] >= self.threshold] // len(self.side))
        owner = np.searchsorted(first, blocks, side="right") - 1
        return [(int(t), int(b - first[t])) for t, b in zip(owner, blocks, strict=True)]


@dataclass(frozen=True)
class Benchmark:
    """The index of test items, in shards, and the stride of the passages."""

    shards: tuple[Index, ...]
    stride: int


def build_index(
    items: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = 0.5, max_postings: int = MAX_POSTINGS
) -> Benchmark:
    """Null and empty items have no terms and match nothing; repeated items are items of their own.

    The index goes with the scan to every worker, so its size is bounded: items
    of more than ``MAX_INDEX`` postings or words in all are refused, not cut.
    """
    parts = written(item_parts(items, id_col, text_col), "items")
    size = F.size("question") + F.size("answer")
    longest, total = parts.agg(F.max(size), F.sum(size)).first()
    longest = longest or 1
    index = written(postings(parts), "postings")
    n = index.count()
    if max(n, total or 0) > MAX_INDEX:
        raise ValueError(f"items of {n} postings and {total} words; the bound is {MAX_INDEX}: scan with parts of the items in turn")
    shards = max(1, -(-n // max_postings))
    shard = F.pmod(F.xxhash64("item"), F.lit(shards))
    out = []
    for s in range(shards):
        of = parts.where(shard == s).orderBy("item").toPandas()
        post = index.where(shard == s).toPandas()
        if len(post):
            number = np.searchsorted(of["item"].to_numpy(), post["item"].to_numpy())
            known = list(of[["item_id", "question", "answer"]].itertuples(index=False, name=None))
            out.append(Index(number, post["term"].to_numpy(), post["impact"].to_numpy(), known, threshold))
    return Benchmark(tuple(out), max(longest, GRAM))


def find_items(docs: DataFrame, benchmark: Benchmark, text_col: str = "text", question: float = 0.5, answer: float = 0.5) -> DataFrame:
    """All rows and columns of ``docs``, and ``item_ids``: the items that a text holds, sorted.

    An item is held if one passage scores it from the threshold on and has at
    least ``question`` of the trigrams of its question and ``answer`` of those
    of its answer (shorter parts: of its whole).

    * Null and empty texts hold nothing. Long texts are read whole.
    * Repeated rows get the same items. A column of ``docs`` named ``item_ids``
      is kept; the result then carries underscores in front.
    """
    shards, stride = benchmark.shards, benchmark.stride

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for words in batches:
            starts = words.offsets.to_numpy()
            flat = words.values.to_numpy(zero_copy_only=False)
            out: list[set] = [set() for _ in range(len(words))]
            for index in shards:
                for text, block in index.all_passages(flat, starts, stride):
                    begin = starts[text] + block * stride
                    window = flat[begin : min(begin + 2 * stride, starts[text + 1])]
                    place = np.minimum(np.searchsorted(index.terms, window), len(index.terms) - 1)
                    for item in index.search(np.unique(place[index.terms[place] == window])):
                        if index.holds(window, item, question, answer):
                            out[text].add(index.ids[item])
            yield pa.array([sorted(x, key=lambda i: (i is None, i or 0)) for x in out], pa.list_(pa.int64()))

    find = F.arrow_udf(run, "array<long>")
    return docs.withColumn(fresh(docs, "item_ids"), find(tokens(F.col(text_col))))
