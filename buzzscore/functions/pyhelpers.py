"""Python code that runs inside Spark tasks.

Python does what the JVM has no equal for: Unicode NFC normalisation,
Python-exact lowercasing + accent folding, and counts and matrix products
of whole batches for term statistics and the SVD steps.  Everything here is
self-contained (stdlib, numpy, pandas) and pickled by value, so executors do
not need this package installed.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

try:  # ship this module's functions by value to Python workers
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass


def map_text(f, s: pa.Array) -> pa.Array:
    """``f`` of each string; null stays null."""
    return pa.array((None if x is None else f(x) for x in s.to_pylist()), pa.string())


def nfc_text(x: str) -> str:
    return unicodedata.normalize("NFC", x)


_COMBINING = None


def _combining_table() -> dict:
    """Translation table deleting every code point with a combining class."""
    global _COMBINING
    if _COMBINING is None:
        _COMBINING = {
            cp: None for cp in range(0x300, 0x110000) if unicodedata.combining(chr(cp))
        }
    return _COMBINING


#: Runs of characters that may have a combining class: none below U+0300 has one.
_MAY_COMBINE = re.compile("[^\x00-\u02ff]+")
#: The marks of Latin, Greek and Cyrillic letters: all of the block but U+034F have a combining class.
_COMMON_MARKS = re.compile("[\u0300-\u034e\u0350-\u036f]+")


def fold_text(x: str) -> str:
    """Lowercase, then decompose (NFKD) and drop combining marks."""
    low = x.lower()
    if low.isascii():
        return low
    table = _combining_table()
    rest = _COMMON_MARKS.sub("", unicodedata.normalize("NFKD", low))
    return _MAY_COMBINE.sub(lambda m: m.group().translate(table), rest)


def _found(text: str, stop: frozenset, bigrams: bool) -> Counter:
    """Terms of tokens joined by blanks: those that are no stop words, and their bigrams."""
    kept = [t for t in text.split(" ") if t not in stop] if text else []
    found = Counter(kept)
    if bigrams:
        found.update([f"{a} {b}" for a, b in zip(kept, kept[1:])])
    return found


def count_terms(stop_words: tuple[str, ...], bigrams: bool, only: list[str] | None = None):
    """Arrow UDF: tokens joined by blanks -> the sorted distinct terms of each row and their counts."""
    if only is not None:
        return _count_known(stop_words, bigrams, only)
    stop = frozenset(stop_words)

    def run(tokens: pa.Array) -> pa.Array:
        terms, counts, ends = [], [], [0]
        for text in tokens.to_pylist():
            found = _found(text, stop, bigrams)
            order = sorted(found)
            terms += order
            counts += map(found.__getitem__, order)
            ends.append(len(terms))
        entries = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["term", "tf"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)

    return run


def _release() -> None:
    """Gives back what Arrow has freed: a worker is kept for later tasks, beside those of other functions."""
    pa.default_memory_pool().release_unused()


def _pieces(tokens: pa.Array, most: int = 1 << 20):
    """Tokens joined by blanks, a row a post -> ``(begin, end, rows, flat)``: some posts' tokens and the row of each.

    Pieces have some ``most`` bytes, or a post; one without tokens has an empty one.
    """
    tokens = pc.fill_null(tokens, "")
    ends = np.cumsum(pc.binary_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(tokens):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
        lists = pc.split_pattern(tokens.slice(begin, end - begin), " ")
        yield begin, end, np.repeat(np.arange(begin, end), np.diff(lists.offsets.to_numpy())), lists.flatten()
        begin = end


def _kept_tokens(tokens: pa.Array, stop_words: tuple[str, ...], most: int = 1 << 20):
    """Tokens joined by blanks, a row a post -> ``(begin, end, rows, codes, words)`` of some posts at a time.

    Each token that is no stop word has its row and its code, the place of its word in ``words``.
    """
    stop = pa.array([*stop_words, ""], pa.string())
    for begin, end, rows, flat in _pieces(tokens, most):
        coded = flat.dictionary_encode()
        codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        kept = ~pc.is_in(words, value_set=stop).to_numpy(zero_copy_only=False)[codes]
        yield begin, end, rows[kept], codes[kept].astype(np.int64), words


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, in order, and how often each comes."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def _places(values: pa.Array, among: pa.Array) -> np.ndarray:
    """The place of each value among others, -1 if it is not there."""
    return pc.fill_null(pc.index_in(values, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _count_known(stop_words: tuple[str, ...], bigrams: bool, only: list[str]):
    """``count_terms`` of a vocabulary: tokens are looked up as numbers, a batch at a time."""
    known = sorted(set(only))
    parts = [t.split(" ") for t in known]
    single = [i for i, p in enumerate(parts) if len(p) == 1]
    double = [i for i, p in enumerate(parts) if len(p) == 2 and bigrams]
    # words of the vocabulary's terms, and what follows from a word, or a pair of words, being a term
    left_out = {*stop_words, ""}
    names = sorted({w for i in single + double for w in parts[i]} - left_out)
    single = [i for i in single if parts[i][0] not in left_out]
    double = [i for i in double if not left_out.intersection(parts[i])]
    at = {w: k for k, w in enumerate(names)}
    term_of_word = np.full(len(names) + 1, -1)  # the last place is that of unknown words, at -1
    term_of_word[[at[parts[i][0]] for i in single]] = single
    pairs = np.array([at[parts[i][0]] * len(names) + at[parts[i][1]] for i in double], np.int64)
    term_of_pair = np.array(double + [-1], np.int64)

    def run(tokens: pa.Array) -> pa.Array:
        vocabulary, pair_set = pa.array(known, pa.string()), pa.array(pairs)
        word_set = pa.array([*names, *sorted(left_out)], pa.string())
        found, counts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for begin, end, rows, flat in _pieces(tokens):
            ids = _places(flat, word_set)
            kept = ids < len(names)
            rows, ids = rows[kept] - begin, ids[kept]
            terms = term_of_word[ids]
            keys = (rows * len(known) + terms)[terms >= 0]
            if len(pairs):
                both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (rows[:-1] == rows[1:]))
                terms = term_of_pair[_places(pa.array(ids[both] * len(names) + ids[both + 1]), pair_set)]
                keys = np.concatenate([keys, (rows[both] * len(known) + terms)[terms >= 0]])
            keys, n = _runs(keys)
            found.append(keys % max(1, len(known)))
            counts.append(n)
            sizes.append(np.bincount(keys // max(1, len(known)), minlength=end - begin))
        entries = pa.StructArray.from_arrays([vocabulary.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(counts))], ["term", "tf"])
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        _release()
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries)

    return run


def combine_terms(stop_words: tuple[str, ...], bigrams: bool, most: int):
    """``mapInArrow`` function: tokens joined by blanks, a row a post -> ``(term, df, cf)``, added up.

    The sums of some ``most`` terms are held; then they are given out and begun anew.
    """
    stop, piece = frozenset(stop_words), 1 << 16

    def run(batches):
        df, cf = Counter(), Counter()

        def out():
            terms = list(cf)
            for s in range(0, len(terms), piece):
                some = terms[s : s + piece]
                columns = [some, [df[t] for t in some], [cf[t] for t in some]]
                kinds = (pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["term", "df", "cf"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = _found(text, stop, bigrams)
                cf.update(found)
                df.update(found.keys())
                if len(cf) > most:
                    yield from out()
                    df, cf = Counter(), Counter()
        yield from out()

    return run


def _buckets(rows: np.ndarray, codes: np.ndarray, words: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of tokens that another of their row follows, and the bucket of each such pair, one of 2^bits.

    A pair of words has the same bucket in every task.
    """
    first = np.flatnonzero(rows[:-1] == rows[1:])
    hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    mixed = hashes[codes[first]] * np.uint64(0x9E3779B97F4A7C15) + hashes[codes[first + 1]]
    return first, ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)


_TERM_COUNTS = pa.schema([("term", pa.string()), ("df", pa.int64()), ("cf", pa.int64())])


def _added_up(tables, most: int):
    """``term, df, cf`` tables -> the same with each term once, or again after some ``most`` terms."""
    held, new = _TERM_COUNTS.empty_table(), []

    def summed():
        sums = pa.concat_tables([held, *new]).group_by("term", use_threads=False).aggregate([("df", "sum"), ("cf", "sum")])
        return sums.rename_columns(["term", "df", "cf"]).cast(_TERM_COUNTS).combine_chunks()

    for table in tables:
        new.append(table)
        if sum(t.num_rows for t in new) > most:
            held, new = summed(), []
            if held.num_rows > most:
                yield held
                held = _TERM_COUNTS.empty_table()
            _release()
    yield summed()


def word_and_bucket_counts(stop_words: tuple[str, ...], bigrams: bool, most: int, bits: int):
    """``mapInArrow`` function: tokens joined by blanks, a row a post -> ``(term, bucket, df, cf)``.

    Single words come as terms, with a null bucket, added up as by ``combine_terms``.  Bigrams
    are only counted by buckets: a bucket's ``cf`` is that of all its bigrams together.
    """

    def run(batches):
        buckets = np.zeros(1 << bits, np.int64)

        def tables():
            for batch in batches:
                for begin, _, rows, codes, words in _kept_tokens(batch.column(0), stop_words):
                    distinct, _ = _runs((rows - begin) * len(words) + codes)
                    df, cf = np.bincount(distinct % len(words), minlength=len(words)), np.bincount(codes, minlength=len(words))
                    if bigrams:
                        _, at = _buckets(rows, codes, words, bits)
                        np.add.at(buckets, at, 1)
                    there = pa.array(cf > 0)
                    yield pa.table([words.filter(there), pa.array(df).filter(there), pa.array(cf).filter(there)], schema=_TERM_COUNTS)

        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
        batch_of = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip(columns, kinds)], ["term", "bucket", "df", "cf"])
        for table in _added_up(tables(), most):
            for b in table.to_batches(1 << 16):
                yield batch_of(b.column(0), pa.nulls(len(b), pa.int32()), b.column(1), b.column(2))
        at = np.flatnonzero(buckets)
        for s in range(0, len(at), 1 << 16):
            some = at[s : s + (1 << 16)]
            yield batch_of(pa.nulls(len(some), pa.string()), some.astype(np.int32), np.zeros(len(some), np.int64), buckets[some])
        _release()

    return run


def bigram_counts(stop_words: tuple[str, ...], most: int, bits: int, wanted: bytes):
    """``mapInArrow`` function: tokens joined by blanks, a row a post -> ``(term, df, cf)`` of bigrams.

    Only bigrams of the buckets whose bit is set in ``wanted`` are counted, all of these exactly.
    """

    def run(batches):
        want = np.unpackbits(np.frombuffer(wanted, np.uint8), count=1 << bits).astype(bool)

        def tables():
            for batch in batches:
                for begin, _, rows, codes, words in _kept_tokens(batch.column(0), stop_words):
                    first, at = _buckets(rows, codes, words, bits)
                    first = first[want[at]]
                    pairs, places = np.unique(codes[first] * len(words) + codes[first + 1], return_inverse=True)
                    distinct, n = _runs((rows[first] - begin) * len(pairs) + places)
                    df = np.bincount(distinct % max(1, len(pairs)), minlength=len(pairs))
                    terms = pc.binary_join_element_wise(words.take(pa.array(pairs // len(words))), words.take(pa.array(pairs % len(words))), " ")
                    yield pa.table([terms, pa.array(df), pa.array(np.bincount(places, minlength=len(pairs)))], schema=_TERM_COUNTS)

        for table in _added_up(tables(), most):
            yield from table.to_batches(1 << 16)
        _release()

    return run


def _sparse_rows(terms: pa.Array, vocabulary: pa.Array, idf: np.ndarray):
    """``(row, id, weight)`` of the vocabulary terms in a list array of (term, tf), rows of length 1."""
    offsets = terms.offsets.to_numpy()
    flat = terms.values.slice(offsets[0], offsets[-1] - offsets[0])
    ids = pc.fill_null(pc.index_in(flat.field("term"), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(terms)), np.diff(offsets))
    known = ids >= 0
    rows, ids = rows[known], ids[known]
    w = flat.field("tf").to_numpy(zero_copy_only=False)[known] * idf[ids]
    norm = np.sqrt(np.bincount(rows, w * w, minlength=len(terms)))
    return rows, ids, w / norm[rows]


def weigh_terms(vocabulary: list[str], idf: np.ndarray):
    """Arrow UDF: ``terms`` -> the normalised TF-IDF row as term ids and weights."""

    def run(terms: pa.Array) -> pa.Array:
        rows, ids, x = _sparse_rows(terms, pa.array(vocabulary, pa.string()), idf)
        ends = np.cumsum(np.bincount(rows, minlength=len(terms)))
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (ids.astype(np.int32), x)]
        return pa.StructArray.from_arrays(lists, ["term_ids", "weights"])

    return run


def project_terms(vocabulary: list[str], idf: np.ndarray, components: np.ndarray):
    """Arrow UDF: ``terms`` -> the normalised TF-IDF row times V; zeros without a vocabulary term."""
    components = np.ascontiguousarray(components)

    def run(terms: pa.Array) -> pa.Array:
        rows, ids, x = _sparse_rows(terms, pa.array(vocabulary, pa.string()), idf)
        out = _rows_times(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(terms)))]), ids, x, components)
        offsets = pa.array((np.arange(len(terms) + 1) * out.shape[1]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return run


def gram_partials(n_terms: int, block: int = 512):
    """``mapInArrow`` function that sums ``x xᵀ`` over documents.

    Rows carry ``term_ids`` and ``weights`` (already L2-normalised).  A block of
    rows becomes one dense matrix and one matrix product; a task holds that
    and the sum, and emits the non-zero cells of the upper triangle as
    ``(i, j, g)`` rows.
    """

    def run(batches):
        gram, seen = np.zeros((n_terms, n_terms)), False
        for batch in batches:
            lists = batch.column(0)
            offsets = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False)
            weights = batch.column(1).values.to_numpy(zero_copy_only=False)
            for s in range(0, len(lists), block):
                e = min(s + block, len(lists))
                at = slice(offsets[s], offsets[e])
                x = np.zeros((e - s, n_terms))
                x[np.repeat(np.arange(e - s), np.diff(offsets[s : e + 1])), ids[at]] = weights[at]
                gram += x.T @ x
                seen = True
        if not seen:
            return
        iu, ju = np.triu_indices(n_terms)
        g = gram[iu, ju]
        keep = g != 0.0
        yield pa.RecordBatch.from_pydict(
            {"i": iu[keep].astype(np.int32), "j": ju[keep].astype(np.int32), "g": g[keep]}
        )

    return run


def frequent_items(capacity: int):
    """``mapInArrow`` function: lists of ``(term, tf)`` -> the task's frequent terms ``(term, n)``.

    At most ``capacity`` counters are kept.  The row with a null term has what
    was taken off every counter, at most: no count is too small by more.
    """
    kind = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def run(batches):
        held, off = kind.empty_table(), 0
        for batch in batches:
            for begin in range(0, len(batch), 256):  # lists are long, so that a whole batch is not copied
                flat = pc.list_flatten(batch.column(0).slice(begin, 256))
                n = pc.cast(flat.field("tf"), pa.int64())
                held = pa.concat_tables([held, pa.Table.from_arrays([flat.field("term"), n], schema=kind)])
                if held.num_rows > 4 * capacity:
                    held, cut = trim(held)
                    off += cut
        held, cut = trim(held)
        off += cut
        yield from held.to_batches()
        yield pa.RecordBatch.from_pydict({"term": [None], "n": [off]}, kind)

    def trim(table):
        sums = table.group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"])
        if sums.num_rows <= capacity:
            return sums.cast(kind), 0
        n = sums.column("n").to_numpy()
        cut = int(np.partition(n, len(n) - capacity - 1)[len(n) - capacity - 1])  # the one after the largest
        keep = n > cut
        left = pa.Table.from_arrays([sums.column("term").filter(pa.array(keep)), pa.array(n[keep] - cut)], schema=kind)
        return left, cut

    return run


def probe_filters(bits: int, probes: int = 7):
    """Cogrouped ``applyInArrow`` function: a partition's keys ``_p, _h1, _h2`` and its Bloom filter ``_p, bits``.

    Gives the keys whose bits were all set before, with null ``bits``, and the
    filter with all keys added, with null hashes.  ``bits`` is a power of two.
    """

    def run(keys: pa.Table, filters: pa.Table) -> pa.Table:
        part = (keys if keys.num_rows else filters).column("_p")[0].as_py()
        words = np.zeros(bits // 8, np.uint8)
        if filters.num_rows:
            words = np.frombuffer(filters.column("bits")[0].as_py(), np.uint8).copy()
        h1 = keys.column("_h1").to_numpy().view(np.uint64)
        h2 = keys.column("_h2").to_numpy().view(np.uint64) | np.uint64(1)
        at = (h1[:, None] + np.arange(probes, dtype=np.uint64) * h2[:, None]) & np.uint64(bits - 1)
        byte, mask = (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
        seen = ((words[byte] & mask) != 0).all(axis=1)
        np.bitwise_or.at(words, byte.ravel(), mask.ravel())
        n = int(seen.sum())
        return pa.table(
            {
                "_p": pa.array([part] * (n + 1), pa.int32()),
                "_h1": pa.array([*h1[seen].view(np.int64).tolist(), None], pa.int64()),
                "_h2": pa.array([*keys.column("_h2").to_numpy()[seen].tolist(), None], pa.int64()),
                "bits": pa.array([None] * n + [words.tobytes()], pa.binary()),
            }
        )

    return run


#: Entries of sparse rows that are packed as one, at most if there are several.
PACKED = 1024


def pack_rows():
    """``mapInArrow`` function: sparse rows ``term_ids, weights`` -> ``(sizes, ids, weights)``, some rows as one.

    A pass over numbers as bytes costs the JVM next to nothing, over lists more than the products themselves.
    """

    def run(batches):
        for batch in batches:
            lists, out = batch.column(0), ([], [], [])
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy(zero_copy_only=False)
            weights = batch.column(1).values.to_numpy(zero_copy_only=False)
            shift = batch.column(1).offsets[0].as_py() - offsets[0] if len(lists) else 0
            s = 0
            while s < len(lists):
                e = max(s + 1, int(np.searchsorted(offsets, offsets[s] + PACKED, "right")) - 1)
                at = slice(offsets[s], offsets[e])
                numbers = np.diff(offsets[s : e + 1]).astype(np.int32), ids[at].astype(np.int32), weights[at.start + shift : at.stop + shift]
                for column, x in zip(out, numbers):
                    column.append(x.tobytes())
                s = e
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.binary()) for column in out], ["sizes", "ids", "weights"])
            _release()

    return run


def _sparse_blocks(batches, most_rows: int, most: int):
    """Packed rows -> ``(ends, ids, weights)`` blocks of some rows, and some entries, at most."""
    held, n, size = [], 0, 0

    def block():
        sizes, ids, weights = (np.concatenate(x) for x in zip(*held))
        return np.concatenate([[0], np.cumsum(sizes)]), ids, weights

    for batch in batches:
        for row in zip(*batch.columns):
            held.append([np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, (np.int32, np.int32, np.float64))])
            n, size = n + len(held[-1][0]), size + len(held[-1][1])
            if n >= most_rows or size >= most:
                yield block()
                held, n, size = [], 0, 0
    if n:
        yield block()


def _rows_times(ends: np.ndarray, ids: np.ndarray, weights: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense matrix: a product of a row's weights and its terms' rows of V at a time."""
    out = np.zeros((len(ends) - 1, v.shape[1]))
    for i, (s, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        if e > s:
            np.dot(weights[s:e], v.take(ids[s:e], axis=0), out=out[i])
    return out


def range_step(v):
    """``mapInArrow`` function: packed sparse rows -> ``xᵀ(xv)`` summed over the task's rows, a row per term.

    ``v`` is a broadcast matrix.  It goes by its columns: what is gathered of one stays in the cache.
    """

    def run(batches):
        columns = np.ascontiguousarray(v.value.T)
        total, seen = np.zeros(columns.shape), np.zeros(columns.shape[1], bool)
        for ends, ids, weights in _sparse_blocks(batches, 1 << 16, 200_000):
            if not len(ids):
                continue
            sizes = np.diff(ends)
            begin, sizes = ends[:-1][sizes > 0], sizes[sizes > 0]
            rows, ids = np.repeat(np.arange(len(sizes)), sizes), ids.astype(np.intp)
            seen[ids] = True
            products = np.empty(len(ids))
            for column, out in zip(columns, total):  # "clip" writes to ``out`` at once; no place is out of range
                column.take(ids, out=products, mode="clip")
                products *= weights
                np.add.reduceat(products, begin).take(rows, out=products, mode="clip")
                products *= weights
                out += np.bincount(ids, products, minlength=len(out))
        at = np.flatnonzero(seen)
        sums = [pa.array(at.astype(np.int32)), *(pa.array(column[at]) for column in total)]
        yield pa.RecordBatch.from_arrays(sums, ["term_id", *(f"c{c}" for c in range(len(total)))])
        _release()

    return run


def triangle_of_rows(k):
    """``mapInArrow`` function: packed sparse rows -> the triangle R of the QR decomposition of their product with K.

    ``k`` is a broadcast matrix.
    """

    def run(batches):
        from pyspark import TaskContext

        m = k.value
        r, seen = np.zeros((0, m.shape[1])), False
        for ends, ids, weights in _sparse_blocks(batches, 2048, 1_000_000):
            if len(ids):
                r, seen = np.linalg.qr(np.vstack([r, _rows_times(ends, ids, weights, m)]), mode="r"), True
        if seen:
            square = np.zeros((m.shape[1], m.shape[1]))
            square[: len(r)] = r
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([square.ravel()])], ["part", "r"])
        _release()

    return run


def triangle_of_triangles(width: int):
    """``applyInPandas`` function: the triangles of a group -> theirs together."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        r = np.linalg.qr(np.vstack([np.asarray(x).reshape(width, width) for x in pdf["r"]]), mode="r")
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "r": [r.ravel()]})

    return run


def moment_partials(n_cols: int, viral_weights: list[float]):
    """``mapInPandas`` function: per task, the count, mean vector and centred
    co-moment matrix of the ``n_cols`` input columns (merged across Arrow
    batches with the pairwise update), plus min/max of the viral score
    (a weighted sum of the last columns).  Emits one row per task."""

    def run(batches):
        n = 0
        mean = np.zeros(n_cols)
        m2 = np.zeros((n_cols, n_cols))
        vmin, vmax = np.inf, -np.inf
        w = np.asarray(viral_weights, dtype=np.float64)
        for pdf in batches:
            if pdf.empty:
                continue
            x = pdf.to_numpy(dtype=np.float64)
            nb = x.shape[0]
            mb = x.mean(axis=0)
            d = x - mb
            m2b = d.T @ d
            viral = x[:, n_cols - len(w):] @ w
            vmin = min(vmin, float(viral.min()))
            vmax = max(vmax, float(viral.max()))
            delta = mb - mean
            tot = n + nb
            m2 = m2 + m2b + np.outer(delta, delta) * (n * nb / tot)
            mean = mean + delta * (nb / tot)
            n = tot
        if n:
            yield pd.DataFrame(
                {
                    "n": [n],
                    "mean": [mean.tolist()],
                    "m2": [m2.ravel().tolist()],
                    "vmin": [vmin],
                    "vmax": [vmax],
                }
            )

    return run


def merge_moments(parts, n_cols: int):
    """Merge per-task (n, mean, m2) partials; returns (n, mean, m2)."""
    n = 0
    mean = np.zeros(n_cols)
    m2 = np.zeros((n_cols, n_cols))
    for pn, pmean, pm2 in parts:
        pmean = np.asarray(pmean, dtype=np.float64)
        pm2 = np.asarray(pm2, dtype=np.float64).reshape(n_cols, n_cols)
        delta = pmean - mean
        tot = n + pn
        m2 = m2 + pm2 + np.outer(delta, delta) * (n * pn / tot)
        mean = mean + delta * (pn / tot)
        n = tot
    return n, mean, m2


def merge_partials(n_cols: int):
    """``applyInPandas`` function: the moments of a group of tasks as one row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        n, mean, m2 = merge_moments(zip(pdf["n"], pdf["mean"], pdf["m2"]), n_cols)
        return pd.DataFrame(
            {
                "n": [n],
                "mean": [mean.tolist()],
                "m2": [m2.ravel().tolist()],
                "vmin": [pdf["vmin"].min()],
                "vmax": [pdf["vmax"].max()],
            }
        )

    return run
