"""Documents as token ids in files of independently coded, checksummed blocks.

A file is a sequence of blocks, each closed by a line break; inside a block the
line break and the escape byte are written as two bytes, so a file can be read
from any split.  A block has a checksum, a header, the documents that have ids
in it, and up to ``BLOCK`` ids coded by :mod:`buzzscore.llm.range_coder`, whose
model starts anew in each.  Nothing but the block is needed to read it.

Documents are written in ascending order of their ids: Spark sorts them into
ranges, and each range becomes a file.  A block has its file's number and the
place of its first id there, so where a document's ids start among all follows
from the sizes of the files before.
"""

from __future__ import annotations

import json
import re
import string
import struct
import sys
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buzzscore.llm.common import written
from buzzscore.llm.range_coder import decode, encode

BLOCK = 4096
#: Blocks that are coded at a time; some 100 MB.
LANES = 2048
END_ID = 0

_HEADER = "<IIqqIII"  # checksum, file, first id, first document, ids, largest id, documents
_PIECE = "<BqqI"  # flags, document id, place of the first id in the document, ids
_NULL_ID, _ENDS = 1, 2


# --- tokens --------------------------------------------------------------------
#: Texts between blanks whose ids are kept in a worker, and the longest of these.
KEPT, KEPT_CHARS = 800_000, 64
#: Units that are encoded at a time.
ENCODED = 4096
_BEGINS, _INK = re.compile(r" \S"), re.compile(r"\S")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ԯ"
#: Units of Latin and Cyrillic letters, ASCII digits and signs only, and the pieces the library's pre-tokenizer makes of them.
_PLAIN = re.compile(f" ?[!-~{_LETTERS}]+")
_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[!-/:-@[-`{{-~]+")
_WORD = re.compile(f" ?[{_LETTERS}]+")
#: The characters that byte-level tokens have for bytes; a line break stays.
_SIGNS = np.arange(256, dtype="<u2")
_SIGNS[[*range(33), *range(127, 161), 173]] = np.arange(256, 324)
_SIGNS[10] = 10


def _marks(*chars: tuple[int, bytes]) -> bytes:
    out = np.zeros(256, np.uint8)
    for mark, some in chars:
        out[list(some)] |= mark
    return out.tobytes()


_BLANK, _LINE, _OPENS, _ALNUM, _STOP, _E2 = 1, 2, 4, 8, 16, 32
# opens: first bytes of characters other than white space; behind the last four there may be some
_MARKS = _marks(
    (_BLANK, b" "),
    (_LINE, b"\n"),
    (_OPENS, bytes(set(range(256)) - set(b"\t\n\v\f\r\x1c\x1d\x1e\x1f \xc2\xe1\xe2\xe3"))),
    (_ALNUM, (string.ascii_letters + string.digits).encode()),
    (_STOP, b".,;:!?"),
    (_E2, b"\xe2"),
)


def divided(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct units of texts; the unit at each place, text after text; and where each text's places begin and end."""
    data = [t.encode() for t in texts]
    bounds = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(d) for d in data], out=bounds[1:])
    joined = b"".join(data)
    if not joined:
        return [], np.zeros(0, np.int32), np.zeros(len(data) + 1, np.int64)
    size = len(joined)
    b, marks = np.frombuffer(joined + b"  ", np.uint8), np.frombuffer(joined.translate(_MARKS) + b"\0", np.uint8)
    opens = (marks[1:] & _OPENS) != 0
    if b"\xe2" in joined:
        at = np.flatnonzero(marks & _E2)
        dash = at[(b[at + 1] == 0x80) & (b[at + 2] >= 0x90) & (b[at + 2] <= 0xA7)]  # and quotes
        opens[dash[dash > 0] - 1] = True
    full = np.flatnonzero(np.diff(bounds))
    opens[bounds[full + 1] - 1] = False  # what follows is in another text
    begins = np.zeros(size + 2, bool)
    marks = marks[:-1]
    line = ((marks & _LINE) != 0) & opens
    begins[:size] = ((marks & _BLANK) != 0) & opens
    begins[:size] |= line
    begins[1 : size + 1] |= line
    begins[bounds[full]] = True
    begins[size:] = True
    # a stop between a word and the next unit is a unit
    stop = ((marks[:-1] & _ALNUM) != 0) & ((marks[1:] & _STOP) != 0)
    stop &= begins[2 : size + 1] & ~begins[1:size]
    begins[1:size] |= stop
    at = np.flatnonzero(begins[: size + 1])
    units = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(joined)).dictionary_encode()
    return units.dictionary.to_numpy(zero_copy_only=False).tolist(), units.indices.to_numpy(), np.searchsorted(at, bounds)


class Tokens:
    """A tokenizer of the ``tokenizers`` library, with the ids of texts between blanks kept.

    A byte-level tokenizer divides a text before every blank, and before and
    after every line break, that a character other than white space follows,
    and between a letter or digit and a stop, whatever stands around.  So the
    ids of a text are those of its units between such places.  Units repeat:
    most are encoded once.  Of the new ones, those of letters,
    digits and signs that are sure go to the library's model in the pieces it
    gets from its pre-tokenizer; the others
    to the library after each other as one text, and the bytes of its ids tell
    them apart.  Texts with an added token, and other tokenizers, are encoded
    whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        form = json.loads(self.tokenizer.to_str())
        before = form.get("pre_tokenizer") or {}
        self.by_units = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and not form.get("normalizer") and not form.get("truncation") and not form.get("padding")
        )
        self.added = [t["content"] for t in form.get("added_tokens", [])]
        # an added token with white space might reach from one unit into the next
        self.joins = self.by_units and not any(re.search(r"\s", a) for a in self.added)
        self.kept: dict[str, bytes] = {}
        # a byte-level token has a character for each of its bytes
        vocab = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        self.sizes[list(vocab.values())] = [len(t) for t in vocab]

    def _alone(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_units:
            return self._alone(texts)
        done = self._modelled(list(filter(_PLAIN.fullmatch, texts)))
        if self.joins:  # a line break between texts is a token of its own
            for begins, between in (_BEGINS, ""), (_INK, "\n"):
                some = [t for t in texts if t not in done and begins.match(t)]
                if len(some) > 1:
                    done.update(zip(some, self._together(some, between), strict=True))
        others = [t for t in texts if t not in done]
        done.update(zip(others, self._alone(others), strict=True))
        return list(map(done.__getitem__, texts))

    def _modelled(self, texts: list[str]) -> dict[str, bytes]:
        """The ids of plain texts by the library's model, which gets the pieces that its pre-tokenizer would make."""
        if not texts:
            return {}
        pieces = {t: _PARTS.findall(t) for t in texts if not _WORD.fullmatch(t)}
        words = dict.fromkeys(texts)
        if pieces:
            words = dict.fromkeys([t for t in texts if t not in pieces] + [p for some in pieces.values() for p in some])
        words = list(words)
        signs = _SIGNS.take(np.frombuffer("\n".join(words).encode(), np.uint8)).tobytes().decode("utf-16-le")
        tokenize = self.model.tokenize
        found = [[x.id for x in tokenize(token)] for token in signs.split("\n")]
        data = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        ends = list(accumulate([4 * len(x) for x in found], initial=0))
        done = dict(zip(words, [data[i:j] for i, j in pairwise(ends)], strict=True))
        done.update({t: b"".join([done[p] for p in some]) for t, some in pieces.items()})
        return done

    def _together(self, texts: list[str], between: str) -> list[bytes]:
        data = self._alone([between.join(texts)])[0]
        upto = np.append(0, np.cumsum(self.sizes[np.frombuffer(data, "<u4")]))
        begins = np.cumsum([0] + [len(t.encode()) + len(between) for t in texts])
        ends = begins[1:] - len(between)
        starts, stops = np.searchsorted(upto, begins[:-1]), np.searchsorted(upto, ends)
        if upto[-1] != ends[-1] or (upto[starts] != begins[:-1]).any() or (upto[stops] != ends).any():
            return self._alone(texts)  # some bytes have no token
        return [data[i:j] for i, j in zip((4 * starts).tolist(), (4 * stops).tolist(), strict=True)]

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_units:
            yield from self._encode(texts)
            return
        whole = [any(a in t for a in self.added) for t in texts]
        units, at, bounds = divided(["" if w else t for t, w in zip(texts, whole, strict=True)])
        new = [u for u in units if u not in self.kept]
        for begin in range(0, len(new), ENCODED):  # an encoding takes a hundred times its text until it is ids
            some = new[begin : begin + ENCODED]
            self.kept.update(zip(some, self._encode(some), strict=True))
        found = list(map(self.kept.__getitem__, units))
        ids = np.frombuffer(b"".join(found), "<u4")
        size = np.array([len(x) for x in found], np.int64) // 4
        first, n = (np.cumsum(size) - size)[at], size[at]
        upto = np.cumsum(n)
        ids = ids[np.arange(n.sum()) + np.repeat(first - (upto - n), n)]
        ends = np.append(0, upto)[bounds].tolist()
        for t, w, i, j in zip(texts, whole, ends, ends[1:], strict=False):
            yield self._alone([t])[0] if w else ids[i:j].tobytes()
        if len(self.kept) > KEPT:  # those in use stay, if they are not too many
            self.kept = dict(zip(units, found, strict=True)) if 2 * len(units) < KEPT else {}
        for u in new:
            if len(u) > KEPT_CHARS:
                self.kept.pop(u, None)


def tokens(path: str) -> Tokens:
    """One tokenizer a Python worker, kept from task to task."""
    # functions travel by value, so what they keep has to be in a module of the worker's own
    store = sys.modules.setdefault("_buzzscore_tokens", ModuleType("_buzzscore_tokens")).__dict__
    if path not in store:
        store[path] = Tokens(path)
    return store[path]


# --- blocks --------------------------------------------------------------------
def escape(block: bytes) -> bytes:
    return block.replace(b"\x1b", b"\x1b\x02").replace(b"\n", b"\x1b\x01")


def unescape(line: bytes) -> bytes:
    return line.replace(b"\x1b\x01", b"\n").replace(b"\x1b\x02", b"\x1b")


class Writer:
    """Ids of documents, in order -> blocks."""

    def __init__(self, file: int):
        self.file, self.first, self.document = file, 0, 0
        self.ids: list[np.ndarray] = []
        self.pieces: list[list] = [[]]  # of each block
        self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        flags, at = _NULL_ID if doc_id is None else 0, 0
        while at < len(ids):
            room = BLOCK - self.waiting % BLOCK
            n = min(room, len(ids) - at)
            ends = _ENDS if at + n == len(ids) else 0
            self.pieces[-1].append((self.document, flags | ends, doc_id or 0, at, n))
            self.waiting += n
            at += n
            if n == room:
                self.pieces.append([])
        self.ids.append(ids)
        self.document += 1

    def blocks(self, all_: bool = False) -> Iterator[bytes]:
        """The blocks that are full, as many as are coded at a time; at the end all."""
        full = self.waiting // BLOCK
        if not (all_ or full >= LANES):
            return
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        for begin in range(0, full, LANES):
            rows = ids[begin * BLOCK : min(begin + LANES, full) * BLOCK].reshape(-1, BLOCK)
            yield from self._coded(rows, self.pieces[begin : begin + len(rows)])
        rest, pieces = ids[full * BLOCK :], self.pieces[full:]
        if all_ and len(rest):
            yield from self._coded(rest[None, :], pieces)
            rest, pieces = rest[:0], [[]]
        self.ids, self.pieces, self.waiting = [rest], pieces, len(rest)

    def _coded(self, rows: np.ndarray, pieces: list[list]) -> Iterator[bytes]:
        for row, coded, parts in zip(rows, encode(rows), pieces, strict=True):
            head = struct.pack(_HEADER, 0, self.file, self.first, parts[0][0], len(row), int(rows.max()), len(parts))[4:]
            block = head + b"".join(struct.pack(_PIECE, *p[1:]) for p in parts) + struct.pack("<I", zlib.crc32(row.astype("<u4").tobytes())) + coded
            yield struct.pack("<I", zlib.crc32(block)) + block
            self.first += len(row)


def read_blocks(blocks: list[bytes]) -> Iterator[tuple]:
    """``(file, document, doc_id, start in the file, place in the document, ends, ids)`` of the pieces of blocks."""
    parsed: dict[tuple[int, int], list] = {}
    for block in blocks:
        if len(block) < struct.calcsize(_HEADER) or zlib.crc32(block[4:]) != struct.unpack_from("<I", block)[0]:
            raise ValueError("a block of token ids is damaged")
        _, file, first, document, n, largest, parts = struct.unpack_from(_HEADER, block)
        at = struct.calcsize(_HEADER) + parts * struct.calcsize(_PIECE)
        parsed.setdefault((n, largest), []).append((file, first, document, parts, *struct.unpack_from("<I", block, at), block[at + 4 :], block))
    for (n, largest), group in parsed.items():
        for begin in range(0, len(group), LANES):
            some = group[begin : begin + LANES]
            for ids, (file, first, document, parts, check, _, block) in zip(decode([g[5] for g in some], n, largest), some, strict=True):
                ids = ids.astype("<u4")
                if zlib.crc32(ids.tobytes()) != check:
                    raise ValueError("the ids of a block are damaged")
                at = 0
                for k in range(parts):
                    flags, doc_id, place, size = struct.unpack_from(_PIECE, block, struct.calcsize(_HEADER) + k * struct.calcsize(_PIECE))
                    yield file, document + k, None if flags & _NULL_ID else doc_id, first + at, place, bool(flags & _ENDS), ids[at : at + size]
                    at += size


# --- checksums of divided documents --------------------------------------------
def _apply(columns: list[int], value: int) -> int:
    out, bit = 0, 0
    while value:
        if value & 1:
            out ^= columns[bit]
        value >>= 1
        bit += 1
    return out


def crc_shifts(powers: int = 48) -> list[list[int]]:
    """What 1, 2, 4 ... zero bytes do to each bit of a CRC-32."""
    columns = []
    for bit in range(32):
        c = 1 << bit
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        columns.append(c)
    out = [columns]
    while len(out) < powers:
        out.append([_apply(out[-1], c) for c in out[-1]])
    return out


def joined_crc(first: int, second: int, length: int, shifts: list[list[int]]) -> int:
    """The CRC-32 of two strings after each other, of theirs and the second one's length."""
    power = 0
    while length:
        if length & 1:
            first = _apply(shifts[power], first)
        length >>= 1
        power += 1
    return first ^ second


# --- files ---------------------------------------------------------------------
def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of ``docs``, each document's followed by id 0, into a new folder at ``path``.

    ``tokenizer`` is the path of a file of the ``tokenizers`` library, the same
    on every machine; no special tokens are added.  Documents go by ``id_col``
    (a whole number), null first, rows of one id by a hash of the text.

    * A null text counts as empty: it has the end id only.
    * Texts are encoded whole, however long, and a document of more than
      ``BLOCK`` ids is in several blocks.
    * Repeated rows are documents of their own.
    * A table without rows gives a folder without blocks.
    * Other columns are not read, so their names do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens(tokenizer)
        writer = Writer(TaskContext.get().partitionId())
        end = np.array([END_ID], "<u4").tobytes()
        out = lambda blocks: pa.RecordBatch.from_pydict({"line": pa.array([escape(b) for b in blocks], pa.binary())})
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            begin = 0
            while begin < len(texts):  # some MB at a time
                stop, size = begin, 0
                while stop < len(texts) and (stop == begin or size + len(texts[stop]) <= 1 << 22):
                    size += len(texts[stop])
                    stop += 1
                for key, ids in zip(keys[begin:stop], known.ids(texts[begin:stop]), strict=True):
                    writer.add(key, np.frombuffer(ids + end, "<u4"))
                begin = stop
                if blocks := list(writer.blocks()):
                    yield out(blocks)
        if blocks := list(writer.blocks(True)):
            yield out(blocks)

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    # the text writer puts out a string's bytes as they are
    ranged.mapInArrow(run, "line binary").select(F.col("line").cast("string")).write.option("lineSep", "\n").text(path)


_PIECES = "file int, document long, doc_id long, start long, place long, ends boolean, n long, crc long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _PIECES.split(", ")]
    for batch in batches:
        blocks = [unescape(b) for b in batch.column(0).to_pylist()]
        rows = [(*p[:-1], len(p[-1]), zlib.crc32(p[-1].tobytes())) for p in read_blocks(blocks)]
        if rows:
            columns = dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))
            columns["file"] = pa.array(columns["file"], pa.int32())
            columns["doc_id"] = pa.array(columns["doc_id"], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)


def _whole_crc(parts: pa.Array) -> pa.Array:
    """The CRC-32 of documents from those of their pieces in order."""
    out, shifts = [], crc_shifts()
    for pieces in parts.to_pylist():
        crc = 0
        for p in pieces:
            crc = joined_crc(crc, p["crc"], 4 * p["n"], shifts)
        out.append(crc)
    return pa.array(out, pa.int64())


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """A row per document of the files at ``path``: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is of
    the ids, the end id too, as little-endian unsigned 32-bit integers.  A
    damaged block is an error.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("line"))
    pieces = written(lines.mapInArrow(_read, _PIECES), "pieces")
    sizes = pieces.groupBy("file").agg(F.sum("n").alias("size"))
    before = F.sum("size").over(Window.orderBy("file")) - F.col("size")
    starts = F.broadcast(sizes.select("file", before.alias("before")))  # a row per file, as many as shuffle partitions
    whole = pieces.where("ends AND place = 0").select("file", "doc_id", "start", "n", "crc")
    divided = pieces.where("NOT (ends AND place = 0)").groupBy("file", "document")
    divided = divided.agg(
        F.first("doc_id").alias("doc_id"),
        F.min("start").alias("start"),
        F.sum("n").alias("n"),
        F.array_sort(F.collect_list(F.struct("place", "n", "crc"))).alias("parts"),
    )
    crc = F.arrow_udf(_whole_crc, "long", F.ArrowUDFType.SCALAR)
    divided = divided.select("file", "doc_id", "start", "n", crc("parts").alias("crc"))
    out = whole.unionByName(divided).join(starts, "file")
    return out.select("doc_id", (F.col("start") + F.col("before")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
