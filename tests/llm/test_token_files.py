"""Token files: ids against the tokenizer on whole texts, round trips of the coder, damage."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from buzzscore.llm import range_coder as R
from buzzscore.llm import token_files as T
from buzzscore.llm.common import scratch

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def brute(rows):
    """Rows in order -> document, start, number of ids, checksum."""
    from tokenizers import Tokenizer

    tokenizer, out, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


TEXTS = ["", None, "!", "Hello world.\n\n  Two  blanks \t and more \x1c x\x1b\n", "<|endoftext|> a  <|endoftext|>b", "ünï çödé 漢字 " * 900, "it's we'll  'quoted'", "a" * 20_000, " ", "\n", "word " * 9000]


@pytest.mark.parametrize("block, lanes", [(4096, 2048), (50, 3)])
def test_files_have_the_tokenizers_ids(spark, make, monkeypatch, block, lanes):
    monkeypatch.setattr(T, "BLOCK", block)
    monkeypatch.setattr(T, "LANES", lanes)
    rows = [(i * 7 - 9, t) for i, t in enumerate(TEXTS + TEXTS[3:6])]
    r = random.Random(1)
    shuffled = r.sample(rows, len(rows))
    df = make([t for _, t in shuffled], [i for i, _ in shuffled])
    path = scratch(spark, "tokens")
    T.write_tokens(df, path, PATH)
    got = sorted(tuple(x) for x in T.read_tokens(spark, path).collect())
    assert got == brute(rows)


def test_null_ids_and_repeated_rows(spark, make):
    rows = [(None, "no id"), (5, "tie"), (5, "tie"), (6, "six")]
    path = scratch(spark, "tokens")
    T.write_tokens(make([t for _, t in rows], [i for i, _ in rows]), path, PATH)
    got = sorted((tuple(x) for x in T.read_tokens(spark, path).collect()), key=lambda x: x[1])
    assert got == brute(rows)


def test_empty_table(spark, make):
    path = scratch(spark, "tokens")
    T.write_tokens(make([]), path, PATH)
    assert T.read_tokens(spark, path).count() == 0


def test_a_damaged_block_is_an_error(spark, make):
    path = scratch(spark, "tokens")
    T.write_tokens(make(["some words of a text " * 50]), path, PATH)
    lines = [x[0] for x in spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary")).collect()]
    block = T.unescape(bytes(lines[0]))
    assert [p[2] for p in T.read_blocks([block])] == [0]
    for at in (0, 10, len(block) // 2, len(block) - 1):
        with pytest.raises(ValueError):
            list(T.read_blocks([block[:at] + bytes([block[at] ^ 4]) + block[at + 1 :]]))
    assert T.unescape(T.escape(bytes(range(256)) * 3 + b"\x1b\x01\n\x1b\x02")) == bytes(range(256)) * 3 + b"\x1b\x01\n\x1b\x02"


@pytest.mark.parametrize("shape, top", [((3, 1), 2), ((5, 700), 50_000), ((2, 300), 3), ((1, 17), 1 << 24), ((4, 600), 1), ((7, 900), 100_000), ((2, 0), 1)])
def test_coder_round_trip(shape, top):
    ids = np.random.default_rng(top).integers(0, top, shape)
    assert (R.decode(R.encode(ids), shape[1], int(ids.max(initial=0))) == ids).all()


def test_coder_learns():
    """Repeated runs cost little, and less than their order-0 entropy; blocks do not depend on each other."""
    r = np.random.default_rng(3)
    run = r.integers(0, 50_000, 200)
    ids = np.tile(run, (2, 20))[:, :4000]
    coded = R.encode(ids)
    assert 8 * len(coded[0]) / ids.shape[1] < 2.5 and R.encode(ids[1:])[0] == coded[1]


@pytest.mark.parametrize("placed", [1, 3, 7])
def test_few_lanes_are_looked_up_at_a_time(monkeypatch, placed):
    ids = np.random.default_rng(placed).integers(0, 300, (7, 500))
    coded = R.encode(ids)
    monkeypatch.setattr(R, "PLACED", placed)
    assert R.encode(ids) == coded and (R.decode(coded, 500, 299) == ids).all()


def test_units_are_exact():
    known = T.Tokens(PATH)
    assert known.by_units
    r = random.Random(5)
    texts = ["".join(r.choice([" ", "  ", "a", "B1", "'s", "é", "\n", "\t", "　", "\x1c", "\x85", ".", "漢", "👩‍👩", "|>"]) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    whole = known.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in known.ids(texts)] == [e.ids for e in whole]


def test_joined_crc():
    a, b = b"some bytes", bytes(1000) + b"others"
    assert T.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b), T.crc_shifts()) == zlib.crc32(a + b)
    assert T.joined_crc(zlib.crc32(a), zlib.crc32(b""), 0, T.crc_shifts()) == zlib.crc32(a)


def test_few_units_are_encoded_at_a_time(monkeypatch):
    known = T.Tokens(PATH)
    whole, sizes, encode = known._encode(["a1 b2 c3 d4 e5", "f6 a1"]), [], known._encode
    monkeypatch.setattr(T, "ENCODED", 2)
    monkeypatch.setattr(known, "_encode", lambda texts: sizes.append(len(texts)) or encode(texts))
    assert list(known.ids(["a1 b2 c3 d4 e5", "f6 a1"])) == whole
    assert max(sizes) == 2 and len(sizes) >= 3


class Counted:
    """A tokenizer that notes how many texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch(self, texts, **more):
        self.texts += len(texts)
        return self.tokenizer.encode_batch(texts, **more)


def test_new_units_are_one_text(monkeypatch):
    known, r = T.Tokens(PATH), random.Random(8)
    signs = [" ", "  ", "a", "B1", "'s", "é", "\n", "\t", "　", "\x1c", "\x85", ".", "漢", "👩‍👩", "|>", "<|endof"]
    texts = [" x" + "".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    whole = known.tokenizer.encode_batch(texts, add_special_tokens=False)
    monkeypatch.setattr(known, "tokenizer", Counted(known.tokenizer))
    assert [np.frombuffer(x, "<u4").tolist() for x in known.ids(texts)] == [e.ids for e in whole]
    assert known.tokenizer.texts < len(known.kept) // 100
    # bytes that cannot be told apart: each unit by itself
    known.kept.clear()
    known.sizes[:] = 3
    assert [np.frombuffer(x, "<u4").tolist() for x in known.ids(texts)] == [e.ids for e in whole]


def test_units_in_use_are_kept(monkeypatch):
    known = T.Tokens(PATH)
    monkeypatch.setattr(T, "KEPT", 9)
    for k in range(6):
        list(known.ids([f"a b c{k}1 d{k}2"]))
        assert len(known.kept) <= 9 + 4
    assert {"a", " b"} <= known.kept.keys()
    monkeypatch.setattr(known, "tokenizer", Counted(known.tokenizer))
    list(known.ids(["a b"]))
    assert known.tokenizer.texts == 0
    list(known.ids([" ".join(f"e{k}" for k in range(30))]))
    assert not known.kept


def test_words_and_lines_are_units():
    known, r = T.Tokens(PATH), random.Random(9)
    signs = ["\n", "\r\n", "\n\n", " ", " \n", "  ", ". ", "!", ",\n", "?", "7", "Ab", "ré", "Ñ", "Бю", "×", "'s", "“", "\u00a0", "\u2028", "\u3000", "한", "\x1d", "x"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    whole = [e.ids for e in known.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in known.ids(texts)] == whole
    units, at, bounds = T.divided(texts)
    assert ["".join(units[k] for k in at[i:j]) for i, j in zip(bounds, bounds[1:])] == texts
    units, at, _ = T.divided(["One two.\nThree, four!", "", "é."])
    assert [units[k] for k in at] == ["One", " two", ".", "\n", "Three", ",", " four", "!", "é."]


def test_words_go_to_the_model(monkeypatch):
    known = T.Tokens(PATH)
    texts = ["Qwertz  zuiopü,\nasdfgh jklöä; 'yx", "Слово словами.\nÀÿ ɏ"]
    whole = known._alone(texts)
    monkeypatch.setattr(known, "tokenizer", Counted(known.tokenizer))
    assert list(known.ids(texts)) == whole
    assert known.tokenizer.texts <= 4
    seen = known.tokenizer.texts
    assert len(list(known.ids([" ".join(a + b + c for a in "bcdfg" for b in "aeiou" for c in "lmnr")]))) == 1
    assert known.tokenizer.texts == seen


def test_coder_learns_both_orders_at_once():
    """The bytes of the blocks are those of the coder that took the orders one after the other."""
    r = np.random.default_rng(12)
    ids = np.where(r.random((5, 600)) < 0.6, r.integers(0, 40, (5, 600)), r.integers(0, 60_000, (5, 600)))
    assert zlib.crc32(b"".join(R.encode(ids))) == 749386965


def test_plain_units_go_to_the_model_in_pieces(monkeypatch):
    """Words with stops and signs, and numbers, also take no run of the whole tokenizer."""
    known, r = T.Tokens(PATH), random.Random(10)
    signs = ["a", "Bc", "é", "ß", "Ж", "7", "42", ".", ",", "!!", "&&&", "'s", "'", "'ll", "-", "_", "[", "`", "~", "\\", "@"]
    texts = [" " + "".join(r.choice(signs) for _ in range(r.randint(1, 12))) for _ in range(3000)]
    whole = known._alone(texts)
    monkeypatch.setattr(known, "tokenizer", Counted(known.tokenizer))
    assert list(known.ids(texts)) == whole
    assert known.tokenizer.texts == 0


@pytest.mark.parametrize("stride", [1, 7, 1000])
def test_strides_do_not_show(monkeypatch, stride):
    r = np.random.default_rng(stride)
    ids = np.where(r.random((6, 300)) < 0.5, r.integers(0, 30, (6, 300)), r.integers(0, 100_000, (6, 300)))
    coded = R.encode(ids)
    monkeypatch.setattr(R, "STRIDE", stride)
    assert R.encode(ids) == coded and (R.decode(coded, 300, int(ids.max())) == ids).all()


def test_numbers_ascend_by_lane_and_id(monkeypatch):
    monkeypatch.setattr(R, "PLACED", 2)
    assert R._numbered(np.array([[5, 3, 5], [7, 7, 1], [0, 9, 4]])).T.tolist() == [[1, 0, 1], [3, 3, 2], [4, 6, 5]]
