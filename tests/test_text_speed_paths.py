"""The short ways of the text functions give what the definitions say."""

import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from buzzscore.functions import text as T
from buzzscore.functions.pyhelpers import fold_text, map_text

SPACES = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())


def defined(x: str) -> str:
    x = unicodedata.normalize("NFC", x.strip())
    out, before = [], False
    for c in x:
        out.append("" if c.isspace() and before else " " if c.isspace() else c)
        before = c.isspace()
    return "".join(c for c in "".join(out) if c not in T.ZERO_WIDTH).strip()


def test_normalized_as_defined(spark):
    texts = ["", " ", "a b", "a  b", "a \t\n b\r\nc", "ä  b\x85c", "é 　x", "‍ a ‍‌ b ﻿", "\n\n a\n\nb\x1c\x1d"]
    texts += [f"x{a}{b}y" for a in SPACES for b in ("", " ", " ")] + [f"{a}x ü̂{a}" for a in SPACES]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", T.normalize_text(F.col("t")).alias("n")).collect()}
    assert got.pop(-1) is None
    assert got == {i: defined(t) for i, t in enumerate(texts)}


def test_text_below_the_first_combining_mark_is_composed_and_skips_python(spark):
    assert all(unicodedata.is_normalized("NFC", chr(c)) and not unicodedata.combining(chr(c)) for c in range(0x300))
    df = spark.createDataFrame([("straße ü",), ("é",), ("日本",)], "t string")
    assert [r[0] for r in df.select(T.is_composed(F.col("t"))).collect()] == [True, False, False]


def test_folding_drops_all_combining_marks():
    texts = ["ÄÖ ę́x", "İI ﬁ ½", "\U0001e944\U0001d165a", "日本 が"]
    for t in texts:
        want = "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
        assert fold_text(t) == want
    assert map_text(fold_text, pa.array(["É", None])).to_pylist() == ["e", None]


def test_python_workers_get_few_rows_at_a_time(spark):
    from buzzscore.session import ARROW_ROWS, prepare

    prepare(spark)
    sizes = spark.range(0, 3 * ARROW_ROWS, 1, 1).mapInArrow(lambda bs: (b.slice(0, 1).set_column(0, "id", pa.array([len(b)])) for b in bs), "id long")
    assert max(r.id for r in sizes.collect()) <= ARROW_ROWS
