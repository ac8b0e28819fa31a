"""Unicode normalisation, whitespace, tokenisation and accent folding."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from buzzscore.functions.text import (
    fold_accents,
    normalize_text,
    normalize_username,
    spark_stop_words,
    tokenize,
)


def _apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["o"] for r in df.select("i", fn(F.col("s")).alias("o")).orderBy("i").collect()]


def python_reference(text):
    """The cleaning chain written directly in Python."""
    import re

    if text is None:
        return None
    text = unicodedata.normalize("NFC", text.strip())
    text = re.sub(r"\s+", " ", text)
    for ch in ("‍", "‌", "﻿"):
        text = text.replace(ch, "")
    return text.strip()


UNICODE_CASES = [
    "é",  # combining acute -> é
    "a ‍ b",  # zero-width joiner between spaces -> two spaces remain
    "﻿ hello",  # leading BOM + space
    "x  y　　z\u001c\u001dw",  # NBSP, ideographic space, separators
    "\U0001f468‍\U0001f469‍\U0001f467",  # emoji family with ZWJ
    "निफ्टी  सेंसेक्स",  # Devanagari
    "  line one\n\n\tline two  ",
    None,
    "",
]


def test_normalize_text_matches_python(spark):
    got = _apply(spark, UNICODE_CASES, normalize_text)
    assert got == [python_reference(v) for v in UNICODE_CASES]
    assert got[0] == "é"
    assert got[1] == "a  b"
    assert got[7] is None and got[8] == ""


def test_username_strip_and_lower(spark):
    got = _apply(spark, ["  User_7 ", "\tÉCOLE\n", None], normalize_username)
    assert got == ["user_7", "école", None]


def test_fold_accents_matches_python(spark):
    values = ["Café Crème", "ÀÉÎÕÜ", "plain ascii", "straße", None]

    def fold(x):
        if x is None:
            return None
        low = x.lower()
        if low.isascii():
            return low
        return "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))

    assert _apply(spark, values, fold_accents) == [fold(v) for v in values]


def test_tokenize_runs_of_two_word_chars(spark):
    df = spark.createDataFrame([("a bc d_e 12 x9 é-té",)], "s string")
    toks = df.select(tokenize(F.col("s")).alias("t")).first()["t"]
    assert toks == ["bc", "d_e", "12", "x9", "té"]


def test_stop_words_are_sparks_list():
    words = spark_stop_words()
    assert len(words) == 181 and "the" in words and "i" in words


def test_entry_imports_with_pyspark_from_a_zip():
    """PySpark may be loaded from pyspark.zip, where nothing lies on disk."""
    import glob
    import os
    import subprocess
    import sys

    import pyspark

    lib = os.path.join(os.path.dirname(pyspark.__file__), "python", "lib")
    zips = sorted(glob.glob(os.path.join(lib, "*.zip")), key=lambda p: "pyspark" not in p)
    if not zips:
        pytest.skip("this PySpark has no zip")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import pyspark, __spark_entry__ as e; print(pyspark.__file__); print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run(
        [sys.executable, "-c", code],
        env={**os.environ, "PYTHONPATH": ":".join([*zips, root])},
        capture_output=True,
        text=True,
        timeout=120,
    )
    assert out.returncode == 0, out.stderr
    assert ".zip" in out.stdout.splitlines()[0]
