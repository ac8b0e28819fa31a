"""Column expressions for text normalisation and tokenisation.

All of it is built-in Spark SQL (JVM, codegen) except NFC normalisation and
Python-exact lowercase/accent folding, which go through Arrow UDFs and
only ever see the non-ASCII rows: ASCII rows are passed as null and take the
built-in path, so the Python cost is proportional to non-ASCII text only.
NFC leaves out all text below U+0300 as well.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from buzzscore.functions import pyhelpers

try:  # ship the UDF wrappers by value: executors need not import this package
    import sys as _sys

    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

# --- fixed values -----------------------------------------------------------
# Python's whitespace set (``str.isspace`` / ``re`` ``\s``) as a character
# class that means the same thing in Java regex and RE2.
WS = (
    r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}"
    r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# Zero-width joiner, zero-width non-joiner, byte-order mark: deleted.
ZERO_WIDTH = "\u200d\u200c\ufeff"
# A token is a run of two or more word characters (letters, digits, "_").
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# ---------------------------------------------------------------------------

# The characters of WS, and WS within ASCII.
_WS_CHARS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Whitespace other than the space: below U+0300, each character by itself (one table look-up), and all.
_LOW_BREAKS = r"[\x09\x0A\x0B\x0C\x0D\x1C\x1D\x1E\x1F\x{0085}\x{00A0}]"
_BREAKS = WS.replace(r"-\x{0020}", r"-\x{001F}")


def strip_ws(c: Column) -> Column:
    """Remove leading/trailing Unicode whitespace (Python ``str.strip``)."""
    return F.btrim(c, F.lit(_WS_CHARS))


def _collapse(c: Column, breaks: str) -> Column:
    # a scan by one class, then only runs of two spaces or more: words' single spaces are no matches
    return F.regexp_replace(F.regexp_replace(c, F.lit(breaks), F.lit(" ")), F.lit("  +"), F.lit(" "))


def collapse_ws(c: Column) -> Column:
    """Replace every run of whitespace with one space."""
    return _collapse(c, _BREAKS)


def remove_zero_width(c: Column) -> Column:
    for x in ZERO_WIDTH:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def is_composed(c: Column) -> Column:
    """True when every character is below U+0300: such text is in NFC."""
    return ~F.rlike(c, F.lit(r"[^\x{0000}-\x{02FF}]"))


def is_ascii(c: Column) -> Column:
    """True when every character is ASCII (byte length equals char length)."""
    return F.octet_length(c) == F.length(c)


@F.arrow_udf(StringType())
def _nfc_udf(s: pa.Array) -> pa.Array:
    return pyhelpers.map_text(pyhelpers.nfc_text, s)


@F.arrow_udf(StringType())
def _lower_udf(s: pa.Array) -> pa.Array:
    return pyhelpers.map_text(str.lower, s)


@F.arrow_udf(StringType())
def _fold_udf(s: pa.Array) -> pa.Array:
    return pyhelpers.map_text(pyhelpers.fold_text, s)


def nfc(c: Column) -> Column:
    """Unicode NFC; strings below U+0300 are already NFC and skip Python."""
    return F.coalesce(_nfc_udf(F.when(~is_ascii(c) & ~is_composed(c), c)), c)


def py_lower(c: Column) -> Column:
    """Lowercase exactly as Python does (Spark differs at a few code points)."""
    return F.coalesce(_lower_udf(F.when(~is_ascii(c), c)), F.lower(c))


def fold_accents(c: Column) -> Column:
    """Lowercase, then NFKD and drop combining marks (accent stripping)."""
    return F.coalesce(_fold_udf(F.when(~is_ascii(c), c)), F.lower(c))


def finish_text(c: Column) -> Column:
    """After NFC: collapse whitespace runs, drop zero-width characters, strip.

    The order matters: zero-width removal follows the collapse, so
    ``"a \\u200d b"`` ends as ``"a  b"`` (two spaces).
    """
    rest = strip_ws(remove_zero_width(collapse_ws(c)))
    return F.when(is_ascii(c) | is_composed(c), strip_ws(_collapse(c, _LOW_BREAKS))).otherwise(rest)


def normalize_text(c: Column) -> Column:
    """Content normalisation: strip, NFC, collapse runs, drop zero-width, strip.

    For whole tables prefer the staged form in ``operators.clean`` (one
    projection per step), which evaluates the strip regex once per row.
    """
    return finish_text(nfc(strip_ws(c)))


def normalize_username(c: Column) -> Column:
    return py_lower(strip_ws(c))


def tokenize(c: Column) -> Column:
    """All runs of >= 2 word characters, in order."""
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), 0)


# --- fixed values: Spark ML's English default stop words, in its order ------
_ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she "
    "her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll "
    "i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've "
    "they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't "
    "shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's "
    "what's when's where's who's why's would "
)
# ---------------------------------------------------------------------------


def spark_stop_words() -> tuple[str, ...]:
    """Spark ML's English default list, ``StopWordsRemover.loadDefaultStopWords``.

    Kept as plain data so that neither a running JVM nor a PySpark unpacked on
    disk is needed to import this package (PySpark may come from a zip).
    """
    return tuple(_ENGLISH_STOP_WORDS.split())
