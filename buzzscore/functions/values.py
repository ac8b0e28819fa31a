"""Column expressions for timestamps and numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

# --- fixed values -----------------------------------------------------------
# A value is parsed as an ISO timestamp only when it starts with a full date;
# this rejects a bare time ("12:30:00", which Spark would read as today) and a
# bare year ("2025").
ISO_DATE_PREFIX = r"^\s*\d{4}-\d{2}-\d{2}"
# Extra formats tried after ISO, month first as pandas/dateutil do by default.
DEFAULT_TIMESTAMP_FORMATS = ("MM/dd/yyyy", "MMM d, yyyy", "MMM d yyyy")
# A plain decimal number (optional sign, fraction, exponent).
NUMBER_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
# ---------------------------------------------------------------------------


def parse_timestamp(c: Column, formats: Sequence[str] = DEFAULT_TIMESTAMP_FORMATS) -> Column:
    """Parse a string per value into a UTC timestamp; unparseable -> null.

    ISO forms (date only, ``T``, ``Z``, ``+05:30`` offsets, fractions) are
    accepted and offsets converted to UTC; then each extra format is tried.
    """
    s = c.cast(StringType())
    iso = F.when(s.rlike(ISO_DATE_PREFIX), F.try_to_timestamp(F.trim(s)))
    tries = [iso] + [F.try_to_timestamp(F.trim(s), F.lit(fmt)) for fmt in formats]
    return F.coalesce(*tries)


def to_double(c: Column, dtype=None) -> Column:
    """Numeric coercion: unparseable or NaN -> null."""
    if dtype is not None and isinstance(dtype, NumericType):
        v = c.cast("double")
    else:
        s = c.cast(StringType())
        v = F.when(s.rlike(NUMBER_PATTERN), F.trim(s).try_cast("double"))
    return nan_to_null(v)


def to_double_or_zero(c: Column, dtype=None) -> Column:
    """Numeric coercion: unparseable or missing -> 0.0; never NaN."""
    return F.coalesce(to_double(c, dtype), F.lit(0.0))


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))
