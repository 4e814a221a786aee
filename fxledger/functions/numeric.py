"""Numeric coercion: bad values become NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What the text of every double but NaN holds; a failed parse costs far more than this check.
_HINT = r"(?i)[0-9]|inf"
# Text that names a special double; it may end in "f" ("inf") and still counts.
_SPECIAL = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"
# A trailing type suffix ("1.0d", "2f") is accepted by the JVM parser but is not a number.
_SUFFIX = r"[dDfF]\s*$"


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def coerce_numeric(c: Column | str, text: bool = True) -> Column:
    """``try_cast(x AS DOUBLE)`` with NaN -> NULL.

    With ``text`` the input is read as text first so that type suffixes are
    rejected; pass ``text=False`` for columns that are already numeric.
    """
    c = F.col(c) if isinstance(c, str) else c
    if not text:
        return nan_to_null(c.try_cast("double"))
    s = c.cast("string")
    return F.when(s.rlike(_HINT) & (~s.rlike(_SUFFIX) | s.rlike(_SPECIAL)), s.try_cast("double"))


def is_number(c: Column) -> Column:
    """True for a non-NULL, non-NaN double."""
    return c.isNotNull() & ~F.isnan(c)
