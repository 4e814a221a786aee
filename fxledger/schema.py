"""Table schemas and boundary checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, types as T

# One row per symbol-day bar.  ``ord`` is the arrival order: "keep last" and
# "keep first" need it because Spark rows carry no position.
PRICE = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("old_price", T.DoubleType()),
    T.StructField("date", T.DateType()),
    T.StructField("ord", T.LongType()),
])

ENRICHED = T.StructType(PRICE.fields + [
    T.StructField("type", T.StringType()),
    T.StructField("currency", T.StringType()),
])

STORE_COLUMNS = ("ticker", "old_price", "date")
EXPORT_COLUMNS = ("ticker", "price", "date")
CONVERT_COLUMNS = ("date", "type", "ticker", "old_price", "currency")


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, required: Iterable[str], where: str = "") -> None:
    """Raise when ``df`` lacks a column (metadata only, runs no job)."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise MissingColumns(f"{where or 'input'} lacks columns {missing}")
