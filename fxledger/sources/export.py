"""Export of converted prices: start cutoff, day rendering, headerless CSV and back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from fxledger.constants import EXPORT_DAY_FORMAT
from fxledger.operators.position import with_position
from fxledger.schema import EXPORT_COLUMNS, require_columns

DAY_FORMAT = EXPORT_DAY_FORMAT


def export_rows(converted: DataFrame, start: dt.date | str, sort: bool = False,
                position: bool = False) -> DataFrame:
    """(ticker, price, date text) for days on or after ``start`` (no upper cut).

    With ``sort`` the rows are ordered newest day first, then by symbol (a
    range-partitioned sort, done once at the sink); ``position`` adds the place
    in that order (``pos``, from 1) as a column.
    """
    require_columns(converted, EXPORT_COLUMNS, "export input")
    rows = converted.where(F.col("date") >= F.lit(start).cast("date"))
    order = (F.col("date").desc(), F.col("ticker"))
    if position:
        rows = with_position(rows.select(*EXPORT_COLUMNS), *order)
    elif sort:
        rows = rows.orderBy(*order)
    return rows.select(*(["pos"] if position else []), "ticker", "price",
                       F.date_format("date", DAY_FORMAT).alias("date"))


def write_csv(rows: DataFrame, path: str) -> bool:
    """Write headerless CSV ``ticker,price,date`` in the order of ``rows``.

    Refuses input without the three columns (raises) and empty input (returns
    False after one ``limit(1)`` probe).  Sorted rows (``export_rows(...,
    sort=True)``) are range partitioned, so the part files in name order are
    the export in order; nothing is funnelled through a single task.
    """
    require_columns(rows, EXPORT_COLUMNS, "CSV export")
    if rows.limit(1).count() == 0:
        return False
    rows.select(*EXPORT_COLUMNS).write.mode("overwrite").option("header", "false").csv(path)
    return True


def read_csv(spark: SparkSession, path: str, day_format: str = DAY_FORMAT) -> DataFrame:
    """An exported CSV read back: ``pos`` (the row's place over all part files, from 1),
    ticker, price, date, and ``corrupt``, the line as it stands where it does not hold
    three fields of their types (its fields are NULL then)."""
    kind = "ticker string, price double, date date, corrupt string"
    raw = (spark.read.schema(kind).option("header", "false").option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "corrupt").option("dateFormat", day_format).csv(path))
    placed = raw.select("*", F.col("_metadata.file_name").alias("_file"),
                        F.col("_metadata.file_block_start").alias("_block"),
                        F.monotonically_increasing_id().alias("_line"))
    bad = F.col("corrupt").isNotNull()
    return (with_position(placed, "_file", "_block", "_line")
            .select("pos", *[F.when(~bad, F.col(c)).alias(c) for c in EXPORT_COLUMNS], "corrupt"))
