"""Price-history operators: coverage, gaps, listing clip, range scans, upsert."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fxledger.constants import STATUS_EMPTY, STATUS_LOADED, STATUS_NOT_FOUND
from fxledger.functions.numeric import is_number
from fxledger.functions.ranges import missing_ranges
from fxledger.operators.clean import coerce_prices, drop_incomplete

DayLike = dt.date | str | Column


def _day(d: DayLike) -> Column:
    return d if isinstance(d, Column) else F.lit(d).cast("date")


def coverage(bars: DataFrame) -> DataFrame:
    """Per symbol: first and last day and number of rows (A2/A4)."""
    return bars.groupBy("ticker").agg(F.min("date").alias("first_date"),
                                      F.max("date").alias("last_date"),
                                      F.count(F.lit(1)).alias("n_days"))


def store_status(tickers: DataFrame, raw_store: DataFrame) -> DataFrame:
    """Status of each requested symbol in a store of raw bars.

    ``not_found``: no row at all; ``empty``: rows, but none usable (day and
    price present); ``loaded``: usable rows, with their first/last day.
    """
    usable = F.col("date").isNotNull() & is_number(F.col("old_price"))
    stats = (coerce_prices(raw_store).groupBy("ticker")
             .agg(F.count(F.lit(1)).alias("_rows"),
                  F.count_if(usable).alias("_usable"),
                  F.min(F.when(usable, F.col("date"))).alias("first_date"),
                  F.max(F.when(usable, F.col("date"))).alias("last_date")))
    status = (F.when(F.col("_rows").isNull(), F.lit(STATUS_NOT_FOUND))
               .when(F.col("_usable") == 0, F.lit(STATUS_EMPTY))
               .otherwise(F.lit(STATUS_LOADED)))
    return (tickers.join(stats, "ticker", "left")
            .select("ticker", status.alias("status"), "first_date", "last_date",
                    F.coalesce(F.col("_usable"), F.lit(0)).cast("long").alias("n_days")))


def missing_ranges_table(targets: DataFrame, cover: DataFrame,
                         as_of: DayLike | None = None) -> DataFrame:
    """GAP(ticker, gap_start, gap_end) for requested ranges ``targets(ticker,
    start, end)`` against the stored ``cover(ticker, first_date, last_date)``.

    A range that starts on ``as_of`` is not fetched (today's bar is not final).
    """
    gaps = (targets.join(cover.select("ticker", "first_date", "last_date"), "ticker", "left")
            .select("ticker", F.inline(missing_ranges("start", "end", "first_date",
                                                      "last_date"))))
    if as_of is not None:
        gaps = gaps.where(F.col("gap_start") != _day(as_of))
    return gaps


def clip_to_listing(instruments: DataFrame, start: DayLike, end: DayLike) -> DataFrame:
    """(ticker, fetch_start, fetch_end) per instrument: skip those first traded
    after ``end``; fetch from the later of ``start`` and the listing day."""
    s_ts = _day(start).cast("timestamp_ntz")
    e_ts = _day(end).cast("timestamp_ntz")
    listed = F.col("earliest_ts")
    return (instruments.where(listed.isNull() | (listed <= e_ts))
            .select("ticker",
                    F.greatest(s_ts, F.coalesce(listed, s_ts)).cast("date").alias("fetch_start"),
                    _day(end).alias("fetch_end")))


def scan_range(bars: DataFrame, start: DayLike, end: DayLike) -> DataFrame:
    """Bars with ``start <= date <= end`` (filter pushed to the scan)."""
    return bars.where((F.col("date") >= _day(start)) & (F.col("date") < F.date_add(_day(end), 1)))


def scan_ranges(bars: DataFrame, ranges: DataFrame, start: str = "fetch_start",
                end: str = "fetch_end") -> DataFrame:
    """Bars inside each symbol's own inclusive range: an equi-join on ticker
    with a range condition (never a cartesian product)."""
    r = ranges.select(F.col("ticker").alias("_t"), F.col(start).alias("_s"),
                      F.col(end).alias("_e"))
    return (bars.join(r, (bars["ticker"] == r["_t"]) & (bars["date"] >= r["_s"])
                      & (bars["date"] <= r["_e"]))
            .drop("_t", "_s", "_e"))


def upsert(stored: DataFrame, fresh: DataFrame, order: str = "ord") -> DataFrame:
    """Stored bars merged with fresh ones; per (ticker, date) the fresh bar wins,
    and within one side the later arrival wins.  Incomplete rows are dropped
    first.

    One aggregation, partial on the map side: the last fresh and the last
    stored price are kept side by side (numeric buffers, so a hash
    aggregate) and the fresh one is preferred.
    """
    ord_type = next((d.schema[order].dataType for d in (fresh, stored) if order in d.columns),
                    T.LongType())

    def side(df: DataFrame, src: int) -> DataFrame:
        ord_col = F.col(order) if order in df.columns else F.lit(0).cast(ord_type)
        # a bar without an arrival order counts as the first of its side
        ord_col = F.coalesce(ord_col, F.lit(-(1 << 63)).cast(ord_type))
        bars = df.select("ticker", "old_price", "date", ord_col.alias("_ord"))
        return drop_incomplete(coerce_prices(bars)).withColumn("_src", F.lit(src))

    both = side(stored, 0).unionByName(side(fresh, 1))
    is_fresh = F.col("_src") == 1

    def last_of(cond):
        return F.max_by(F.when(cond, F.col("old_price")), F.when(cond, F.col("_ord")))

    return (both.groupBy("ticker", "date")
            .agg(F.coalesce(last_of(is_fresh), last_of(~is_fresh)).alias("old_price"))
            .select("ticker", "old_price", "date"))


def history_summary(bars: DataFrame) -> DataFrame:
    """Total rows and number of symbols with data."""
    return bars.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.countDistinct("ticker").alias("n_symbols"))
