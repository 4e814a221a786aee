"""Calendar fill of FX series and provisional quotes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from fxledger.constants import PAIR_SUFFIX
from fxledger.functions.currency import is_fx_symbol
from fxledger.functions.numeric import is_number


def calendar_fill(bars: DataFrame, marker: str = PAIR_SUFFIX) -> DataFrame:
    """Give FX series (symbol contains ``marker``) a bar on every calendar day
    between their first and last bar, carrying the last value forward.

    ``bars`` holds one row per (ticker, date); rows that repeat a day pass
    through, and only the last of them is carried on.  Each bar is stretched up to
    the day before the next bar with ``lead`` + ``explode``: one window over
    the FX rows (at most one row per symbol-day), no calendar join.  Other
    symbols pass through.  Adds ``filled`` (true for created days).
    """
    fx = is_fx_symbol("ticker", marker)
    nxt = F.lead("date").over(Window.partitionBy("ticker").orderBy("date"))
    extra = [c for c in bars.columns if c not in ("ticker", "date")]
    stretched = (bars.where(fx)
                 .withColumn("_until", F.greatest(F.coalesce(F.date_sub(nxt, 1), F.col("date")), F.col("date")))
                 .withColumn("_day", F.explode(F.sequence("date", "_until")))
                 .select("ticker", F.col("_day").alias("date"), *extra,
                         (F.col("_day") != F.col("date")).alias("filled")))
    rest = bars.where(~fx).withColumn("filled", F.lit(False))
    return stretched.unionByName(rest)


def fill_summary(filled: DataFrame, marker: str = PAIR_SUFFIX) -> DataFrame:
    """Per FX series: days after the fill, days created."""
    return (filled.where(is_fx_symbol("ticker", marker)).groupBy("ticker")
            .agg(F.count(F.lit(1)).alias("n_days"),
                 F.count_if("filled").alias("n_filled")))


def provisional_quotes(bars: DataFrame, instruments: DataFrame, as_of: dt.date | str,
                       last: DataFrame | None = None) -> DataFrame:
    """(ticker, old_price, date): a bar at ``as_of`` with the instrument's bid
    for each symbol whose last bar is before ``as_of`` and whose bid is a
    number > 0.  The last day per symbol is an aggregate (partial, one row
    per symbol), joined to the instrument bids; ``last(ticker, last_date)``, if
    given, is taken instead of the bars."""
    day = F.lit(as_of).cast("date")
    last = (bars.groupBy("ticker").agg(F.max("date").alias("_last")) if last is None
            else last.select("ticker", F.col("last_date").alias("_last")))
    bid = F.col("bid")
    return (last.join(instruments.select("ticker", "bid"), "ticker")
            .where((F.col("_last") < day) & is_number(bid) & (bid > 0))
            .select("ticker", bid.alias("old_price"), day.alias("date")))


def append_provisional(bars: DataFrame, instruments: DataFrame,
                       as_of: dt.date | str) -> DataFrame:
    """``bars`` plus the provisional quotes; adds ``provisional``."""
    quotes = provisional_quotes(bars, instruments, as_of).withColumn("provisional", F.lit(True))
    extra = [c for c in bars.columns if c not in ("ticker", "old_price", "date")]
    for c in extra:
        quotes = quotes.withColumn(c, F.lit(None).cast(bars.schema[c].dataType))
    return bars.withColumn("provisional", F.lit(False)).unionByName(quotes)
