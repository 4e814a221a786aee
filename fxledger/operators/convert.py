"""Conversion of prices into the home currency.

Plan shape (all symbols at once, no per-symbol loop):

1. split the input into securities and FX rows on ``type``;
2. one rate per (FX symbol, day): the first arrival (aggregate, partial);
3. the *rate domain*: the distinct (FX symbol, day) pairs that securities need.
   It is bounded by currencies x days, never by price rows, so a symbol or a
   day holding a third of all rows cannot skew the windows below;
4. backward as-of over the domain and the rates (one window per FX symbol),
   then the back fill of leading days (same partitioning, no new shuffle);
5. the domain with its rates is checked for size and broadcast back to the
   securities (a shuffle join with AQE skew splitting beyond the bound);
6. price = old price x rate; FX rows pass through as prices.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window, functions as F

from fxledger.constants import CHECK_TOLERANCE, CURRENCY_TYPE, HOME_CURRENCY, NO_PAIR
from fxledger.functions.currency import fixed_rate, fx_symbol
from fxledger.operators.clean import coerce_prices, drop_incomplete
from fxledger.operators.joins import MAX_BROADCAST_BYTES, broadcast_if, sized
from fxledger.schema import CONVERT_COLUMNS, require_columns


def enrich(prices: DataFrame, instruments: DataFrame) -> DataFrame:
    """Attach ``type`` and ``currency`` from the instruments when the bars lack
    them (left join on ticker; the planner broadcasts the instrument side only
    when its estimated size is under the broadcast threshold)."""
    need = [c for c in ("type", "currency") if c not in prices.columns]
    if not need:
        return prices
    return prices.join(instruments.select("ticker", *need), "ticker", "left")


def split_by_type(df: DataFrame, fx_type: str = CURRENCY_TYPE) -> tuple[DataFrame, DataFrame]:
    """(securities, fx rows).  A missing type counts as a security."""
    is_fx = F.col("type").eqNullSafe(F.lit(fx_type))
    return df.where(~is_fx), df.where(is_fx)


def clean_side(df: DataFrame) -> DataFrame:
    """Coerce price and day, drop rows missing the day, symbol or price."""
    return drop_incomplete(coerce_prices(df), ("date", "ticker", "old_price"))


def first_rate(fx_rows: DataFrame, order: str = "ord") -> DataFrame:
    """RATE(fx_ticker, date, rate): one rate per day and FX symbol, the first
    non-missing value in arrival order."""
    return (fx_rows.where(F.col("old_price").isNotNull())
            .groupBy(F.col("ticker").alias("fx_ticker"), "date")
            .agg(F.min_by("old_price", order).alias("rate")))


def with_fx_symbol(securities: DataFrame, home: str = HOME_CURRENCY,
                   minor_units: Mapping[str, float] | None = None) -> DataFrame:
    """Add ``fx_ticker`` (the pair to convert with) and ``fixed_rate``."""
    return (securities
            .withColumn("fx_ticker", fx_symbol("currency", home, minor_units))
            .withColumn("fixed_rate", fixed_rate("currency", home, minor_units)))


def rate_domain(securities_fx: DataFrame) -> DataFrame:
    """Distinct (fx_ticker, date) of the securities that need a market rate."""
    return (securities_fx
            .where(F.col("fixed_rate").isNull() & F.col("fx_ticker").isNotNull()
                   & (F.col("fx_ticker") != NO_PAIR))
            .select("fx_ticker", "date").distinct())


def asof_rates(domain: DataFrame, rates: DataFrame, max_age_days: int | None = None
               ) -> DataFrame:
    """Backward as-of: for each (fx_ticker, date) of ``domain`` the latest rate
    with ``rate.date <= date`` (same day allowed) and that rate's own day
    (``rate_date``); NULL when no earlier rate exists.  With ``max_age_days``
    a rate older than that is dropped (the row stays unresolved); by default
    there is no staleness limit.

    Rates and domain days are unioned and scanned by one window per FX symbol;
    on a tie the rate sorts first, so an exact-day rate matches.
    """
    days = domain.select("fx_ticker", "date", F.lit(None).cast("double").alias("rate"),
                         F.lit(1).alias("_side"))
    quotes = rates.select("fx_ticker", "date", "rate", F.lit(0).alias("_side"))
    upto = (Window.partitionBy("fx_ticker").orderBy("date", "_side")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    quote = F.when(F.col("_side") == 0,
                   F.struct(F.col("date").alias("d"), F.col("rate").alias("r")))
    out = (days.unionByName(quotes)
           .withColumn("_q", F.last(quote, ignorenulls=True).over(upto))
           .where(F.col("_side") == 1))
    rate = F.col("_q.r")
    if max_age_days is not None:
        rate = F.when(F.datediff("date", "_q.d") <= int(max_age_days), rate)
    return out.select("fx_ticker", "date", rate.alias("rate"), F.col("_q.d").alias("rate_date"))


def backfill_rates(asof: DataFrame) -> DataFrame:
    """Resolve the days before the first rate of their FX symbol (no
    ``rate_date``): take the rate of the next day of the same FX symbol that
    has one.  Adds ``backfilled``."""
    ahead = (Window.partitionBy("fx_ticker").orderBy("date")
             .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    leading = F.col("rate").isNull() & F.col("rate_date").isNull()
    return (asof
            .withColumn("backfilled", leading)
            .withColumn("rate", F.coalesce(F.col("rate"), F.when(
                leading, F.first("rate", ignorenulls=True).over(ahead))))
            .withColumn("backfilled", F.col("backfilled") & F.col("rate").isNotNull()))


def domain_rates(securities_fx: DataFrame, rates: DataFrame,
                 max_age_days: int | None = None) -> DataFrame:
    """(fx_ticker, date, rate, rate_date, backfilled) for every pair the
    securities need."""
    return backfill_rates(asof_rates(rate_domain(securities_fx), rates, max_age_days))


class UnresolvedRates(ValueError):
    """Rows are left without an FX rate, and the caller asked not to go on."""


@dataclass
class Conversion:
    """Lazy results of one conversion; each property is its own plan."""

    securities: DataFrame      # cleaned security rows with fx_ticker and fixed_rate
    fx_rows: DataFrame         # cleaned FX rows
    rates: DataFrame           # RATE
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES
    max_age_days: int | None = None

    @cached_property
    def _pair_rates_sized(self) -> tuple[DataFrame, bool]:
        return sized(domain_rates(self.securities, self.rates, self.max_age_days),
                     self.max_broadcast_bytes)

    @property
    def pair_rates(self) -> DataFrame:
        """Rate domain with resolved rates, marked for broadcast when its size
        is within the bound."""
        df, small = self._pair_rates_sized
        return broadcast_if(df, small)

    @cached_property
    def rated(self) -> DataFrame:
        """Securities with their final ``rate`` (NULL = unresolved).

        Broadcast path: one pass, every row probes the small rate table.
        Shuffle path (domain beyond the bound): only rows that need a market
        rate are shuffled into the join; home-currency rows and rows without
        a currency (a NULL key would pile into one partition) skip it.
        """
        rates, small = self._pair_rates_sized
        rates = rates.drop("backfilled", "rate_date")
        if small:
            joined = self.securities.join(F.broadcast(rates), ["fx_ticker", "date"], "left")
            return joined.withColumn("rate", F.coalesce("fixed_rate", "rate"))
        needs = F.col("fixed_rate").isNull() & F.col("fx_ticker").isNotNull()
        market = self.securities.where(needs).join(rates, ["fx_ticker", "date"], "left")
        rest = (self.securities.where(~needs)
                .withColumn("rate", F.col("fixed_rate").cast("double")))
        return market.unionByName(rest)

    @property
    def unresolved(self) -> DataFrame:
        """Quarantine: foreign rows that still have no rate."""
        return self.rated.where(F.col("rate").isNull())

    @property
    def converted_securities(self) -> DataFrame:
        return (self.rated.where(F.col("rate").isNotNull())
                .select("ticker", (F.col("old_price") * F.col("rate")).alias("price"), "date"))

    @property
    def converted(self) -> DataFrame:
        """CONVERTED(ticker, price, date): securities in the home currency, FX
        rows unconverted (their rate is their price)."""
        fx = self.fx_rows.select("ticker", F.col("old_price").alias("price"), "date")
        return self.converted_securities.unionByName(fx)


def prepare(df: DataFrame, home: str = HOME_CURRENCY,
            minor_units: Mapping[str, float] | None = None, order: str = "ord",
            max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
            max_age_days: int | None = None) -> Conversion:
    require_columns(df, CONVERT_COLUMNS, "conversion input")
    securities, fx_rows = split_by_type(df)
    securities = with_fx_symbol(clean_side(securities), home, minor_units)
    fx_rows = clean_side(fx_rows)
    return Conversion(securities, fx_rows, first_rate(fx_rows, order), max_broadcast_bytes,
                      max_age_days)


def convert_prices(df: DataFrame, home: str = HOME_CURRENCY,
                   minor_units: Mapping[str, float] | None = None, order: str = "ord",
                   on_missing: str = "quarantine",
                   max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
                   max_age_days: int | None = None) -> DataFrame:
    """ENRICHED -> CONVERTED.

    Rows whose rate cannot be resolved are left out (see ``Conversion.unresolved``);
    with ``on_missing="raise"`` their presence raises instead.
    """
    if on_missing not in ("quarantine", "raise"):
        raise ValueError("on_missing must be 'quarantine' or 'raise'")
    conv = prepare(df, home, minor_units, order, max_broadcast_bytes, max_age_days)
    if on_missing == "raise" and conv.unresolved.limit(1).count() > 0:
        raise UnresolvedRates("some rows have no FX rate after the back fill")
    return conv.converted


def conversion_check(stored: DataFrame, tolerance: float = CHECK_TOLERANCE) -> DataFrame:
    """Rows of a stored conversion (ticker, date, old_price, rate, price) whose
    price is missing or differs from old price x rate.  The stored rows carry
    what they were made from, so the check is one filter."""
    expected = F.col("rate") * F.col("old_price")
    return (stored.where(F.col("price").isNull() | (F.abs(expected - F.col("price")) > tolerance))
            .select("ticker", "date", "price", expected.alias("expected")))


def conversion_summary(rated: DataFrame) -> DataFrame:
    """Counts: rows, rows converted through a pair, home rows, unresolved rows."""
    pair = F.col("fx_ticker").isNull() | (F.col("fx_ticker") != NO_PAIR)
    return rated.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(pair & F.col("rate").isNotNull()).alias("n_fx_converted"),
        F.count_if(~pair).alias("n_home"),
        F.count_if(F.col("rate").isNull()).alias("n_unresolved"),
    )


def date_coverage(securities: DataFrame, fx_rows: DataFrame) -> DataFrame:
    """Days with security rows, with FX rows, both, and only one of them.

    One aggregation over the day column of both sides (partial aggregation
    reduces each task to its distinct days), no join.
    """
    days = (securities.select("date", F.lit(1).alias("s"), F.lit(0).alias("f"))
            .unionByName(fx_rows.select("date", F.lit(0).alias("s"), F.lit(1).alias("f")))
            .groupBy("date").agg(F.max("s").alias("s"), F.max("f").alias("f")))
    return days.agg(
        F.count_if(F.col("s") == 1).alias("n_security_days"),
        F.count_if(F.col("f") == 1).alias("n_fx_days"),
        F.count_if((F.col("s") == 1) & (F.col("f") == 1)).alias("n_common_days"),
        F.count_if((F.col("s") == 1) & (F.col("f") == 0)).alias("n_security_only_days"),
        F.count_if((F.col("s") == 0) & (F.col("f") == 1)).alias("n_fx_only_days"),
    )
