"""Instrument metadata: normalise, validate requests, derive the FX pairs needed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F, types as T

from fxledger.constants import HOME_CURRENCY, NO_PAIR, UNKNOWN
from fxledger.functions.currency import fx_symbol
from fxledger.functions.dates import epoch_seconds_to_ts
from fxledger.functions.numeric import coerce_numeric


def normalise_instruments(meta: DataFrame, symbol: str = "ticker",
                          epoch: str = "first_trade_epoch", type_: str = "quote_type",
                          currency: str = "currency", bid: str = "bid",
                          order: str | None = None) -> DataFrame:
    """Raw metadata -> INSTRUMENT(ticker, earliest_ts, type, currency, bid).

    Symbol upper-cased (rows without one are dropped), first-trade epoch
    seconds -> timestamp, missing type/currency -> "Unknown", a bid that is
    not a number -> NULL.  One row per symbol: the last by ``order`` (NULL
    first); of rows that tie, or without an order, the greatest by value.
    """
    bid_is_text = not isinstance(meta.schema[bid].dataType, T.NumericType)
    row = F.struct(F.col(order).alias("_order") if order else F.lit(0).alias("_order"),
                   epoch_seconds_to_ts(epoch).alias("earliest_ts"),
                   F.coalesce(F.col(type_).cast("string"), F.lit(UNKNOWN)).alias("type"),
                   F.coalesce(F.col(currency).cast("string"), F.lit(UNKNOWN)).alias("currency"),
                   coerce_numeric(F.col(bid), text=bid_is_text).alias("bid"))
    return (meta.where(F.col(symbol).isNotNull())
            .groupBy(F.upper(F.col(symbol)).alias("ticker")).agg(F.max(row).alias("_last"))
            .select("ticker", "_last.earliest_ts", "_last.type", "_last.currency", "_last.bid"))


def is_valid(instruments: DataFrame):
    return ((F.length(F.col("ticker")) > 0) & (F.col("type") != UNKNOWN)
            & (F.col("currency") != UNKNOWN))


def first_requests(requests: DataFrame) -> DataFrame:
    """(ticker, pos): each requested symbol once, upper-cased, first position wins."""
    return (requests.where(F.col("symbol").isNotNull())
            .groupBy(F.upper("symbol").alias("ticker"))
            .agg(F.min("pos").alias("pos")))


def validate(requests: DataFrame, instruments: DataFrame) -> DataFrame:
    """Requested symbols that have usable metadata, in request order (``pos``)."""
    valid = instruments.where(is_valid(instruments))
    return first_requests(requests).join(valid, "ticker").select(
        "pos", "ticker", "earliest_ts", "type", "currency", "bid")


def rejects(requests: DataFrame, instruments: DataFrame) -> DataFrame:
    """Requested symbols that were dropped, with the reason."""
    reason = (F.when(F.col("type").isNull(), F.lit("unknown symbol"))
               .when(F.length("ticker") == 0, F.lit("empty symbol"))
               .when(F.col("type") == UNKNOWN, F.lit("missing type"))
               .when(F.col("currency") == UNKNOWN, F.lit("missing currency")))
    return (first_requests(requests)
            .join(instruments.select("ticker", "type", "currency"), "ticker", "left")
            .select("pos", "ticker", reason.alias("reason"))
            .where(F.col("reason").isNotNull()))


def required_fx(validated: DataFrame, home: str = HOME_CURRENCY,
                minor_units: Mapping[str, float] | None = None) -> DataFrame:
    """FX pairs the validated instruments need and that are not requested
    already (at most one row per currency; sort by ``fx_ticker`` at the sink)."""
    pairs = (validated.select(fx_symbol("currency", home, minor_units).alias("fx_ticker"))
             .where(F.col("fx_ticker").isNotNull() & (F.col("fx_ticker") != NO_PAIR))
             .distinct())
    return pairs.join(validated.select(F.col("ticker").alias("fx_ticker")), "fx_ticker",
                      "left_anti")


def full_instrument_set(validated: DataFrame, instruments: DataFrame,
                        home: str = HOME_CURRENCY,
                        minor_units: Mapping[str, float] | None = None) -> DataFrame:
    """Validated instruments followed by the validated FX pairs they need.

    Added pairs carry no request position (``pos`` NULL) and sort after the
    requests, by symbol.
    """
    fx = required_fx(validated, home, minor_units).select(F.col("fx_ticker").alias("ticker"))
    added = (fx.join(instruments.where(is_valid(instruments)), "ticker")
             .select(F.lit(None).cast("long").alias("pos"), "ticker", "earliest_ts", "type",
                     "currency", "bid"))
    return validated.unionByName(added)
