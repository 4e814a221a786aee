"""Bar cleaning: normalise, coerce, drop incomplete rows, keep the last arrival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fxledger.functions.dates import coerce_day
from fxledger.functions.numeric import coerce_numeric

KEY = ("ticker", "date")


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_bars(raw: DataFrame, ticker: Column | str, price: Column | str,
                   when: Column | str, ord: Column | str | None = None) -> DataFrame:
    """Raw bars -> ``(ticker, old_price, date[, ord])``.

    The price is coerced to a double, the time floored to its UTC day, and rows
    missing the day or the price are dropped.
    """
    cols = [_as_col(ticker).cast("string").alias("ticker"),
            coerce_price(raw, price).alias("old_price"),
            coerce_when(raw, when).alias("date")]
    if ord is not None:
        cols.append(_as_col(ord).alias("ord"))
    return drop_incomplete(raw.select(*cols), ("date", "old_price"))


def coerce_price(df: DataFrame, price: Column | str) -> Column:
    text = not (isinstance(price, str)
                and isinstance(df.schema[price].dataType, T.NumericType))
    return coerce_numeric(_as_col(price), text=text)


def coerce_when(df: DataFrame, when: Column | str, day_first: bool = False) -> Column:
    if isinstance(when, str) and isinstance(
            df.schema[when].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col(when).cast("date")
    return coerce_day(_as_col(when), day_first)


def coerce_prices(df: DataFrame, price: str = "old_price", when: str = "date") -> DataFrame:
    """Coerce the price and day columns in place (bad values -> NULL)."""
    return (df.withColumn(price, coerce_price(df, price))
              .withColumn(when, coerce_when(df, when)))


def drop_incomplete(df: DataFrame, subset: Sequence[str] = ("ticker", "date", "old_price")
                    ) -> DataFrame:
    """Drop rows with NULL (or NaN) in any of ``subset``."""
    return df.na.drop(how="any", subset=list(subset))


def _pick(df: DataFrame, keys: Sequence[str], order: str, pick, bound) -> DataFrame:
    values = [c for c in df.columns if c not in keys and c != order]
    aggs = [pick(F.col(v), F.col(order)).alias(v) for v in values]
    return (df.groupBy(*keys).agg(*aggs, bound(order).alias(order))
            .select(*df.columns))


def dedupe_last(df: DataFrame, keys: Sequence[str] = KEY, order: str = "ord") -> DataFrame:
    """One row per key: the one that arrived last (greatest ``order``, which
    must be unique within a key); the order column is kept.

    An aggregate, not a window: map-side partial aggregation collapses a hot
    key before the shuffle, so no key ever lands whole in one task.  One
    ``max_by`` per value column keeps the aggregation buffer fixed-width when
    the values and the order are numeric, so Spark uses a hash aggregate
    (a struct buffer would force a sort-based aggregate).  Attributes that
    are constant per key (a symbol's type, currency) belong in ``keys``.
    """
    return _pick(df, keys, order, F.max_by, F.max)


def last_complete(df: DataFrame, keys: Sequence[str] = KEY, order: str = "ord") -> DataFrame:
    """Drop incomplete bars, then keep the last arrival per key: a bar without a
    price never hides an earlier good one of its day."""
    return dedupe_last(drop_incomplete(df), keys, order)


# Why a raw bar is left out, in the order in which the reasons are looked for.
NO_SYMBOL, BAD_DAY, NO_PRICE, BAD_PRICE = "no symbol", "bad day", "no price", "bad price"


def tag_bars(raw: DataFrame, ticker: str = "ticker", price: str = "old_price", when: str = "date",
             keep: Sequence[str] = ()) -> DataFrame:
    """Raw bars -> ``(ticker, old_price, date, *keep, reason)``, coerced in one pass.

    ``reason`` is NULL for a usable bar; else it names what is wrong: no symbol, a day
    that is missing or cannot be read, no price (missing, blank or NaN), or a
    price that is no number.
    """
    symbol, number, day = F.col(ticker).cast("string"), coerce_price(raw, price), coerce_when(raw, when)
    silent = F.coalesce(F.lower(F.trim(F.col(price).cast("string"))).isin("", "nan"), F.lit(True))
    # A generator of one row: a filter on the reason is not copied, with all that it
    # needs, to the scan, so each value is coerced once.
    read = raw.select(*keep, F.inline(F.array(F.struct(
        symbol.alias("ticker"), number.alias("old_price"), day.alias("date"), silent.alias("_silent")))))
    reason = (F.when(F.col("ticker").isNull() | (F.trim("ticker") == ""), NO_SYMBOL)
               .when(F.col("date").isNull(), BAD_DAY)
               .when(F.col("_silent"), NO_PRICE)
               .when(F.col("old_price").isNull(), BAD_PRICE))
    return read.select("ticker", "old_price", "date", *keep, reason.alias("reason"))


def split_bars(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable bars, rejected bars with their reason) of tagged ones."""
    good = F.col("reason").isNull()
    return tagged.where(good).drop("reason"), tagged.where(~good)
