"""Registered queries: one per operator of the inventory.

Each takes ``(spark, sf_dir)``, reads the driver tables through the fixtures
and returns a DataFrame.  Column names and types match the oracle SQL in
``fxledger.plans.oracle``.  Parameters (days, thresholds) are in ``params``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fxledger.functions.currency import fx_symbol
from fxledger.functions.dates import (
    business_day_count, coerce_day, collection_window, epoch_to_day, roll_business_day,
)
from fxledger.functions.numeric import coerce_numeric
from fxledger.operators import clean, convert, fill, history, instruments
from fxledger.operators.joins import bounded_broadcast
from fxledger.operators.position import with_position
from fxledger.plans import params as P
from fxledger.plans.price_book import Book, book, run_book
from fxledger.session import ensure_checkpoint_dir, ensure_utc, scratch_path, write_scratch
from fxledger.sources import fixtures as fx
from fxledger.sources.export import export_rows, read_csv, write_csv
from fxledger.sources.store import PriceStore

Query = Callable[[SparkSession, str], DataFrame]
# Type and currency are attributes of the symbol, so they ride in the key.
SYMBOL_DAY = ("ticker", "date", "type", "currency")
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    name = fn.__name__.removeprefix("q_")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_utc(spark)
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)

    run.__name__ = name
    run.__doc__ = fn.__doc__
    QUERIES[name] = run
    return run


# -- shared inputs --------------------------------------------------------------

def deduped_raw(spark: SparkSession, sf_dir: str, with_eur: bool = True,
                materialise: bool = True) -> DataFrame:
    """Conversion input: keep-last per symbol-day, written once to the shared
    folder as the store the conversion reads (its size check and its final
    join both read the table instead of recomputing the dedupe).  A query
    that reads it once only keeps it lazy."""
    quotes = fx.fx_bars(spark, sf_dir)
    if not with_eur:
        quotes = quotes.where(F.col("ticker") != P.EUR_PAIR)
    deduped = clean.last_complete(fx.security_bars(spark, sf_dir).unionByName(quotes), SYMBOL_DAY)
    return write_scratch(deduped, "deduped-bars") if materialise else deduped


def store_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security bars as a store: one row per symbol-day (ticker, old_price, date)."""
    bars = fx.security_bars(spark, sf_dir).select("ticker", "old_price", "date", "ord")
    return clean.last_complete(bars).select("ticker", "old_price", "date")


def instrument_table(spark: SparkSession, sf_dir: str, with_fx: bool = False) -> DataFrame:
    meta = fx.instrument_meta(spark, sf_dir)
    if with_fx:
        meta = meta.unionByName(fx.fx_instrument_meta(spark, sf_dir))
    return instruments.normalise_instruments(meta, order="s_suppkey")


def event_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.event_bars(spark, sf_dir)


def stored_events(spark: SparkSession, sf_dir: str, last_day) -> DataFrame:
    """The stored slice of the event store: what had arrived by ``last_day``."""
    return event_store(spark, sf_dir).where(F.col("date") <= F.lit(last_day).cast("date"))


# -- sources, projections, casts -----------------------------------------------

@query
def q_bar_normalise(spark, sf_dir):
    """Raw ticks -> (ticker, old_price, date)."""
    ev = fx.table(spark, sf_dir, "events")
    return clean.normalise_bars(ev, F.concat(F.lit("U"), F.col("user_id").cast("string")),
                                "value", "ts")


@query
def q_coerce_numeric(spark, sf_dir):
    """Text prices -> double, junk -> NULL."""
    t = fx.text_prices(spark, sf_dir)
    return t.select("l_orderkey", "l_linenumber", "l_partkey",
                    coerce_numeric("price_text").alias("old_price"))


@query
def q_coerce_day(spark, sf_dir):
    """Day text (day-first or ISO) -> UTC day, junk -> NULL."""
    li = fx.table(spark, sf_dir, "lineitem")
    ln = F.col("l_linenumber")
    text = (F.when(ln == 7, F.lit("n/a"))
             .when(ln == 6, F.date_format("l_shipdate", "yyyy-MM-dd"))
             .otherwise(F.date_format("l_shipdate", "dd/MM/yyyy")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     coerce_day(text, day_first=True).alias("date"))


@query
def q_normalise_epoch(spark, sf_dir):
    """Epoch seconds / milliseconds / negative seconds -> UTC day."""
    ev = fx.table(spark, sf_dir, "events")
    secs = F.unix_seconds(F.col("ts").cast("timestamp"))
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    k = F.col("event_id") % 3
    value = F.when(k == 0, secs).when(k == 1, millis).otherwise(-secs)
    return ev.select("event_id", value.alias("epoch_value"), epoch_to_day(value).alias("date"))


@query
def q_drop_incomplete(spark, sf_dir):
    """drop bars missing the day, symbol or price (NULL or NaN)."""
    t = fx.text_prices(spark, sf_dir)
    bars = t.select("l_orderkey", "l_linenumber", "l_partkey",
                    F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
                    coerce_numeric("price_text").alias("old_price"),
                    F.col("l_shipdate").cast("date").alias("date"))
    return clean.drop_incomplete(bars)


@query
def q_dedupe_last(spark, sf_dir):
    """Keep the last arrival per symbol-day."""
    return clean.last_complete(fx.security_bars(spark, sf_dir), SYMBOL_DAY).drop("ord")


@query
def q_split_by_type(spark, sf_dir):
    """securities vs FX rows; a missing type counts as a security."""
    inst = fx.instrument_meta(spark, sf_dir).select("ticker", F.col("quote_type").alias("type"))
    px = fx.security_bars(spark, sf_dir).drop("type").join(inst, "ticker", "left")
    rows = px.unionByName(fx.fx_bars(spark, sf_dir))
    sec, fxr = convert.split_by_type(rows)
    cols = ["ticker", "date", "old_price", "type"]
    return (sec.select(*cols, F.lit("security").alias("side"))
            .unionByName(fxr.select(*cols, F.lit("fx").alias("side"))))


@query
def q_first_rate(spark, sf_dir):
    """A1: one rate per FX symbol and day, the first arrival."""
    return convert.first_rate(fx.fx_bars(spark, sf_dir))


@query
def q_fx_symbol(spark, sf_dir):
    """FX pair of each instrument currency."""
    inst = fx.instrument_meta(spark, sf_dir)
    return inst.select("ticker", "currency", fx_symbol("currency").alias("fx_ticker"))


@query
def q_enrich_prices(spark, sf_dir):
    """Attach type and currency from the instruments (left join)."""
    bars = fx.security_bars(spark, sf_dir).select("ticker", "old_price", "date")
    return convert.enrich(bars, instrument_table(spark, sf_dir))


# -- conversion -------------------------------------------------------------------

def _conversion(spark, sf_dir, with_eur=True, materialise=True) -> convert.Conversion:
    return convert.prepare(deduped_raw(spark, sf_dir, with_eur, materialise))


@query
def q_asof_rates(spark, sf_dir):
    """Latest rate on or before each security day (NULL before the first)."""
    conv = _conversion(spark, sf_dir)
    asof = bounded_broadcast(convert.asof_rates(convert.rate_domain(conv.securities),
                                                conv.rates))
    return (conv.securities.join(asof, ["fx_ticker", "date"], "left")
            .select("ticker", "date", "fx_ticker", "rate"))


@query
def q_backfill_rates(spark, sf_dir):
    """Leading days take the rate of the next security day that has one."""
    conv = _conversion(spark, sf_dir)
    return (conv.securities.join(conv.pair_rates, ["fx_ticker", "date"], "left")
            .select("ticker", "date", "fx_ticker", "rate", "backfilled"))


@query
def q_convert_prices(spark, sf_dir):
    """Prices in the home currency, FX rows passed through."""
    return convert.convert_prices(deduped_raw(spark, sf_dir))


@query
def q_unresolved_rates(spark, sf_dir):
    """Q1: rows left without a rate when the EUR quotes are missing."""
    conv = _conversion(spark, sf_dir, with_eur=False)
    return conv.unresolved.select("ticker", "date", "currency", "fx_ticker")


@query
def q_conversion_check(spark, sf_dir):
    """Prices of a written conversion that disagree with old price x rate.
    The prices of every 13th of a month are written wrong, to be found."""
    rated = _conversion(spark, sf_dir).rated.where(F.col("rate").isNotNull())
    wrong = F.when(F.dayofmonth("date") == 13, F.lit(1.25)).otherwise(F.lit(1.0))
    stored = write_scratch(rated.select(
        "ticker", "date", "old_price", "rate",
        (F.col("old_price") * F.col("rate") * wrong).alias("price")), "stored-conversion")
    return convert.conversion_check(stored)


@query
def q_conversion_summary(spark, sf_dir):
    """A5: rows converted through a pair, home rows, unresolved rows."""
    return convert.conversion_summary(_conversion(spark, sf_dir).rated)


@query
def q_date_coverage(spark, sf_dir):
    """U4: security days, FX days, common and one-sided days."""
    conv = _conversion(spark, sf_dir, materialise=False)
    return convert.date_coverage(conv.securities, conv.fx_rows)


# -- calendar ----------------------------------------------------------------------

def _order_days(spark, sf_dir) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderdate").cast("date").alias("as_of")).distinct()


@query
def q_business_day_roll(spark, sf_dir):
    """Roll each day forward / backward to a business day."""
    return _order_days(spark, sf_dir).select(
        F.col("as_of").alias("day"),
        roll_business_day("as_of", "start").alias("rolled_start"),
        roll_business_day("as_of", "end").alias("rolled_end"))


@query
def q_business_day_count(spark, sf_dir):
    """Weekdays between each symbol's first and last bar."""
    cov = history.coverage(store_bars(spark, sf_dir))
    return cov.select("ticker", "first_date", "last_date",
                      business_day_count("first_date", "last_date").alias("n_business_days"))


@query
def q_collection_window(spark, sf_dir):
    """Collection window for each order day taken as 'today'."""
    w = collection_window("as_of", P.COLLECTION_YEARS)
    return (_order_days(spark, sf_dir).select("as_of", w.alias("w"))
            .select("as_of", F.col("w.days").alias("n_days"),
                    F.col("w.start").alias("start_date"), F.col("w.end").alias("end_date"),
                    business_day_count("w.start", "w.end").alias("n_business_days")))


# -- FX fill and provisional quotes ---------------------------------------------

def _fx_store(spark, sf_dir) -> DataFrame:
    return clean.last_complete(fx.fx_bars(spark, sf_dir).select("ticker", "old_price", "date",
                                                               "ord")).drop("ord")


@query
def q_fx_calendar_fill(spark, sf_dir):
    """Every calendar day of each FX series, last value carried."""
    return fill.calendar_fill(_fx_store(spark, sf_dir))


@query
def q_fx_fill_summary(spark, sf_dir):
    """U8: days created by the fill per FX series."""
    return fill.fill_summary(fill.calendar_fill(_fx_store(spark, sf_dir)))


@query
def q_append_provisional(spark, sf_dir):
    """today's bid as a provisional bar where the last bar is older."""
    return fill.append_provisional(store_bars(spark, sf_dir), instrument_table(spark, sf_dir),
                                   P.QUOTE_DAY)


# -- instruments ------------------------------------------------------------------

@query
def q_instrument_normalise(spark, sf_dir):
    """Metadata -> INSTRUMENT."""
    return instrument_table(spark, sf_dir)


@query
def q_validate_instruments(spark, sf_dir):
    """Requested symbols with usable metadata, first request wins."""
    return instruments.validate(fx.requests(spark, sf_dir), instrument_table(spark, sf_dir))


@query
def q_request_rejects(spark, sf_dir):
    """Requested symbols dropped by the validation, with the reason."""
    return instruments.rejects(fx.requests(spark, sf_dir), instrument_table(spark, sf_dir))


@query
def q_required_fx(spark, sf_dir):
    """FX pairs needed by the validated instruments."""
    validated = instruments.validate(fx.requests(spark, sf_dir), instrument_table(spark, sf_dir))
    return instruments.required_fx(validated).orderBy("fx_ticker")


@query
def q_full_instrument_set(spark, sf_dir):
    """Validated instruments plus the FX pairs they need."""
    inst = instrument_table(spark, sf_dir, with_fx=True)
    validated = instruments.validate(fx.requests(spark, sf_dir), inst)
    return instruments.full_instrument_set(validated, inst)


# -- store and history ------------------------------------------------------------

@query
def q_store_coverage(spark, sf_dir):
    """A2/A4: first day, last day and days stored per symbol."""
    return history.coverage(store_bars(spark, sf_dir))


@query
def q_store_status(spark, sf_dir):
    """Loaded / empty / not_found for each requested symbol, from a store on disk
    whose files of one month were overwritten with junk."""
    tickers = instruments.first_requests(fx.requests(spark, sf_dir)).select("ticker")
    raw = fx.text_prices(spark, sf_dir).select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
        F.col("price_text").alias("old_price"), F.col("l_shipdate").alias("date"))
    store = PriceStore(spark, scratch_path(spark, "store-status"), buckets=P.STORE_BUCKETS)
    store.save(raw)
    fx.damage_month(store, P.DAMAGED_MONTH)
    return store.status(tickers)


@query
def q_history_summary(spark, sf_dir):
    """Total rows and symbols with data."""
    return history.history_summary(store_bars(spark, sf_dir))


@query
def q_clip_to_listing(spark, sf_dir):
    """Skip instruments listed after the end; fetch from the listing day."""
    return history.clip_to_listing(instrument_table(spark, sf_dir), P.CLIP_START, P.CLIP_END)


@query
def q_missing_ranges(spark, sf_dir):
    """Requested days each symbol's store lacks."""
    stored = stored_events(spark, sf_dir, P.EVENTS_STORED_TO).where(
        F.col("date") >= F.lit(P.EVENTS_STORED_FROM).cast("date"))
    cover = history.coverage(clean.dedupe_last(stored.select("ticker", "old_price", "date",
                                                             "ord")))
    targets = (event_store(spark, sf_dir).select("ticker").distinct()
               .select("ticker", F.lit(P.EVENTS_FROM).cast("date").alias("start"),
                       F.lit(P.EVENTS_TO).cast("date").alias("end")))
    return history.missing_ranges_table(targets, cover, P.EVENTS_AS_OF)


@query
def q_history_range_scan(spark, sf_dir):
    """S3: each symbol's bars inside its own inclusive day range, from a store on disk;
    the ranges prune its partitions at run time."""
    ranges = history.clip_to_listing(instrument_table(spark, sf_dir), P.CLIP_START, P.CLIP_END)
    store = PriceStore(spark, scratch_path(spark, "range-store"), buckets=P.STORE_BUCKETS)
    store.save(fx.security_bars(spark, sf_dir))
    return store.for_ranges(ranges, "fetch_start", "fetch_end").select("ticker", "date", "old_price")


@query
def q_store_gaps(spark, sf_dir):
    """A2/S4 kept up to date: gaps of a store after a save, an upsert and a retention
    run, from its kept coverage alone, beside what a recount of the bars gives."""
    ev = event_store(spark, sf_dir)
    store = PriceStore(spark, scratch_path(spark, "gap-store"), buckets=P.STORE_BUCKETS)
    early = ev.where((F.col("date") >= F.lit(P.EVENTS_STORED_FROM)) & (F.col("date") <= F.lit(P.EVENTS_FRESH_FROM)))
    odd = F.col("ord") % 2 == 1
    store.save(early.where(odd), written_at=P.EXPIRY_NOW)
    store.upsert(ev.where((F.col("date") >= F.lit(P.EVENTS_FRESH_FROM))
                          & (F.col("date") <= F.lit(P.EVENTS_STORED_TO)) & ~odd), written_at=P.EXPIRY_NOW)
    targets = (ev.select("ticker").distinct()
               .select("ticker", F.lit(P.EVENTS_FROM).alias("start"), F.lit(P.EVENTS_TO).alias("end")))
    kept, counted = store.coverage(), history.coverage(store.bars())
    gaps = history.missing_ranges_table(targets, kept, P.EVENTS_AS_OF)
    n = counted.select("ticker", F.col("first_date").alias("_f"), F.col("last_date").alias("_l"),
                       F.col("n_days").alias("_n"))
    same = ((F.col("first_date") == F.col("_f")) & (F.col("last_date") == F.col("_l"))
            & (F.col("n_days") == F.col("_n")))
    checked = kept.join(n, "ticker", "full").select("ticker", "n_days", same.alias("as_recounted"))
    return gaps.join(checked, "ticker", "left")


@query
def q_upsert_prices(spark, sf_dir):
    """Stored bars merged with fresh ones, the fresh bar wins."""
    stored = stored_events(spark, sf_dir, P.EVENTS_STORED_TO)
    fresh = (event_store(spark, sf_dir)
             .where(F.col("date") >= F.lit(P.EVENTS_FRESH_FROM).cast("date"))
             .withColumn("old_price", F.col("old_price") * F.lit(P.FRESH_FACTOR)))
    return history.upsert(stored, fresh).select("ticker", "date", "old_price")


@query
def q_store_roundtrip(spark, sf_dir):
    """Bars written to the store (bucketed Parquet) and read back."""
    store = PriceStore(spark, scratch_path(spark, "store-roundtrip"), buckets=P.STORE_BUCKETS)
    store.save(event_store(spark, sf_dir).select("ticker", "old_price", "date", "ord"), written_at=P.EXPIRY_NOW)
    return store.load()


@query
def q_store_expiry(spark, sf_dir):
    """Symbols whose last write is older than the maximum age are removed from
    the store on disk."""
    ev = event_store(spark, sf_dir)
    bars = ev.select("ticker", "old_price", "date", "ord")
    last_write = ev.groupBy("ticker").agg(F.max("ts").cast("timestamp").alias("written_at"))
    store = PriceStore(spark, scratch_path(spark, "store-expiry"), buckets=P.STORE_BUCKETS)
    store.save(bars.join(last_write, "ticker"))
    store.expire(P.EXPIRY_NOW, P.EXPIRY_DAYS)
    return store.bars().select("ticker", "date", "old_price")


@query
def q_export_rows(spark, sf_dir):
    """Converted rows from the start day, day as dd/MM/yyyy, with their place
    in the export (newest day first, then by symbol)."""
    return export_rows(convert.convert_prices(deduped_raw(spark, sf_dir)), P.EXPORT_START, position=True)


@query
def q_convert_sorted(spark, sf_dir):
    """O2: converted rows with their place by (date, symbol)."""
    return with_position(convert.convert_prices(deduped_raw(spark, sf_dir)).select("ticker", "price", "date"),
                         "date", "ticker")


@query
def q_export_csv(spark, sf_dir):
    """The sorted headerless CSV, written and read back line by line."""
    path = scratch_path(spark, "export-csv")
    write_csv(export_rows(convert.convert_prices(deduped_raw(spark, sf_dir)), P.EXPORT_START, sort=True), path)
    return read_csv(spark, path)


@query
def q_bar_rejects(spark, sf_dir):
    """Raw text bars that cannot be used, with the reason, in one pass."""
    tagged = clean.tag_bars(fx.text_bars(spark, sf_dir), "ticker", "price_text", "day_text",
                            keep=("l_orderkey", "l_linenumber", "l_partkey"))
    return clean.split_bars(tagged)[1]


def _book(spark: SparkSession, sf_dir: str, with_eur: bool = True) -> Book:
    """The book over raw bars (the landing area) and a store that holds the
    deduplicated bars up to BOOK_STORED_TO."""
    raw = fx.raw_bars(spark, sf_dir).select("ticker", "old_price", "date", "ord")
    store = clean.last_complete(raw.where(F.col("date") <= F.lit(P.BOOK_STORED_TO)))
    inst = instrument_table(spark, sf_dir, with_fx=True)
    if not with_eur:
        inst = inst.where(F.col("ticker") != P.EUR_PAIR)
    return book(fx.requests(spark, sf_dir), inst, store, P.BOOK_AS_OF, P.BOOK_YEARS, landing=raw)


@query
def q_price_book(spark, sf_dir):
    """3.1: requests -> validated instruments -> stored history + fetched gaps
    -> FX fill -> provisional quotes -> conversion -> export rows."""
    return _book(spark, sf_dir).rows


@query
def q_book_unresolved(spark, sf_dir):
    """Q1 in the run: rows of the book left without a rate when the EUR pair has
    no metadata, so that its quotes are never fetched."""
    return _book(spark, sf_dir, with_eur=False).unresolved


@query
def q_book_rejects(spark, sf_dir):
    """D4 in the run: the requests that the book dropped, with the reason."""
    return _book(spark, sf_dir).rejects


@query
def q_price_book_stored(spark, sf_dir):
    """3.1 with the store on disk: gaps fetched from the landing bars are
    upserted into a bucketed Parquet store, the CSV is written, retention runs."""
    raw = fx.raw_bars(spark, sf_dir).select("ticker", "old_price", "date", "ord")
    store = PriceStore(spark, scratch_path(spark, "book-store"), buckets=P.STORE_BUCKETS)
    store.save(clean.last_complete(raw.where(F.col("date") <= F.lit(P.BOOK_STORED_TO))).drop("ord"))
    return run_book(fx.requests(spark, sf_dir), instrument_table(spark, sf_dir, with_fx=True),
                    store, raw, P.BOOK_AS_OF, scratch_path(spark, "book-csv"),
                    years=P.BOOK_YEARS).rows


def queries() -> dict[str, Query]:
    return dict(QUERIES)
