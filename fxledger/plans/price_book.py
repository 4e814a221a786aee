"""The whole run.

requests -> validated instruments (+ FX pairs) -> collection window -> listing
clip -> stored history + bars fetched for the missing ranges (upsert) -> FX
calendar fill -> provisional quotes -> type/currency -> conversion -> export
rows, with the rows that found no rate and the rejected requests beside them.

The window is computed once, as literal days, so it reaches the scan of the
landing bars.  A few bounded or stored tables are made while the plan is built:
the instrument set and the rate domain (measured, for their broadcasts) and the
enriched history.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from fxledger.constants import DEFAULT_COLLECTION_YEARS, DEFAULT_MAX_AGE_DAYS, HOME_CURRENCY
from fxledger.functions.currency import is_fx_symbol
from fxledger.functions.dates import collection_days, roll_day
from fxledger.operators import clean, convert, fill
from fxledger.operators import history as hist
from fxledger.operators import instruments as instr
from fxledger.operators.joins import MAX_BROADCAST_BYTES, broadcast_if, sized
from fxledger.session import scratch_path, write_scratch
from fxledger.sources.export import export_rows, write_csv
from fxledger.sources.store import PriceStore


class EmptyBook(ValueError):
    """No requested symbol is valid, or none has a bar."""


@dataclass
class Book:
    """The results of one run."""

    rows: DataFrame         # ticker, price, date text
    unresolved: DataFrame   # ticker, date, currency, fx_ticker of rows without a rate
    rejects: DataFrame      # pos, ticker, reason of requests that were dropped
    bar_rejects: DataFrame | None = None  # landing bars left out, with the reason


def self_check(spark: SparkSession, requests: DataFrame, as_of: dt.date, years: float) -> None:
    """Startup sanity: symbols requested, a window that starts before it ends,
    and a store round trip in the shared folder that keeps its rows."""
    if requests.limit(1).count() == 0:
        raise ValueError("no symbols requested")
    start, end = book_window(as_of, years)
    if not start < end:
        raise ValueError(f"empty collection window {start}..{end}")
    store = PriceStore(spark, scratch_path(spark, "self-check"), buckets=1)
    probe = spark.range(5).select(
        F.lit("PROBE").alias("ticker"), (F.col("id") + 0.5).alias("old_price"),
        F.date_add(F.lit(dt.date(2000, 2, 27)), F.col("id").cast("int")).alias("date"))
    store.save(probe)
    if sorted(store.bars().collect()) != sorted(probe.collect()):  # five rows
        raise RuntimeError("price store round trip changed rows")


def book_window(as_of: dt.date, years: float) -> tuple[dt.date, dt.date]:
    """(start, end) of the collection window, as plain days."""
    return (roll_day(as_of - dt.timedelta(days=collection_days(years)), "start"),
            roll_day(as_of, "end"))


def gather_history(store: DataFrame, landing: DataFrame | None, targets: DataFrame,
                   as_of: dt.date, small_targets: bool = False,
                   window: tuple[dt.date, dt.date] | None = None) -> DataFrame:
    """Stored bars of the target symbols (one per symbol-day), plus landing
    bars for the day ranges the store lacks inside each symbol's fetch range;
    a fetched bar wins over a stored one.

    ``small_targets`` says the target list is within a proven size bound:
    then the targets and the gaps (at most two per target) are broadcast, so
    neither the store nor the landing table is shuffled to meet them.
    ``window`` bounds every fetch range, so it goes into the landing scan.
    """
    names = broadcast_if(targets.select("ticker"), small_targets)
    stored = store.join(names, "ticker", "left_semi")
    if landing is None:
        return clean.last_complete(stored) if "ord" in stored.columns else stored
    if window is not None:
        landing = hist.scan_range(landing, *window)
    ranges = targets.select("ticker", F.col("fetch_start").alias("start"),
                            F.col("fetch_end").alias("end"))
    cover = hist.coverage(clean.drop_incomplete(stored))
    gaps = broadcast_if(hist.missing_ranges_table(ranges, cover, as_of), small_targets)
    fetched = hist.scan_ranges(landing, gaps, "gap_start", "gap_end")
    return hist.upsert(stored, fetched)


def landing_bars(landing: DataFrame, names: DataFrame, window: tuple[dt.date, dt.date]) -> DataFrame:
    """Landing bars of a window, and those without a day, tagged with the reason why a
    bad one is left out.  Good bars of other symbols are dropped here; a bad one without
    a symbol stays."""
    start, end = window
    day = F.col("date")
    near = landing.where(((day >= F.lit(start)) & (day <= F.lit(end))) | day.isNull())
    tagged = clean.tag_bars(near, keep=[c for c in ("ord",) if c in landing.columns])
    asked = names.select(F.col("ticker").alias("_asked"))
    return (tagged.join(asked, F.col("ticker") == F.col("_asked"), "left")
            .where(F.col("_asked").isNotNull() | (F.col("reason") == clean.NO_SYMBOL)).drop("_asked"))


def _finish(bars: DataFrame, full: DataFrame, as_of: dt.date, start: dt.date, home: str,
            minor_units: Mapping[str, float] | None, on_missing: str,
            name: str, last: DataFrame | None = None) -> convert.Conversion:
    """Fill, quote, cut, enrich and prepare the conversion of gathered bars.

    The last day of a symbol is taken before the cut; securities before
    ``start`` are never exported, so they are cut before the history is
    written, while FX rows keep their past for the as-of.  ``last`` names the last day
    of each symbol where the bars at hand are cut already.
    """
    quotes = fill.provisional_quotes(bars, full, as_of, last)
    filled = fill.calendar_fill(bars).drop("filled")
    filled = filled.where(is_fx_symbol("ticker") | (F.col("date") >= F.lit(start)))
    # One row per symbol-day from here on, so the arrival order is immaterial.
    enriched = write_scratch(convert.enrich(filled.unionByName(quotes), full), name)
    conv = convert.prepare(enriched.withColumn("ord", F.lit(0).cast("long")), home, minor_units)
    if on_missing == "raise":
        n = conv.unresolved.count()
        if n:
            raise convert.UnresolvedRates(f"{n} rows have no FX rate after the back fill")
    return conv


def _instruments(requests, instruments, home, minor_units, max_broadcast_bytes):
    """(full set, whether it may be broadcast); stops when no symbol is valid."""
    validated = instr.validate(requests, instruments)
    full, small = sized(instr.full_instrument_set(validated, instruments, home, minor_units),
                        max_broadcast_bytes)
    if full.where(F.col("pos").isNotNull()).isEmpty():
        raise EmptyBook("no requested symbol is valid")
    return broadcast_if(full, small), small


def _check_missing(on_missing: str) -> None:
    if on_missing not in ("quarantine", "raise"):
        raise ValueError("on_missing must be 'quarantine' or 'raise'")


def _unresolved(conv: convert.Conversion) -> DataFrame:
    return conv.unresolved.select("ticker", "date", "currency", "fx_ticker")


def book(requests: DataFrame, instruments: DataFrame, store: DataFrame, as_of: dt.date,
         years: float = DEFAULT_COLLECTION_YEARS, landing: DataFrame | None = None,
         home: str = HOME_CURRENCY, minor_units: Mapping[str, float] | None = None,
         sort: bool = False, on_missing: str = "quarantine",
         max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> Book:
    """Export rows of the requested symbols, over a store that is a DataFrame,
    with the quarantine of rows without a rate and the rejected requests.

    ``as_of`` is "today"; it is always given explicitly.  ``on_missing``:
    "quarantine" leaves rows without a rate out of the export (they are in
    ``unresolved``), "raise" stops the run with their number.  A run without a
    valid symbol, or without any bar, stops with ``EmptyBook``.
    """
    _check_missing(on_missing)
    start, end = book_window(as_of, years)
    full, small = _instruments(requests, instruments, home, minor_units, max_broadcast_bytes)
    targets = hist.clip_to_listing(full, start, end)
    bars = write_scratch(gather_history(store, landing, targets, as_of, small, (start, end)).select(
        "ticker", "old_price", "date"), "price-book-bars")
    if bars.isEmpty():
        raise EmptyBook("no bar of any requested symbol")
    conv = _finish(bars, full, as_of, start, home, minor_units, on_missing, "price-book-history")
    bad = None
    if landing is not None:
        bad = clean.split_bars(landing_bars(landing, targets, (start, end)))[1]
    return Book(export_rows(conv.converted, start, sort=sort), _unresolved(conv),
                instr.rejects(requests, instruments), bad)


def price_book(*args, **kwargs) -> DataFrame:
    """The export rows ``(ticker, price, date text)`` of ``book``."""
    return book(*args, **kwargs).rows


def run_book(requests: DataFrame, instruments: DataFrame, store: PriceStore,
             landing: DataFrame, as_of: dt.date, out_path: str,
             years: float = DEFAULT_COLLECTION_YEARS,
             max_age_days: int = DEFAULT_MAX_AGE_DAYS, now: dt.datetime | None = None,
             home: str = HOME_CURRENCY, minor_units: Mapping[str, float] | None = None,
             on_missing: str = "quarantine", max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
             check: bool = True) -> Book:
    """The whole run with the store kept on disk.

    Run the startup self-check (``check``), validate the requests, find the
    day ranges the store lacks, fetch them from ``landing`` and upsert them
    into ``store`` (only touched partitions are rewritten; nothing is written
    when nothing was fetched).  The gaps come from the store's kept coverage, so the
    history is not scanned for them; of securities only the months of the window are
    read again, of FX pairs all.  Landing bars are read once: the fetched ones and the
    bad ones, with their reason, are written together.  Then fill, quote, convert, write the sorted
    headerless CSV to ``out_path``, the quarantine and the rejects beside it
    (``-unresolved``, ``-rejects`` and ``-bar-rejects``, Parquet), and apply the retention.  See
    ``book`` for ``on_missing`` and ``EmptyBook``; a run that stops so writes no
    output and applies no retention.  The rows come from the converted table,
    which is written once to the shared folder and feeds the CSV too.
    """
    _check_missing(on_missing)
    if check:
        self_check(requests.sparkSession, requests, as_of, years)
    start, end = book_window(as_of, years)
    full, small = _instruments(requests, instruments, home, minor_units, max_broadcast_bytes)
    targets = hist.clip_to_listing(full, start, end)
    names = broadcast_if(targets.select("ticker"), small)
    ranges = targets.select("ticker", F.col("fetch_start").alias("start"),
                            F.col("fetch_end").alias("end"))
    gaps = broadcast_if(hist.missing_ranges_table(ranges, store.coverage(), as_of), small).select(
        F.col("ticker").alias("_t"), "gap_start", "gap_end")
    near = landing_bars(landing, names, (start, end))
    met = near.join(gaps, (F.col("ticker") == F.col("_t")) & (F.col("date") >= F.col("gap_start"))
                    & (F.col("date") <= F.col("gap_end")), "left")
    seen = write_scratch(met.where(F.col("_t").isNotNull() | F.col("reason").isNotNull())
                         .select(*near.columns), "fetched")
    fetched, bad = clean.split_bars(seen)
    if not fetched.isEmpty():
        store.upsert(fetched)
    pair = is_fx_symbol("ticker")
    bars = (store.bars(since=start).where(~pair).unionByName(store.bars().where(pair))
            .join(names, "ticker", "left_semi"))
    last = store.coverage().join(names, "ticker", "left_semi")
    if last.isEmpty():
        raise EmptyBook("no bar of any requested symbol")
    conv = _finish(bars, full, as_of, start, home, minor_units, on_missing, "run-book-history", last)
    converted = write_scratch(conv.converted, "run-book-converted")
    if not write_csv(export_rows(converted, start, sort=True), out_path):
        raise EmptyBook("nothing to export from the start day on")
    unresolved = _unresolved(conv)
    rejected = instr.rejects(requests, instruments)
    unresolved.write.mode("overwrite").parquet(f"{out_path}-unresolved")
    rejected.write.mode("overwrite").parquet(f"{out_path}-rejects")
    bad.write.mode("overwrite").parquet(f"{out_path}-bar-rejects")
    store.expire(now, max_age_days)
    return Book(export_rows(converted, start), unresolved, rejected, bad)
