"""Rows as they arrive in practice: missing prices, repeats, bad days, late ends."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from fxledger import EmptyBook, PriceStore, book, run_book
from fxledger.functions.dates import (
    coerce_day, epoch_seconds_to_ts, epoch_to_day, roll_business_day, roll_day, roll_span,
)
from fxledger.operators import clean, convert, fill, history, instruments
from fxledger.plans import params as P
from fxledger.plans import queries as Q
from fxledger.session import scratch_path
from fxledger.sources import fixtures as fx
from fxledger.streaming.ingest import start_ingest

SF = "/root/testdata/sf0.001"
D = dt.date
BARS = "ticker string, old_price double, date date, ord long"


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_arrival_order_of_large_keys(spark, ansi):
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        big = 600_000_000_000
        df = spark.createDataFrame(
            [("A", 1.0, D(2026, 1, 1), big, 1, big), ("A", 2.0, D(2026, 1, 1), big, 2, 1),
             ("A", 3.0, D(2026, 1, 1), big - 1, 7, big)],
            "ticker string, old_price double, date date, o long, l int, p long")
        rows = df.withColumn("ord", fx.arrival(F.col("o"), F.col("l"), F.col("p"))).drop("o", "l", "p")
        last = clean.dedupe_last(rows)
        assert [r.old_price for r in last.collect()] == [2.0]
        assert "HashAggregate" in last._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in last._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def test_roll_over_a_long_run_of_holidays(spark):
    run = [f"12-{d:02d}" for d in range(19, 32)] + ["01-01", "01-02"]
    day = spark.createDataFrame([(D(2025, 12, 19),)], "d date")
    start, end = day.select(roll_business_day("d", "start", run), roll_business_day("d", "end", run)).first()
    assert (start, end) == (D(2026, 1, 5), D(2025, 12, 18))
    assert roll_day(D(2025, 12, 19), "start", run) == start and roll_day(D(2025, 12, 31), "end", run) == end
    every = [(D(2024, 1, 1) + dt.timedelta(days=k)).strftime("%m-%d") for k in range(366)]
    with pytest.raises(ValueError):
        roll_span(every)


def test_literal_roll_equals_column_roll(spark):
    days = [D(2023, 12, 20) + dt.timedelta(days=k) for k in range(40)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select("d", roll_business_day("d", "start"), roll_business_day("d", "end")).collect()
    assert [(roll_day(d, "start"), roll_day(d, "end")) for d, _, _ in got] == [tuple(r)[1:] for r in got]


def test_missing_last_price_keeps_the_good_bar(spark):
    df = spark.createDataFrame([("A", 5.0, D(2026, 1, 1), 1), ("A", None, D(2026, 1, 1), 2)], BARS)
    assert [r.old_price for r in clean.last_complete(df).collect()] == [5.0]


def test_one_instrument_for_each_symbol(spark):
    meta = spark.createDataFrame(
        [("abc", 1, "EQUITY", "USD", 1.0, 1), ("ABC", 1, "EQUITY", "GBP", 2.0, 2), ("Abc", 1, None, None, None, None)],
        "ticker string, first_trade_epoch long, quote_type string, currency string, bid double, n int")
    got = instruments.normalise_instruments(meta, order="n").collect()
    assert [(r.ticker, r.currency, r.bid) for r in got] == [("ABC", "GBP", 2.0)]


def test_bad_values_become_null(spark):
    df = spark.createDataFrame([("01/02/2026",), ("13/02/2026",), ("12:30",), ("2026-02-01 23:59:59",), ("x",)],
                               "s string")
    assert [r[0] for r in df.select(coerce_day("s")).collect()] == [
        D(2026, 1, 2), D(2026, 2, 13), None, D(2026, 2, 1), None]
    assert df.select(coerce_day("s", day_first=True)).first()[0] == D(2026, 2, 1)
    big = spark.createDataFrame([(10**15,), (86400,)], "x long")
    assert [r[0] for r in big.select(epoch_seconds_to_ts("x")).collect()] == [None, dt.datetime(1970, 1, 2)]
    huge = spark.createDataFrame([(1e18,), (1e300,), (-86400.0,)], "x double")
    assert [r[0] for r in huge.select(epoch_to_day("x")).collect()] == [None, None, D(1970, 1, 2)]


def test_fresh_bar_without_order_wins(spark):
    stored = spark.createDataFrame([("A", 1.0, D(2026, 1, 1), 9)], BARS)
    fresh = spark.createDataFrame([("A", 9.0, D(2026, 1, 1), None), ("A", 8.0, D(2026, 1, 2), None)], BARS)
    got = sorted((r.date, r.old_price) for r in history.upsert(stored, fresh).collect())
    assert got == [(D(2026, 1, 1), 9.0), (D(2026, 1, 2), 8.0)]


def test_fill_of_a_repeated_day_invents_nothing(spark):
    df = spark.createDataFrame([("GBP=X", 1.0, D(2026, 1, 1)), ("GBP=X", 2.0, D(2026, 1, 1))],
                               "ticker string, old_price double, date date")
    assert {r.date for r in fill.calendar_fill(df).collect()} == {D(2026, 1, 1)}


# the run

def inputs(spark):
    raw = fx.raw_bars(spark, SF).select("ticker", "old_price", "date", "ord")
    return (fx.requests(spark, SF), Q.instrument_table(spark, SF, with_fx=True),
            clean.last_complete(raw.where(F.col("date") <= F.lit(P.BOOK_STORED_TO))), raw)


def test_book_shows_what_it_left_out(spark):
    req, inst, store, raw = inputs(spark)
    inst = inst.where(F.col("ticker") != P.EUR_PAIR)
    b = book(req, inst, store, P.BOOK_AS_OF, P.BOOK_YEARS, landing=raw)
    assert b.unresolved.count() > 0 and b.rejects.count() > 0
    with pytest.raises(convert.UnresolvedRates):
        book(req, inst, store, P.BOOK_AS_OF, P.BOOK_YEARS, landing=raw, on_missing="raise")
    with pytest.raises(ValueError):
        book(req, inst, store, P.BOOK_AS_OF, P.BOOK_YEARS, landing=raw, on_missing="drop")


def test_book_stops_when_empty(spark):
    req, inst, store, raw = inputs(spark)
    with pytest.raises(EmptyBook):
        book(req, inst.limit(0), store, P.BOOK_AS_OF, P.BOOK_YEARS, landing=raw)
    with pytest.raises(EmptyBook):
        book(req, inst, store.limit(0), P.BOOK_AS_OF, P.BOOK_YEARS, landing=raw.limit(0))


def test_stopped_run_leaves_no_output_and_no_retention(spark):
    req, inst, store, raw = inputs(spark)
    on_disk = PriceStore(spark, scratch_path(spark, "strict-store"), buckets=2)
    on_disk.save(store.drop("ord"), written_at=dt.datetime(2000, 1, 1))
    before = on_disk.bars().count()
    out = scratch_path(spark, "strict-csv")
    with pytest.raises(convert.UnresolvedRates):
        run_book(req, inst.where(F.col("ticker") != P.EUR_PAIR), on_disk, raw, P.BOOK_AS_OF, out,
                 years=P.BOOK_YEARS, on_missing="raise", now=dt.datetime(2030, 1, 1))
    assert not glob.glob(out.removeprefix("file:") + "*") and on_disk.bars().count() >= before


def test_window_reaches_the_landing_scan(spark, tmp_path):
    path = str(tmp_path / "landing")
    raw = fx.raw_bars(spark, SF).select("ticker", "old_price", "date", "ord")
    raw.write.parquet(path)
    from fxledger.plans.price_book import book_window, gather_history
    window = book_window(P.BOOK_AS_OF, P.BOOK_YEARS)
    targets = raw.select("ticker").distinct().select(
        "ticker", F.lit(window[0]).alias("fetch_start"), F.lit(window[1]).alias("fetch_end"))
    df = gather_history(raw.limit(0), spark.read.parquet(path), targets, P.BOOK_AS_OF, True, window)
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(date), IsNotNull(ticker), GreaterThanOrEqual(date" in plan or (
        "GreaterThanOrEqual(date" in plan and "PushedFilters" in plan)


def test_ingest_needs_a_checkpoint(spark):
    with pytest.raises(TypeError):
        start_ingest(spark, "/nowhere", None, None)
