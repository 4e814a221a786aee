"""The reference's own test cases, re-expressed on DataFrames."""

import datetime as dt

import pytest

from fxledger.functions.dates import collection_days, collection_window
from fxledger.functions.ranges import missing_ranges
from fxledger.operators.convert import convert_prices
from fxledger.schema import ENRICHED
from fxledger.session import scratch_path
from fxledger.sources.store import PriceStore

D = dt.date


def window(spark, as_of, years):
    row = (spark.createDataFrame([(as_of,)], "as_of date")
           .select(collection_window("as_of", years).alias("w")).first())
    return row.w.days, row.w.start, row.w.end


def test_collection_window_is_ordered(spark):
    days, start, end = window(spark, D(2026, 12, 3), 0.1)
    assert days == 37
    assert start < end


@pytest.mark.parametrize("as_of,years,days,start,end", [
    (D(2026, 1, 4), 0.1, 37, D(2025, 11, 28), D(2026, 1, 2)),
    (D(2025, 12, 28), 0.16, 58, D(2025, 10, 31), D(2025, 12, 24)),
    (D(2026, 1, 1), 0.08, 29, D(2025, 12, 3), D(2025, 12, 31)),
])
def test_collection_window_table(spark, as_of, years, days, start, end):
    assert window(spark, as_of, years) == (days, start, end)


@pytest.mark.parametrize("years", [0, -1, "1", True])
def test_collection_window_rejects_bad_years(years):
    with pytest.raises(ValueError):
        collection_days(years)


def ranges(spark, start, end, first, last):
    df = spark.createDataFrame([(start, end, first, last)], "s date, e date, f date, l date")
    got = df.select(missing_ranges("s", "e", "f", "l").alias("r")).first().r
    return [(x.gap_start, x.gap_end) for x in got]


def test_missing_ranges_empty_store(spark):
    assert ranges(spark, D(2026, 1, 1), D(2026, 1, 10), None, None) == [
        (D(2026, 1, 1), D(2026, 1, 10))]


def test_missing_ranges_both_sides(spark):
    assert ranges(spark, D(2026, 1, 1), D(2026, 1, 10), D(2026, 1, 3), D(2026, 1, 8)) == [
        (D(2026, 1, 1), D(2026, 1, 2)), (D(2026, 1, 9), D(2026, 1, 10))]


@pytest.mark.parametrize("first,last,expected", [
    (D(2025, 12, 1), D(2026, 2, 1), []),                                  # covered
    (D(2026, 1, 8), D(2026, 1, 3), [(D(2026, 1, 1), D(2026, 1, 2)),      # reversed bounds
                                    (D(2026, 1, 9), D(2026, 1, 10))]),
    (D(2026, 2, 1), D(2026, 2, 5), [(D(2026, 1, 1), D(2026, 1, 10))]),   # store after
    (D(2025, 1, 1), D(2025, 2, 5), [(D(2026, 1, 1), D(2026, 1, 10))]),   # store before
])
def test_missing_ranges_more(spark, first, last, expected):
    assert ranges(spark, D(2026, 1, 1), D(2026, 1, 10), first, last) == expected


def test_missing_ranges_start_after_end(spark):
    assert ranges(spark, D(2026, 1, 10), D(2026, 1, 1), None, None) == []


def enriched(spark, rows):
    return spark.createDataFrame(
        [(t, p, d, i, ty, c) for i, (t, p, d, ty, c) in enumerate(rows)],
        "ticker string, old_price double, date date, ord long, type string, currency string"
    ).select(*[f.name for f in ENRICHED.fields])


def test_convert_usd_and_gbp(spark):
    df = enriched(spark, [
        ("AAPL", 100.0, D(2026, 1, 2), "EQUITY", "USD"),
        ("AAPL", 110.0, D(2026, 1, 3), "EQUITY", "USD"),
        ("VUKG.L", 200.0, D(2026, 1, 2), "ETF", "GBP"),
        ("GBP=X", 0.8, D(2026, 1, 2), "CURRENCY", "GBP"),
        ("GBP=X", 0.79, D(2026, 1, 3), "CURRENCY", "GBP"),
    ])
    out = {(r.ticker, r.date): r.price for r in convert_prices(df).collect()}
    assert out[("AAPL", D(2026, 1, 2))] == pytest.approx(80.0, abs=1e-6)
    assert out[("AAPL", D(2026, 1, 3))] == pytest.approx(86.9, abs=1e-6)
    assert out[("VUKG.L", D(2026, 1, 2))] == pytest.approx(200.0, abs=1e-6)
    assert out[("GBP=X", D(2026, 1, 2))] == 0.8
    assert out[("GBP=X", D(2026, 1, 3))] == 0.79
    assert len(out) == 5


def test_store_round_trip(spark):
    bars = spark.createDataFrame([("TEST", 1.23, D(2026, 1, 1)), ("TEST", 1.24, D(2026, 1, 2))],
                                 "ticker string, old_price double, date date")
    store = PriceStore(spark, scratch_path(spark, "test-store"), buckets=4)
    store.save(bars)
    loaded = store.bars()
    assert loaded.count() == 2
    assert set(loaded.columns) == {"ticker", "old_price", "date"}
    status = store.status(spark.createDataFrame([("TEST",), ("NOPE",)], "ticker string"))
    assert {r.ticker: r.status for r in status.collect()} == {"TEST": "loaded",
                                                            "NOPE": "not_found"}
