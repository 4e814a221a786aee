
import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from fxledger.functions.dates import (
    business_day_count, coerce_day, epoch_seconds_to_ts, epoch_to_day, roll_business_day,
)
from fxledger.functions.numeric import coerce_numeric
from fxledger.operators import clean, convert, fill, history, instruments
from fxledger.schema import MissingColumns, require_columns
from fxledger.session import scratch_path
from fxledger.sources.export import export_rows, write_csv
from fxledger.sources.store import PriceStore, expire

D = dt.date
ENRICHED = "ticker string, old_price double, date date, ord long, type string, currency string"


def frame(spark, rows):
    return spark.createDataFrame(
        [(t, p, d, i, ty, c) for i, (t, p, d, ty, c) in enumerate(rows)], ENRICHED)


def d(n):
    return D(2026, 1, n)


def rated(spark, rows):
    conv = convert.prepare(frame(spark, rows))
    return {(r.ticker, r.date): r.rate for r in conv.rated.collect()}, conv


def test_asof_uses_last_earlier_rate(spark):
    rates, _ = rated(spark, [("A", 10.0, d(5), "EQUITY", "USD"),
                             ("GBP=X", 0.8, d(2), "CURRENCY", "GBP")])
    assert rates[("A", d(5))] == 0.8


def test_leading_gap_takes_next_security_day_rate(spark):
    rates, _ = rated(spark, [("A", 1.0, d(1), "EQUITY", "USD"),
                             ("A", 1.0, d(4), "EQUITY", "USD"),
                             ("GBP=X", 0.7, d(2), "CURRENCY", "GBP"),
                             ("GBP=X", 0.9, d(3), "CURRENCY", "GBP")])
    assert rates[("A", d(1))] == 0.9
    assert rates[("A", d(4))] == 0.9


def test_two_symbols_keep_their_own_day_rate(spark):
    rows = [(t, 1.0, d(n), "EQUITY", "USD") for t in ("A", "B") for n in (1, 2, 3)]
    rows += [("GBP=X", 0.5, d(2), "CURRENCY", "GBP"), ("GBP=X", 0.6, d(3), "CURRENCY", "GBP")]
    rates, _ = rated(spark, rows)
    for t in ("A", "B"):
        assert (rates[(t, d(1))], rates[(t, d(2))], rates[(t, d(3))]) == (0.5, 0.5, 0.6)


def test_unresolvable_rows_are_quarantined_or_raise(spark):
    rows = [("A", 1.0, d(1), "EQUITY", "USD"), ("B", 2.0, d(1), "EQUITY", "GBP"),
            ("EURGBP=X", 0.9, d(1), "CURRENCY", "GBP")]
    df = frame(spark, rows)
    conv = convert.prepare(df)
    assert [r.ticker for r in conv.unresolved.collect()] == ["A"]
    assert sorted(r.ticker for r in convert.convert_prices(df).collect()) == ["B", "EURGBP=X"]
    with pytest.raises(ValueError):
        convert.convert_prices(df, on_missing="raise")


def test_rates_only_after_prices_stay_unresolved(spark):
    rates, _ = rated(spark, [("A", 1.0, d(1), "EQUITY", "USD"),
                             ("GBP=X", 0.8, d(5), "CURRENCY", "GBP")])
    assert rates[("A", d(1))] is None


def test_pence_and_missing_currency_and_type(spark):
    rows = [("P", 250.0, d(1), "EQUITY", "GBp"), ("N", 3.0, d(1), "EQUITY", None),
            ("T", 4.0, d(1), None, "GBP")]
    out = {r.ticker: r.price for r in convert.convert_prices(frame(spark, rows)).collect()}
    assert out == {"P": pytest.approx(2.5), "T": 4.0}


def test_fx_only_input_returns_rates_as_prices(spark):
    rows = [("GBP=X", 0.8, d(1), "CURRENCY", "GBP"), ("GBP=X", 0.7, d(2), "CURRENCY", "GBP")]
    out = sorted((r.date, r.price) for r in convert.convert_prices(frame(spark, rows)).collect())
    assert out == [(d(1), 0.8), (d(2), 0.7)]


def test_home_currency_is_a_parameter(spark):
    rows = [("A", 10.0, d(1), "EQUITY", "USD"), ("B", 5.0, d(1), "EQUITY", "GBP"),
            ("EUR=X", 0.9, d(1), "CURRENCY", "EUR"), ("GBPEUR=X", 1.2, d(1), "CURRENCY", "EUR")]
    out = {r.ticker: r.price for r in
           convert.convert_prices(frame(spark, rows), home="EUR", minor_units={}).collect()}
    assert out["A"] == pytest.approx(9.0) and out["B"] == pytest.approx(6.0)


def test_first_rate_takes_first_arrival(spark):
    rows = [("GBP=X", 0.8, d(1), "CURRENCY", "GBP"), ("GBP=X", 0.9, d(1), "CURRENCY", "GBP")]
    got = convert.first_rate(frame(spark, rows)).collect()
    assert [(r.fx_ticker, r.rate) for r in got] == [("GBP=X", 0.8)]


def test_duplicate_day_later_arrival_wins(spark):
    df = spark.createDataFrame([("A", 1.0, d(1), 5), ("A", 2.0, d(1), 9), ("A", 3.0, d(1), 7)],
                               "ticker string, old_price double, date date, ord long")
    got = clean.dedupe_last(df).collect()
    assert [(r.old_price, r.ord) for r in got] == [(2.0, 9)]


def test_empty_input_gives_empty_output_of_known_schema(spark):
    out = convert.convert_prices(spark.createDataFrame([], ENRICHED))
    assert out.columns == ["ticker", "price", "date"] and out.count() == 0


def test_required_columns_are_checked(spark):
    df = spark.createDataFrame([("A", 1.0)], "ticker string, old_price double")
    with pytest.raises(MissingColumns):
        convert.convert_prices(df)
    with pytest.raises(MissingColumns):
        require_columns(df, ["ticker", "price", "date"])


def test_provisional_quote_rules(spark):
    bars = spark.createDataFrame([("A", 1.0, d(1)), ("B", 1.0, d(1)), ("C", 1.0, d(1)),
                                  ("E", 1.0, d(9))], "ticker string, old_price double, date date")
    inst = spark.createDataFrame([("A", 5.0), ("B", 0.0), ("C", None), ("E", 7.0)],
                                 "ticker string, bid double")
    out = fill.append_provisional(bars, inst, d(9)).where("provisional").collect()
    assert [(r.ticker, r.old_price, r.date) for r in out] == [("A", 5.0, d(9))]


def test_fx_fill_carries_value_forward(spark):
    bars = spark.createDataFrame([("GBP=X", 0.8, d(1)), ("GBP=X", 0.9, d(4)), ("S", 1.0, d(1)),
                                  ("S", 2.0, d(4))], "ticker string, old_price double, date date")
    out = sorted((r.ticker, r.date, r.old_price, r.filled)
                 for r in fill.calendar_fill(bars).collect())
    assert out == [("GBP=X", d(1), 0.8, False), ("GBP=X", d(2), 0.8, True),
                   ("GBP=X", d(3), 0.8, True), ("GBP=X", d(4), 0.9, False),
                   ("S", d(1), 1.0, False), ("S", d(4), 2.0, False)]


def test_coerce_numeric_text(spark):
    vals = ["12.5", " 12 ", "1.0d", "2f", "NaN", "inf", "-Infinity", "n/a", "", None]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    got = [r.y for r in df.select(coerce_numeric("x").alias("y")).collect()]
    assert got[:4] == [12.5, 12.0, None, None]
    assert got[4] is None and got[5] == float("inf") and got[6] == float("-inf")
    assert got[7:] == [None, None, None]


def test_coerce_day_text(spark):
    vals = ["05/01/2001", "2001-01-05", "2001-01-05T23:30:00", "2024-06-01T00:00:00+01:00", "n/a"]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    got = [r.y for r in df.select(coerce_day("x", day_first=True).alias("y")).collect()]
    assert got == [D(2001, 1, 5), D(2001, 1, 5), D(2001, 1, 5), D(2024, 5, 31), None]


def test_coercions_try_only_text_that_can_be_read(spark):
    vals = ["1e3", "+.5", "0x1p3", "12abc", "INF", "-infinity", "+nan", "\t7\n", "nanf", "3 "]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    assert [r.y for r in df.select(coerce_numeric("x").alias("y")).collect()] == [
        1000.0, 0.5, 8.0, None, float("inf"), float("-inf"), None, 7.0, None, 3.0]
    days = ["1/2/2026", "13/2/2026", "2/13/2026", "-1/2/2026", "1/2/+12026", "1/2/26", "a/b/2026", "//", "1/2",
            "2026-01-05 10:00:00 Europe/London", "2026", " 1/2/2026 ", "1/2/2026x"]
    df = spark.createDataFrame([(v,) for v in days], "x string")
    assert [r.y for r in df.select(coerce_day("x").cast("string").alias("y")).collect()] == [
        "2026-01-02", "2026-02-13", "2026-02-13", None, "+12026-01-02", None, None, None, None, "2026-01-05",
        "2026-01-01", "2026-01-02", None]


def test_epochs(spark):
    df = spark.createDataFrame([(1704067207,), (1704067207123,), (-1704067207,), (None,)], "x long")
    got = [r.y for r in df.select(epoch_to_day("x").alias("y")).collect()]
    assert got == [D(2024, 1, 1)] * 3 + [None]
    ts = df.select(epoch_seconds_to_ts("x").alias("t")).first().t
    assert ts == dt.datetime(2024, 1, 1, 0, 0, 7)


def test_business_day_count_matches_brute_force(spark):
    grid = spark.range(0, 40 * 18).select(
        F.date_add(F.lit(D(2026, 1, 1)), (F.col("id") / 18).cast("int")).alias("s"),
        (F.col("id") % 18 - 2).cast("int").alias("n"))
    df = grid.select("s", F.date_add("s", F.col("n")).alias("e"))
    brute = F.size(F.filter(F.sequence("s", "e"), lambda x: F.weekday(x) < 5))
    got = df.select(business_day_count("s", "e").alias("a"),
                    F.when(F.col("e") >= F.col("s"), brute).otherwise(0).alias("b"))
    assert got.where("a <> b").count() == 0


@pytest.mark.parametrize("day,start,end", [
    (D(2021, 12, 25), D(2021, 12, 27), D(2021, 12, 24)),   # Saturday Christmas
    (D(2020, 12, 25), D(2020, 12, 28), D(2020, 12, 24)),   # Friday Christmas, Boxing Day Saturday
    (D(2022, 1, 1), D(2022, 1, 3), D(2021, 12, 31)),
    (D(2026, 1, 7), D(2026, 1, 7), D(2026, 1, 7)),
])
def test_roll_business_day(spark, day, start, end):
    row = spark.createDataFrame([(day,)], "d date").select(
        roll_business_day("d", "start").alias("s"), roll_business_day("d", "end").alias("e")).first()
    assert (row.s, row.e) == (start, end)


def test_missing_ranges_skip_range_starting_today(spark):
    targets = spark.createDataFrame([("A", d(1), d(10)), ("B", d(1), d(10))],
                                    "ticker string, start date, end date")
    cover = spark.createDataFrame([("A", d(1), d(4), 4)],
                                  "ticker string, first_date date, last_date date, n_days long")
    got = history.missing_ranges_table(targets, cover, as_of=d(5)).collect()
    assert sorted((r.ticker, r.gap_start, r.gap_end) for r in got) == [("B", d(1), d(10))]


def test_upsert_fresh_wins_and_later_arrival_wins(spark):
    stored = spark.createDataFrame([("A", 1.0, d(1), 1), ("A", 1.5, d(2), 2)],
                                   "ticker string, old_price double, date date, ord long")
    fresh = spark.createDataFrame([("A", 9.0, d(2), 0), ("A", 8.0, d(3), 5), ("A", 7.0, d(3), 6),
                                   ("A", None, d(4), 7)],
                                  "ticker string, old_price double, date date, ord long")
    got = sorted((r.date, r.old_price) for r in history.upsert(stored, fresh).collect())
    assert got == [(d(1), 1.0), (d(2), 9.0), (d(3), 7.0)]


def test_validation_and_required_fx(spark):
    meta = spark.createDataFrame([
        ("abc", 0, "EQUITY", "USD", 1.0), ("DEF", 0, None, "EUR", 2.0),
        ("GHI", 0, "ETF", "JPY", "x"), ("GBP=X", None, "CURRENCY", "GBP", None),
        ("JPYGBP=X", None, "CURRENCY", "GBP", None)],
        "ticker string, first_trade_epoch long, quote_type string, currency string, bid string")
    inst = instruments.normalise_instruments(meta)
    req = spark.createDataFrame([(1, "ghi"), (2, "Abc"), (3, "def"), (4, "abc"), (5, "zzz")],
                                "pos long, symbol string")
    val = instruments.validate(req, inst)
    assert sorted((r.pos, r.ticker, r.bid) for r in val.collect()) == [
        (1, "GHI", None), (2, "ABC", 1.0)]
    rej = {r.ticker: r.reason for r in instruments.rejects(req, inst).collect()}
    assert rej == {"DEF": "missing type", "ZZZ": "unknown symbol"}
    assert sorted(r.fx_ticker for r in instruments.required_fx(val).collect()) == [
        "GBP=X", "JPYGBP=X"]
    full = instruments.full_instrument_set(val, inst)
    assert sorted(r.ticker for r in full.collect()) == ["ABC", "GBP=X", "GHI", "JPYGBP=X"]


def test_store_upsert_and_expiry_on_disk(spark):
    store = PriceStore(spark, scratch_path(spark, "test-store"), buckets=4)
    old = dt.datetime(2024, 1, 1)
    new = dt.datetime(2024, 3, 1)
    base = spark.createDataFrame([("A", 1.0, d(1)), ("B", 2.0, d(1)), ("C", 3.0, d(1))],
                                 "ticker string, old_price double, date date")
    store.save(base, written_at=old)
    fresh = spark.createDataFrame([("A", 9.0, d(1), 1), ("A", 4.0, d(2), 2)],
                                  "ticker string, old_price double, date date, ord long")
    store.upsert(fresh, written_at=new)
    got = sorted((r.ticker, r.date, r.old_price) for r in store.bars().collect())
    assert got == [("A", d(1), 9.0), ("A", d(2), 4.0), ("B", d(1), 2.0), ("C", d(1), 3.0)]
    store.expire(now=dt.datetime(2024, 3, 10), max_age_days=30)
    assert sorted(r.ticker for r in store.bars().select("ticker").distinct().collect()) == ["A"]


def test_store_expiry_query_runs_retention_on_disk(spark, monkeypatch, tmp_path):
    from fxledger.plans.queries import queries

    spark.createDataFrame(  # the cutoff is 2024-01-30 18:00
        [(1, dt.datetime(2024, 1, 5, 9), 1, 1.0), (2, dt.datetime(2024, 1, 5, 9), 2, 2.0),
         (3, dt.datetime(2024, 1, 30, 19), 2, 3.0), (4, dt.datetime(2024, 1, 30, 18), 3, 4.0)],
        "event_id long, ts timestamp, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    runs, whole = [], PriceStore.expire

    def expire_(store, *args):
        before = store.bars().count()
        runs.append((before, whole(store, *args), store.bars().count()))

    monkeypatch.setattr(PriceStore, "expire", expire_)
    left = queries()["store_expiry"](spark, str(tmp_path)).collect()
    assert runs == [(4, 1, 3)]
    assert sorted((r.ticker, r.old_price) for r in left) == [("U2", 2.0), ("U2", 3.0), ("U3", 4.0)]


def test_store_expiry_query_keeps_writes_of_twenty_days(spark, tmp_path):
    from fxledger.plans.queries import queries

    spark.createDataFrame(  # twenty days before 2024-02-09 18:00 is 2024-01-20 18:00
        [(1, dt.datetime(2024, 1, 2, 9), 1, 1.0), (2, dt.datetime(2024, 1, 20, 18), 1, 2.0),
         (3, dt.datetime(2024, 1, 20, 17, 59), 2, 3.0), (4, dt.datetime(2024, 1, 25, 9), 3, 4.0)],
        "event_id long, ts timestamp, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    left = queries()["store_expiry"](spark, str(tmp_path)).collect()
    assert sorted((r.ticker, r.old_price) for r in left) == [("U1", 1.0), ("U1", 2.0), ("U3", 4.0)]


@pytest.mark.parametrize("days", [10, 11])
def test_store_expiry_removes_some_symbols_at_a_shorter_age(spark, monkeypatch, days):
    from fxledger.plans import params
    from fxledger.plans.oracle import oracle_sql
    from fxledger.plans.queries import queries
    from oracle_check import compare, duck

    sf_dir = "/root/testdata/sf0.001"
    monkeypatch.setattr(params, "EXPIRY_DAYS", days)
    sql = oracle_sql()["store_expiry"].replace("interval 20 day", f"interval {days} day")
    n = compare(spark, duck(sf_dir), queries()["store_expiry"], sql, sf_dir)
    assert 0 < n < 397


def test_expire_is_strict(spark):
    bars = spark.createDataFrame([("A", 1.0, d(1), dt.datetime(2024, 1, 1)),
                                  ("B", 1.0, d(1), dt.datetime(2023, 12, 31, 23, 59))],
                                 "ticker string, old_price double, date date, written_at timestamp")
    kept = expire(bars, dt.datetime(2024, 1, 31), 30).collect()
    assert [r.ticker for r in kept] == ["A"]


def test_csv_export(spark):
    conv = spark.createDataFrame([("A", 1.5, d(2)), ("B", 2.5, d(3)), ("A", 1.0, d(1))],
                                 "ticker string, price double, date date")
    rows = export_rows(conv, d(2), sort=True)
    path = scratch_path(spark, "test-csv")
    assert write_csv(rows, path)
    import glob
    lines = [line for f in sorted(glob.glob(path.removeprefix("file:") + "/part-*"))
             for line in open(f).read().splitlines()]
    assert lines == ["B,2.5,03/01/2026", "A,1.5,02/01/2026"]
    assert not write_csv(export_rows(conv, d(9)), scratch_path(spark, "test-csv"))


def test_self_check(spark):
    from fxledger.plans.price_book import self_check
    req = spark.createDataFrame([(1, "A")], "pos long, symbol string")
    self_check(spark, req, D(2026, 1, 4), 0.1)
    with pytest.raises(ValueError):
        self_check(spark, req.limit(0), D(2026, 1, 4), 0.1)
    with pytest.raises(ValueError):
        self_check(spark, req, D(2026, 1, 4), 0.001)


def test_optional_staleness_limit(spark):
    rows = [("A", 10.0, d(1), "EQUITY", "USD"), ("A", 10.0, d(4), "EQUITY", "USD"),
            ("A", 10.0, d(12), "EQUITY", "USD"), ("GBP=X", 0.8, d(2), "CURRENCY", "GBP")]
    df = frame(spark, rows)
    plain = {r.date: r.rate for r in convert.prepare(df).rated.collect()}
    assert plain == {d(1): 0.8, d(4): 0.8, d(12): 0.8}
    strict = {r.date: r.rate for r in convert.prepare(df, max_age_days=5).rated.collect()}
    # d(1) precedes every rate: back filled; d(12) is 10 days after the last rate: dropped.
    assert strict == {d(1): 0.8, d(4): 0.8, d(12): None}


def test_scratch_is_deleted_at_the_end_of_its_scope(spark):
    from fxledger.session import scratch_scope, settled, write_scratch

    def made(name):
        return glob.glob(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/{name}-*")

    def make():
        return write_scratch(write_scratch(spark.range(10), "inner").where("id > 3"), "inner")

    df, path = settled(spark, "outer", make)
    assert df.count() == 6 and not made("inner") and len(made("outer")) == 1
    with scratch_scope(spark):
        settled(spark, "outer", make)
        assert len(made("outer")) == 2
    assert len(made("outer")) == 1 and path.endswith(made("outer")[0].rpartition("/")[2])
