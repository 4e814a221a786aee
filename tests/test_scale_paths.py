"""Paths the small fixtures do not take on their own: the shuffle-join
fallback beyond the broadcast bound, and a symbol holding a third of all rows."""

import datetime as dt

from pyspark.sql import functions as F

from fxledger.operators import clean, convert
from fxledger.plans import params as P
from fxledger.plans import queries as Q
from fxledger.plans.price_book import price_book
from fxledger.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


class no_auto_broadcast:
    """Let only explicit, size-checked broadcasts through."""

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.old = self.spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        self.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def __exit__(self, *exc):
        self.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", self.old)


def test_conversion_fallback_equals_broadcast(spark):
    src = Q.deduped_raw(spark, SF)
    small = rows(convert.convert_prices(src))
    with no_auto_broadcast(spark):
        big = convert.convert_prices(src, max_broadcast_bytes=0)
        plan = big._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
        assert small == rows(big)


def test_price_book_fallback_equals_broadcast(spark):
    raw = fx.raw_bars(spark, SF).select("ticker", "old_price", "date", "ord")
    store = clean.last_complete(raw.where(F.col("date") <= F.lit(P.BOOK_STORED_TO)))
    args = (fx.requests(spark, SF), Q.instrument_table(spark, SF, with_fx=True), store,
            P.BOOK_AS_OF, P.BOOK_YEARS)
    a = rows(price_book(*args, landing=raw))
    with no_auto_broadcast(spark):
        b = rows(price_book(*args, landing=raw, max_broadcast_bytes=0))
    assert a == b


def test_hot_symbol_holding_a_third_of_rows(spark):
    # 2 * 3000 rows of ordinary symbols plus 3000 rows of one symbol on one day.
    n = 3000
    base = spark.range(0, 2 * n).select(
        F.concat(F.lit("S"), (F.col("id") % 50).cast("string")).alias("ticker"),
        (F.col("id") % 97 + 1).cast("double").alias("old_price"),
        F.date_add(F.lit(dt.date(2026, 1, 1)), (F.col("id") % 60).cast("int")).alias("date"),
        F.col("id").alias("ord"), F.lit("EQUITY").alias("type"), F.lit("USD").alias("currency"))
    hot = spark.range(0, n).select(
        F.lit("HOT").alias("ticker"), (F.col("id") + 1).cast("double").alias("old_price"),
        F.lit(dt.date(2026, 1, 30)).alias("date"), (F.col("id") + 10 * n).alias("ord"),
        F.lit("EQUITY").alias("type"), F.lit("USD").alias("currency"))
    rates = spark.range(0, 30).select(
        F.lit("GBP=X").alias("ticker"), (F.lit(0.5) + F.col("id") / 100).alias("old_price"),
        F.date_add(F.lit(dt.date(2026, 1, 5)), (F.col("id") * 2).cast("int")).alias("date"),
        F.col("id").alias("ord"), F.lit("CURRENCY").alias("type"), F.lit("GBP").alias("currency"))
    raw = base.unionByName(hot).unionByName(rates)
    deduped = clean.dedupe_last(raw, ("ticker", "date", "type", "currency"))
    hot_row = deduped.where("ticker = 'HOT'").collect()
    assert [(r.old_price, r.ord) for r in hot_row] == [(float(n), 11 * n - 1)]
    out = {(r.ticker, r.date): r.price for r in convert.convert_prices(deduped).collect()}
    # 2026-01-30: the latest rate on or before it is the one of 2026-01-29 (id 12).
    assert out[("HOT", dt.date(2026, 1, 30))] == float(n) * (0.5 + 12 / 100)
    # Days before the first rate take the rate of the first security day that
    # has one (0.5, 2026-01-05).  (S0, 2026-01-01) holds ids 0, 300, ..., 5700;
    # the last arrival (5700, price 5700 % 97 + 1 = 75) wins.
    assert out[("S0", dt.date(2026, 1, 1))] == 75.0 * 0.5


def test_run_book_persists_and_matches_price_book(spark):
    import glob

    from fxledger.plans.price_book import run_book
    from fxledger.session import scratch_path
    from fxledger.sources.store import PriceStore

    raw = fx.raw_bars(spark, SF).select("ticker", "old_price", "date", "ord")
    seed = clean.last_complete(raw.where(F.col("date") <= F.lit(P.BOOK_STORED_TO)))
    req, inst = fx.requests(spark, SF), Q.instrument_table(spark, SF, with_fx=True)
    expected = rows(price_book(req, inst, seed, P.BOOK_AS_OF, P.BOOK_YEARS, landing=raw))

    store = PriceStore(spark, scratch_path(spark, "run-book-store"), buckets=4)
    store.save(seed.drop("ord"))
    before = store.bars().count()
    out = scratch_path(spark, "run-book-csv")
    got = run_book(req, inst, store, raw, P.BOOK_AS_OF, out, years=P.BOOK_YEARS)
    assert rows(got.rows) == expected
    assert store.bars().count() > before          # fetched bars were persisted
    lines = [ln for f in sorted(glob.glob(out.removeprefix("file:") + "/part-*"))
             for ln in open(f).read().splitlines()]
    assert len(lines) == len(expected)
    # A second run finds nothing new to fetch and gives the same rows.
    again = run_book(req, inst, store, raw, P.BOOK_AS_OF, scratch_path(spark, "csv2"),
                     years=P.BOOK_YEARS)
    assert rows(again.rows) == expected
