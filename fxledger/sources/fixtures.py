"""Fixture tables over the driver's TPC-H-style parquet files.

They give the price book realistic inputs whose size grows with the scale
factor: lineitem rows are security bars, orders are FX quotes,
suppliers are instruments, events are intraday ticks for the store.
The same definitions are written as SQL for the DuckDB oracle
(``fxledger.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values of the fixtures: currency of each region key, FX pair of each
# quoting region, and the scale applied to order totals to make rates.
REGION_CURRENCY = {0: "GBP", 1: "USD", 2: "JPY", 3: "EUR"}
OTHER_REGION_CURRENCY = "GBp"
REGION_PAIR = {1: "GBP=X", 2: "JPYGBP=X"}
OTHER_REGION_PAIR = "EURGBP=X"
RATE_SCALE = 250000.0
JPY_LAG_DAYS = 150   # JPY is quoted this long after the order
NO_PRICE_LINE = 7    # bars of this line number arrive without a price
FIRST_EPOCH = 788918400  # 1995-01-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def region_currency(regionkey: Column) -> Column:
    expr = None
    for key, ccy in REGION_CURRENCY.items():
        expr = (F.when(regionkey == key, ccy) if expr is None
                else expr.when(regionkey == key, ccy))
    return expr.otherwise(OTHER_REGION_CURRENCY)


def _supplier_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return (sup.join(nat, sup["s_nationkey"] == nat["n_nationkey"])
            .select("s_suppkey", "s_acctbal",
                    region_currency(F.col("n_regionkey")).alias("currency")))


# Arrival order of a lineitem bar: (order key, line number, part key), which
# is unique within a supplier-day, packed digit by digit into one
# DECIMAL(38,0): the order key takes the digits above 19, the line number the
# next one, the part key the low 18.  Keys below 1e18 fit, and a decimal
# keeps "keep last" a hash aggregate.
def arrival(orderkey: Column, linenumber: Column, partkey: Column) -> Column:
    head = orderkey.cast("decimal(18,0)") * F.lit(10).cast("decimal(2,0)") + linenumber.cast("decimal(1,0)")
    return (head.cast("decimal(19,0)") * F.lit("1" + "0" * 18).cast("decimal(19,0)")
            + partkey.cast("decimal(18,0)")).cast("decimal(38,0)")


def security_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_px: ENRICHED security bars (ticker, old_price, date, type, currency, ord).

    The fact table joins each dimension directly (lineitem-supplier, then
    nation) so the planner sees the small side of every join; joining the
    dimensions first would make their product look larger than lineitem.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_shipdate")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    j = (li.join(sup, li["l_suppkey"] == sup["s_suppkey"])
         .join(nat, F.col("s_nationkey") == nat["n_nationkey"]))
    return j.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
        F.when(F.col("l_linenumber") != NO_PRICE_LINE, F.col("l_extendedprice") / F.col("l_quantity"))
         .alias("old_price"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.lit("EQUITY").alias("type"),
        region_currency(F.col("n_regionkey")).alias("currency"),
        arrival(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")).alias("ord"))


def fx_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_fx: daily FX quotes of all orders of three regions, with gaps (closed
    days have no quotes) and a late first JPY quote."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                               "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rk = F.col("n_regionkey")
    j = (o.join(c, o["o_custkey"] == c["c_custkey"])
         .join(n, c["c_nationkey"] == n["n_nationkey"])
         .where(rk.isin(1, 2, 3)))
    day = F.date_add(F.col("o_orderdate").cast("date"), F.when(rk == 2, JPY_LAG_DAYS).otherwise(0))
    pair = (F.when(rk == 1, REGION_PAIR[1]).when(rk == 2, REGION_PAIR[2])
            .otherwise(OTHER_REGION_PAIR))
    return j.select(
        pair.alias("ticker"),
        (F.col("o_totalprice") / F.lit(RATE_SCALE)).alias("old_price"),
        day.alias("date"),
        F.lit("CURRENCY").alias("type"),
        F.lit("GBP").alias("currency"),
        F.col("o_orderkey").alias("ord")).where(F.weekday("date") < 5)


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_raw: securities and FX quotes together (the conversion input)."""
    return security_bars(spark, sf_dir).unionByName(fx_bars(spark, sf_dir))


def instrument_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_inst: raw instrument metadata, with missing types, currencies and bids."""
    sup = _supplier_currency(spark, sf_dir)
    k = F.col("s_suppkey")
    return sup.select(
        F.concat(F.lit("S"), k.cast("string")).alias("ticker"),
        k.alias("s_suppkey"),
        F.when(k % 11 == 10, F.lit(None).cast("string"))
         .when(k % 5 == 0, F.lit("ETF")).otherwise(F.lit("EQUITY")).alias("quote_type"),
        F.when(k % 13 == 12, F.lit(None).cast("string")).otherwise(F.col("currency"))
         .alias("currency"),
        F.when(k % 4 == 3, F.lit(None).cast("long"))
         .otherwise(F.lit(FIRST_EPOCH) + (k % 40) * 90 * 86400).alias("first_trade_epoch"),
        F.when(F.col("s_acctbal") < 500, F.lit(None).cast("double"))
         .otherwise(F.col("s_acctbal")).alias("bid"))


def fx_instrument_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata rows of the FX pairs that have quotes (type CURRENCY, in GBP)."""
    return (fx_bars(spark, sf_dir).select("ticker").distinct()
            .select("ticker", F.lit(None).cast("long").alias("s_suppkey"),
                    F.lit("CURRENCY").alias("quote_type"), F.lit("GBP").alias("currency"),
                    F.lit(None).cast("long").alias("first_trade_epoch"),
                    F.lit(None).cast("double").alias("bid")))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_req: requested symbols with positions; mixed case, repeats, unknowns."""
    inst = instrument_meta(spark, sf_dir)
    k = F.col("s_suppkey")
    evens = inst.where(k % 2 == 0).select(
        k.alias("pos"), F.when(k % 3 == 0, F.lower("ticker")).otherwise(F.col("ticker"))
        .alias("symbol"))
    repeats = inst.where(k % 10 == 0).select((F.lit(1000000) + k).alias("pos"),
                                             F.col("ticker").alias("symbol"))
    nat = table(spark, sf_dir, "nation")
    unknown = nat.select((F.lit(2000000) + F.col("n_nationkey")).cast("long").alias("pos"),
                         F.concat(F.lit("X"), F.col("n_nationkey").cast("string")).alias("symbol"))
    return evens.unionByName(repeats).unionByName(unknown)


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as intraday ticks: (ticker, old_price, date, ord, ts, event_id)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    return ev.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"),
                     F.col("value").alias("old_price"),
                     F.col("ts").cast("date").alias("date"),
                     F.col("event_id").alias("ord"), "ts", "event_id")


def text_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem prices as text, with junk: 'n/a' on line 7, '' on line 6."""
    li = table(spark, sf_dir, "lineitem")
    ln = F.col("l_linenumber")
    text = (F.when(ln == 7, F.lit("n/a")).when(ln == 6, F.lit(""))
             .otherwise(F.col("l_extendedprice").cast("string")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                     text.alias("price_text"))


def text_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as raw text bars with every kind of fault: no symbol, a day that is none,
    a missing, blank or NaN price, a price that is no number."""
    t = text_prices(spark, sf_dir)
    ln, odd = F.col("l_linenumber"), F.col("l_orderkey") % 2 == 1
    return t.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(~((ln == 5) & odd), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).alias("ticker"),
        F.when((ln == 4) & odd, F.lit("2001-13-45")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
        .alias("day_text"),
        F.when((ln == 3) & odd, F.lit("NaN")).otherwise(F.col("price_text")).alias("price_text"))


def damage_month(store, month: str) -> None:
    """Overwrite every file of a month of a price store with junk."""
    fs, path = store._fs()
    for status in fs.globStatus(path(f"{store.root}/bars/version=*/month={month}/bucket=*/part-*")) or ():
        out = fs.create(status.getPath(), True)
        out.write(bytearray(b"not a Parquet file"))
        out.close()
