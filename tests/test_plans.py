"""Plan shape: what the optimizer should produce at any scale."""

import datetime as dt
import re

from pyspark.sql import functions as F

from fxledger.operators import clean, convert, history
from fxledger.plans import queries as Q

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_or_cartesian_nodes(spark):
    for name, q in Q.queries().items():
        p = plan(q(spark, SF))
        for bad in ("BatchEvalPython", "ArrowEvalPython", "MapInArrow", "MapInPandas", "CartesianProduct",
                    "BroadcastNestedLoopJoin"):
            assert bad not in p, (name, bad)


def test_conversion_joins_rates_by_broadcast(spark):
    df = convert.convert_prices(Q.deduped_raw(spark, SF))
    p = plan(df)
    assert "BroadcastHashJoin" in p
    assert "SortMergeJoin" not in p


def test_dedupe_is_a_hash_aggregate(spark):
    bars = spark.createDataFrame([("A", 1.0, dt.date(2026, 1, 1), 1)],
                                 "ticker string, old_price double, date date, ord long")
    p = plan(clean.dedupe_last(bars))
    assert "HashAggregate" in p and "SortAggregate" not in p


def test_range_scan_pushes_filters(spark, tmp_path):
    path = str(tmp_path / "bars")
    spark.createDataFrame([("A", 1.0, dt.date(2026, 1, d)) for d in range(1, 9)],
                          "ticker string, old_price double, date date").write.parquet(path)
    df = history.scan_range(spark.read.parquet(path), dt.date(2026, 1, 3), dt.date(2026, 1, 5))
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date,2026-01-03)" in p
    assert df.count() == 3


def test_store_symbol_lookup_prunes_buckets(spark):
    from fxledger.session import scratch_path
    from fxledger.sources.store import PriceStore

    store = PriceStore(spark, scratch_path(spark, "prune-store"), buckets=8)
    bars = spark.createDataFrame([(f"T{i}", float(i), dt.date(2026, 1, 1)) for i in range(40)],
                                 "ticker string, old_price double, date date")
    store.save(bars)
    df = store.symbol_bars(["T3", "T7"])
    p = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[bucket#\d+ IN \(\d+,\d+\)\]", p), p
    assert sorted(r.ticker for r in df.collect()) == ["T3", "T7"]


def test_rejected_bars_are_coerced_once(spark):
    raw = spark.createDataFrame([("A", "1.5", "2024-01-01")], "ticker string, price string, day string")
    text = raw.select("ticker", F.concat("price", F.lit("")).alias("old_price"), F.concat("day", F.lit("")).alias("date"))
    for part in clean.split_bars(clean.tag_bars(text)):
        p = part._jdf.queryExecution().optimizedPlan().toString()
        assert p.count("M/d/yyyy") == 1 and p.count("try_cast") == 2, p
