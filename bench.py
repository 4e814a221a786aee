#!/usr/bin/env python
"""Benchmark: run the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full through the ``noop`` sink (no collect), twice,
and ``queries`` reports the better run (the first warms the JIT and file
``cpu_probe_sec`` is a fixed amount of work of one core (best of three, before and after
the queries), to tell slow hosts from slow queries.  Prints one JSON line on stdout.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
ONLY = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
REPEAT = max(1, int(os.environ.get("BENCH_REPEAT", "2")))

# The headline set: the conversion chain, the store chain and the whole book.
HEADLINE = ("price_book", "price_book_stored", "convert_prices", "asof_rates", "backfill_rates", "dedupe_last",
            "fx_calendar_fill", "append_provisional", "upsert_prices", "missing_ranges",
            "validate_instruments", "date_coverage", "export_rows")


def sf_of(path: str) -> float | str:
    name = os.path.basename(path.rstrip("/"))
    try:
        return float(name.removeprefix("sf"))
    except ValueError:
        return name


def asof_cached(spark) -> list[float]:
    """
    bars), inputs cached, aggregate over all rows; one warm-up, three runs."""
    from pyspark.sql import functions as F

    from fxledger.operators import convert
    from fxledger.sources import fixtures as fx

    px = convert.with_fx_symbol(convert.clean_side(fx.security_bars(spark, SF_DIR))).cache()
    quotes = convert.clean_side(fx.fx_bars(spark, SF_DIR)).cache()
    rates = convert.first_rate(quotes).cache()
    px.count(), quotes.count(), rates.count()

    def once() -> float:
        t = time.perf_counter()
        conv = convert.Conversion(securities=px, fx_rows=quotes, rates=rates)
        conv.rated.agg(F.count(F.lit(1)), F.sum(F.col("old_price") * F.col("rate"))).collect()
        return round(time.perf_counter() - t, 3)

    once()
    runs = [once() for _ in range(3)]
    px.unpersist(), quotes.unpersist(), rates.unpersist()
    return runs


def cpu_probe() -> float:
    """Seconds of one core for a fixed piece of work, best of three."""
    import hashlib

    def once() -> float:
        t, data = time.perf_counter(), b"x" * 4096
        for _ in range(20_000):
            data = hashlib.sha256(data).digest() * 128
        return time.perf_counter() - t

    return round(min(once() for _ in range(3)), 3)


def main() -> None:
    from fxledger.plans.queries import queries
    from fxledger.session import build_session

    spark = build_session(master=f"local[{CPUS}]", shuffle_partitions=max(CPUS, 2),
                          app_name="fxledger-bench",
                          extra={"spark.driver.memory": "16g"})
    qs = queries()
    names = ONLY or list(qs)

    def run(name: str) -> float:
        t = time.perf_counter()
        qs[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    probe = cpu_probe()
    run("convert_prices")  # untimed warm-up: JIT and file listing caches
    times, first, failed = {}, {}, {}
    for name in names:
        try:
            runs = [run(name) for _ in range(REPEAT)]
            first[name], times[name] = round(runs[0], 3), round(min(runs), 3)
        except Exception as exc:  # record and go on: one failure must not hide the rest
            failed[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    asof_runs = asof_cached(spark) if not ONLY else []
    headline = [n for n in HEADLINE if n in times]
    result = {
        "metric": "sum of headline query seconds",
        "value": round(sum(times[n] for n in headline), 3) if headline else None,
        "unit": "sec",
        "queries": times,
        "headline": headline,
        "all_queries_sec": round(sum(times.values()), 3),
        "headline_first_run_sec": round(sum(first[n] for n in headline), 3),
        "queries_first_run": first,
        "runs_per_query": REPEAT,
        "asof_cached_aggregate_runs": asof_runs,
        "failed": failed,
        "cpu_probe_sec": [probe, cpu_probe()],
        "sf": sf_of(SF_DIR),
        "cpus": CPUS,
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
