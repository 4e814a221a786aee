"""Property tests: Spark operators against brute-force Python on random inputs.

Each Hypothesis example is a whole batch of cases evaluated in one Spark job.
"""

import datetime as dt

from hypothesis import HealthCheck, given, settings, strategies as st

from fxledger.functions.dates import PUBLIC_HOLIDAYS, roll_business_day
from fxledger.functions.ranges import missing_ranges
from fxledger.operators import clean, convert

BASE = dt.date(2025, 12, 20)
SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])
day = st.integers(min_value=0, max_value=40).map(lambda n: BASE + dt.timedelta(days=n))


def gaps_brute(s, e, f, l):
    """Days of [s, e] outside [f, l], as maximal runs (no holes looked for)."""
    if s > e:
        return []
    if f is None or l is None:
        return [(s, e)]
    lo, hi = min(f, l), max(f, l)
    days = [s + dt.timedelta(days=i) for i in range((e - s).days + 1)]
    out = [d for d in days if d < lo or d > hi]
    runs = []
    for d in out:
        if runs and (d - runs[-1][1]).days == 1:
            runs[-1][1] = d
        else:
            runs.append([d, d])
    return [tuple(r) for r in runs]


@SETTINGS
@given(st.lists(st.tuples(day, day, st.none() | day, st.none() | day), min_size=1, max_size=30))
def test_missing_ranges_property(spark, cases):
    df = spark.createDataFrame(cases, "s date, e date, f date, l date")
    got = df.select(missing_ranges("s", "e", "f", "l").alias("r")).collect()
    for (s, e, f, l), row in zip(cases, got):
        assert [(x.gap_start, x.gap_end) for x in row.r] == gaps_brute(s, e, f, l)


def roll_brute(d, forward):
    step = dt.timedelta(days=1 if forward else -1)
    while d.weekday() >= 5 or d.strftime("%m-%d") in PUBLIC_HOLIDAYS:
        d += step
    return d


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=3000), min_size=1, max_size=40))
def test_roll_business_day_property(spark, offsets):
    days = [dt.date(2018, 12, 1) + dt.timedelta(days=o) for o in offsets]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select(roll_business_day("d", "start").alias("a"),
                    roll_business_day("d", "end").alias("b")).collect()
    for d, row in zip(days, got):
        assert (row.a, row.b) == (roll_brute(d, True), roll_brute(d, False))


def rates_brute(sec, rates):
    """Per (pair, day) of the securities: the latest rate on or before the day;
    before the first rate, the rate of the next security day that has one."""
    out = {}
    for pair in {p for p, _ in sec}:
        days = sorted({d for p, d in sec if p == pair})
        quotes = sorted((d, r) for p, d, r in rates if p == pair)
        asof = {}
        for d in days:
            earlier = [r for qd, r in quotes if qd <= d]
            asof[d] = earlier[-1] if earlier else None
        for i, d in enumerate(days):
            r = asof[d]
            if r is None:
                r = next((asof[x] for x in days[i:] if asof[x] is not None), None)
            out[(pair, d)] = r
    return out


PAIRS = ["GBP=X", "EURGBP=X"]
CCY = {"GBP=X": "USD", "EURGBP=X": "EUR"}


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(PAIRS), day), min_size=1, max_size=40),
       st.lists(st.tuples(st.sampled_from(PAIRS), day,
                          st.floats(min_value=0.1, max_value=2.0, allow_nan=False)),
                max_size=25))
def test_asof_and_backfill_property(spark, sec, rates):
    # One rate per (pair, day), as after the first-rate aggregation.
    rates = list({(p, d): (p, d, r) for p, d, r in rates}.values())
    rows = [(f"T{i % 3}", 1.0, d, i, "EQUITY", CCY[p]) for i, (p, d) in enumerate(sec)]
    rows += [(p, r, d, 10_000 + i, "CURRENCY", "GBP") for i, (p, d, r) in enumerate(rates)]
    df = spark.createDataFrame(rows, "ticker string, old_price double, date date, ord long, "
                                     "type string, currency string")
    conv = convert.prepare(clean.dedupe_last(df, ("ticker", "date", "type", "currency")))
    got = {(r.fx_ticker, r.date): r.rate for r in conv.rated.collect()}
    want = rates_brute({(p, d) for p, d in sec}, rates)
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("ABC"), st.integers(0, 3),
                          st.integers(0, 10 ** 6), st.floats(-5, 5, allow_nan=False)),
                min_size=1, max_size=60, unique_by=lambda t: t[2]))
def test_dedupe_last_property(spark, rows):
    data = [(t, p, BASE + dt.timedelta(days=d), o) for t, d, o, p in rows]
    df = spark.createDataFrame(data, "ticker string, old_price double, date date, ord long")
    got = {(r.ticker, r.date): (r.old_price, r.ord) for r in clean.dedupe_last(df).collect()}
    want = {}
    for t, p, d, o in data:
        if (t, d) not in want or o > want[(t, d)][1]:
            want[(t, d)] = (p, o)
    assert got == want


bar = st.tuples(st.sampled_from("AB"), st.integers(0, 6), st.integers(0, 10 ** 6),
                st.none() | st.floats(-5, 5, allow_nan=False))


@SETTINGS
@given(st.lists(bar, max_size=30, unique_by=lambda t: t[2]),
       st.lists(bar, max_size=30, unique_by=lambda t: t[2]))
def test_upsert_property(spark, stored, fresh):
    from fxledger.operators import history
    schema = "ticker string, old_price double, date date, ord long"

    def frame(rows):
        return spark.createDataFrame([(t, p, BASE + dt.timedelta(days=d), o)
                                      for t, d, o, p in rows], schema)

    got = {(r.ticker, r.date): r.old_price
           for r in history.upsert(frame(stored), frame(fresh)).collect()}
    # Fresh rows win over stored ones; within a side the latest arrival wins.
    best = {}
    for src, rows in ((0, stored), (1, fresh)):
        for t, d, o, p in rows:
            key = (t, BASE + dt.timedelta(days=d))
            if p is not None and (key not in best or (src, o) > best[key][0]):
                best[key] = ((src, o), p)
    assert got == {k: v[1] for k, v in best.items()}


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["GBP=X", "S1"]), st.integers(0, 30),
                          st.floats(0.1, 5, allow_nan=False)),
                min_size=1, max_size=25, unique_by=lambda t: (t[0], t[1])))
def test_calendar_fill_property(spark, bars):
    from fxledger.operators import fill
    df = spark.createDataFrame([(t, p, BASE + dt.timedelta(days=d)) for t, d, p in bars],
                               "ticker string, old_price double, date date")
    got = {(r.ticker, r.date): (r.old_price, r.filled)
           for r in fill.calendar_fill(df).collect()}
    want = {}
    for t in {b[0] for b in bars}:
        own = sorted((d, p) for tt, d, p in bars if tt == t)
        if "=X" in t:
            known = dict(own)
            last = None
            for d in range(own[0][0], own[-1][0] + 1):
                last = known.get(d, last)
                want[(t, BASE + dt.timedelta(days=d))] = (last, d not in known)
        else:
            for d, p in own:
                want[(t, BASE + dt.timedelta(days=d))] = (p, False)
    assert got == want
