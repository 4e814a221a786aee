"""Day arithmetic: UTC days, epoch values, business-day calendar.

Everything is a built-in column expression, so it stays inside whole-stage
code generation and runs wherever the rows are.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from fxledger.constants import DAYS_PER_YEAR, EPOCH_MILLIS_FROM, PUBLIC_HOLIDAYS

# Text that a day with slashes must look like.  A failed parse costs far more than this
# check, so other text is never tried.
_SLASHED = r"^-?\d+/-?\d+/[+-]?\d+$"

# Days whose epoch day is outside years 1 to 9999 are no dates.
_FIRST_DAY, _LAST_DAY = -719162, 2932896


def roll_span(holidays: Sequence[str]) -> int:
    """Days in which a business day is always found.  Five closed weekdays in a
    row use up five holidays, so h holidays give at most h closed weekdays and
    the weekends between and around them; with holidays on most weekdays of a
    year, an open day may fall on weekends for some years."""
    h = len(set(holidays))
    if h >= 366:
        raise ValueError("every day of the year is a holiday")
    return h + 2 * (h // 5 + 2) if h < 200 else 366 * 12


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_day(c: Column | str, day_first: bool = False) -> Column:
    """Text or timestamp -> UTC day; bad -> NULL.

    Accepted text: a day with slashes, month first unless ``day_first``, or the
    other way where only that makes a date; and ISO dates and timestamps (an
    explicit offset is converted to UTC before flooring).  Text without a
    date, such as a time alone, is NULL.
    """
    s = F.trim(_c(c).cast("string"))
    orders = ("d/M/yyyy", "M/d/yyyy") if day_first else ("M/d/yyyy", "d/M/yyyy")
    iso = F.when(s.rlike(r"^\d{4}(-|$)"), s.try_cast("timestamp"))
    slashed = s.rlike(_SLASHED)
    ts = F.coalesce(*[F.when(slashed, F.try_to_timestamp(s, F.lit(o))) for o in orders], iso)
    return ts.cast("date")


def _floor_div(x: Column, d: int) -> Column:
    """Whole days; NULL beyond the years 1 to 9999."""
    days = (x - F.pmod(x, F.lit(d))) / F.lit(d)
    return F.when(days.between(_FIRST_DAY, _LAST_DAY), days).cast("int")


def epoch_to_day(c: Column | str) -> Column:
    """Epoch number -> UTC day.

    The absolute value is taken; below 1e10 it counts seconds, otherwise
    milliseconds.  Exact integer arithmetic, independent of the session zone.
    """
    x = F.abs(_c(c).try_cast("double"))
    x = F.when(~F.isnan(x), x)
    secs = F.when(x < F.lit(EPOCH_MILLIS_FROM), F.floor(x)).otherwise(F.floor(x / F.lit(1000.0)))
    return F.date_from_unix_date(_floor_div(secs, 86400))


def epoch_seconds_to_ts(c: Column | str) -> Column:
    """Epoch seconds -> naive UTC timestamp (keeps the time of day); bad -> NULL.

    Naive epoch plus a day-time interval: independent of the session zone.
    """
    secs = _c(c).try_cast("bigint")
    days = _floor_div(secs, 86400)
    rest = F.pmod(secs, F.lit(86400)).cast("decimal(18,6)")
    rest = F.when(days.isNotNull(), rest)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(days=days, secs=rest)


def is_business_day(d: Column, holidays: Sequence[str] = PUBLIC_HOLIDAYS) -> Column:
    return (F.weekday(d) < 5) & ~F.date_format(d, "MM-dd").isin(list(holidays))


def roll_business_day(c: Column | str, direction: str,
                      holidays: Sequence[str] = PUBLIC_HOLIDAYS) -> Column:
    """Nearest business day on or after (``start``) / on or before (``end``) the day."""
    d = _c(c)
    if direction == "start":
        days = F.sequence(d, F.date_add(d, roll_span(holidays)))
        return F.array_min(F.filter(days, lambda x: is_business_day(x, holidays)))
    if direction == "end":
        days = F.sequence(F.date_sub(d, roll_span(holidays)), d)
        return F.array_max(F.filter(days, lambda x: is_business_day(x, holidays)))
    raise ValueError("direction must be 'start' or 'end'")


def roll_day(day: dt.date, direction: str, holidays: Sequence[str] = PUBLIC_HOLIDAYS) -> dt.date:
    """``roll_business_day`` of one literal day, for filters that must reach a scan."""
    step = {"start": 1, "end": -1}[direction]
    for k in range(roll_span(holidays) + 1):
        d = day + dt.timedelta(days=step * k)
        if d.weekday() < 5 and d.strftime("%m-%d") not in holidays:
            return d
    raise ValueError("no business day found")


def business_day_count(start: Column | str, end: Column | str) -> Column:
    """Monday-to-Friday days in ``[start, end]`` (holidays not removed); 0 if empty.

    Closed form: whole weeks give 5 each, the remaining 0-6 days starting at
    weekday ``w`` (Mon=0) cover positions ``[w, w+r)``; positions 0-4 and 7-11
    are weekdays.
    """
    s, e = _c(start), _c(end)
    n = F.datediff(e, s) + 1
    weeks = F.floor(n / 7).cast("int")
    r = (n - weeks * 7).cast("int")
    w = F.weekday(s)
    head = F.greatest(F.lit(0), F.least(w + r, F.lit(5)) - w)
    tail = F.greatest(F.lit(0), F.least(w + r, F.lit(12)) - F.greatest(w, F.lit(7)))
    return F.when(n <= 0, F.lit(0)).otherwise(weeks * 5 + head + tail)


def collection_days(years: float) -> int:
    """Length of the collection window in days: round-half-even(years x 365.25)."""
    if isinstance(years, bool) or not isinstance(years, (int, float)) or years <= 0:
        raise ValueError("collection period must be a positive number of years")
    return int(round(years * DAYS_PER_YEAR))


def collection_window(as_of: Column | str, years: float,
                      holidays: Sequence[str] = PUBLIC_HOLIDAYS) -> Column:
    """struct<days, start, end>: start rolled forward, end (as_of) rolled back."""
    d = _c(as_of)
    days = collection_days(years)
    start = roll_business_day(F.date_sub(d, days), "start", holidays)
    end = roll_business_day(d, "end", holidays)
    return F.struct(F.lit(days).alias("days"), start.alias("start"), end.alias("end"))
