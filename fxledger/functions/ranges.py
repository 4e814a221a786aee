"""Interval difference: a requested day range minus a stored one."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_ranges(start: Column | str, end: Column | str,
                   first: Column | str, last: Column | str) -> Column:
    """array<struct<gap_start, gap_end>> of the days in ``[start, end]`` outside
    the stored ``[first, last]`` (both ends inclusive).

    * start > end: no range;
    * nothing stored (either bound NULL): the whole request;
    * stored bounds reversed: swapped;
    * otherwise the part before ``first`` and the part after ``last``.
    Holes inside the stored range are not looked for.
    """
    s, e = _c(start), _c(end)
    f0, l0 = _c(first), _c(last)
    f, l = F.least(f0, l0), F.greatest(f0, l0)
    before_end = F.least(e, F.date_sub(f, 1))
    after_start = F.greatest(s, F.date_add(l, 1))
    pieces = F.array(
        F.struct(s.alias("gap_start"), before_end.alias("gap_end"), (s < f).alias("keep")),
        F.struct(after_start.alias("gap_start"), e.alias("gap_end"), (e > l).alias("keep")),
    )
    kept = F.filter(pieces, lambda x: x["keep"] & (x["gap_start"] <= x["gap_end"]))
    trimmed = F.transform(kept, lambda x: F.struct(x["gap_start"].alias("gap_start"),
                                                    x["gap_end"].alias("gap_end")))
    whole = F.array(F.struct(s.alias("gap_start"), e.alias("gap_end")))
    none = F.filter(whole, lambda x: F.lit(False))
    return (F.when(s > e, none)
             .when(f0.isNull() | l0.isNull(), whole)
             .otherwise(trimmed))
