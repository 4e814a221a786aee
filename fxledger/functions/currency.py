"""Currency expressions: FX pair symbols and fixed rates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from fxledger.constants import DOLLAR, HOME_CURRENCY, MINOR_UNITS, NO_PAIR, PAIR_SUFFIX


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def home_currencies(home: str = HOME_CURRENCY,
                    minor_units: Mapping[str, float] | None = None) -> list[str]:
    minor = MINOR_UNITS if minor_units is None else minor_units
    return [home, *minor.keys()]


def fx_symbol(currency: Column | str, home: str = HOME_CURRENCY,
              minor_units: Mapping[str, float] | None = None) -> Column:
    """FX pair that converts ``currency`` into ``home``.

    home and its minor units -> "-"; USD -> "<HOME>=X"; other -> "<CCY><HOME>=X";
    a NULL currency has no pair (NULL), so its rows stay unresolved.
    """
    c = _c(currency)
    return (F.when(c.isNull(), F.lit(None).cast("string"))
             .when(c.isin(home_currencies(home, minor_units)), F.lit(NO_PAIR))
             .when(c == DOLLAR, F.lit(home + PAIR_SUFFIX))
             .otherwise(F.concat(c, F.lit(home + PAIR_SUFFIX))))


def fixed_rate(currency: Column | str, home: str = HOME_CURRENCY,
               minor_units: Mapping[str, float] | None = None) -> Column:
    """1.0 for the home currency, the unit rate for a minor unit, else NULL."""
    c = _c(currency)
    minor = MINOR_UNITS if minor_units is None else minor_units
    expr = F.when(c == home, F.lit(1.0))
    for unit, rate in minor.items():
        expr = expr.when(c == unit, F.lit(float(rate)))
    return expr


def is_fx_symbol(ticker: Column | str, marker: str = PAIR_SUFFIX) -> Column:
    """FX symbol by name: contains "=X", case-insensitive."""
    return F.upper(_c(ticker)).contains(marker.upper())
