"""Column expressions (built-in Spark functions only)."""

from fxledger.functions.currency import fixed_rate, fx_symbol, is_fx_symbol
from fxledger.functions.dates import (
    business_day_count, coerce_day, collection_days, collection_window,
    epoch_seconds_to_ts, epoch_to_day, roll_business_day,
)
from fxledger.functions.numeric import coerce_numeric, is_number, nan_to_null
from fxledger.functions.ranges import missing_ranges

__all__ = [
    "business_day_count", "coerce_day", "coerce_numeric", "collection_days",
    "collection_window", "epoch_seconds_to_ts", "epoch_to_day",
    "fixed_rate", "fx_symbol", "is_fx_symbol", "is_number", "missing_ranges",
    "nan_to_null", "roll_business_day",
]
