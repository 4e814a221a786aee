"""Parameters of the registered queries (shared with the oracle SQL)."""

import datetime as dt

EUR_PAIR = "EURGBP=X"

# Conversion / export
EXPORT_START = dt.date(2001, 6, 1)
QUOTE_DAY = dt.date(2001, 11, 1)

# Collection window (years as in the sample configuration)
COLLECTION_YEARS = 0.16

# Listing clip
CLIP_START = dt.date(1996, 1, 1)
CLIP_END = dt.date(2000, 6, 30)

# Event store: requested range, stored slice, fresh slice
EVENTS_FROM = dt.date(2024, 1, 1)
EVENTS_TO = dt.date(2024, 1, 30)
EVENTS_STORED_FROM = dt.date(2024, 1, 6)
EVENTS_STORED_TO = dt.date(2024, 1, 20)
EVENTS_AS_OF = dt.date(2024, 1, 21)  # the day after the stored slice: gaps start on it
EVENTS_FRESH_FROM = dt.date(2024, 1, 18)
FRESH_FACTOR = 1.01

# Retention
EXPIRY_NOW = dt.datetime(2024, 2, 9, 18, 0, 0)
EXPIRY_DAYS = 20

STORE_BUCKETS = 2  # times the months of the bars

# Price book
BOOK_AS_OF = dt.date(2001, 11, 1)
BOOK_YEARS = 0.5
BOOK_STORED_TO = dt.date(2001, 6, 30)

# The store whose files of one month are damaged: some symbols have bars in it
DAMAGED_MONTH = "2001-11"
