"""Fixed values.

These must equal the reference's values for the results to agree; they are
kept together here and imported where they are used.
"""

# Calendar.
PUBLIC_HOLIDAYS = ("01-01", "12-25", "12-26")   # month-days that are never business days
DAYS_PER_YEAR = 365.25                          # collection window: years x 365.25, half-even
DEFAULT_COLLECTION_YEARS = 0.08
EPOCH_MILLIS_FROM = 1e10                        # |epoch| below: seconds; from here: milliseconds

# Currencies and symbols.
HOME_CURRENCY = "GBP"
MINOR_UNITS = {"GBp": 0.01}                     # minor unit -> rate to the home currency
DOLLAR = "USD"                                  # its pair is quoted as "<HOME>=X"
PAIR_SUFFIX = "=X"                              # FX pair symbol: "<CCY><HOME>=X"; FX by name
NO_PAIR = "-"                                   # pair symbol of rows needing no conversion
CURRENCY_TYPE = "CURRENCY"                      # instrument type of FX rows
UNKNOWN = "Unknown"                             # missing type or currency

# Store, checks, export.
STATUS_NOT_FOUND, STATUS_EMPTY, STATUS_LOADED = "not_found", "empty", "loaded"
DEFAULT_MAX_AGE_DAYS = 30
CHECK_TOLERANCE = 1e-6
EXPORT_DAY_FORMAT = "dd/MM/yyyy"
