"""fxledger: daily price histories and home-currency conversion on Spark.

Pure ``DataFrame -> DataFrame`` operators over all symbols at once; no Python
UDFs, no driver loops.  See ``README.md`` for the map of operators.
"""

from fxledger.operators.convert import convert_prices, prepare
from fxledger.plans.price_book import Book, EmptyBook, book, price_book, run_book, self_check
from fxledger.session import build_session
from fxledger.sources.export import export_rows, write_csv
from fxledger.sources.store import PriceStore

__version__ = "0.1.0"

__all__ = ["Book", "EmptyBook", "PriceStore", "book", "build_session", "convert_prices", "export_rows", "prepare",
           "price_book", "run_book", "self_check", "write_csv"]
