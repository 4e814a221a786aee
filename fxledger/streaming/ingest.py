"""Incremental store updates driven by Structured Streaming.

The reference fetches missing bars and merges them into its store in batch;
here new bar files landing in a folder are merged as they arrive.  Each
micro-batch is an ordinary upsert (fresh bar wins per symbol-day), so a
replayed batch after a failure gives the same store: the sink is idempotent
and the stream's checkpoint (in the shared folder) records progress.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from fxledger.operators.clean import normalise_bars
from fxledger.sources.store import PriceStore


def start_ingest(spark: SparkSession, landing: str, schema: StructType, store: PriceStore,
                 ticker: str = "ticker", price: str = "old_price", when: str = "date",
                 order: str | None = "ord", *, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """Merge bar files from ``landing`` into ``store``.  ``checkpoint`` is the
    stream's own folder: a restart goes on from it, and never replays old files
    over newer bars.

    ``available_now`` processes what is there and stops (scheduled runs);
    otherwise the query keeps polling.
    """
    stream = spark.readStream.schema(schema).parquet(landing)

    def merge(batch: DataFrame, batch_id: int) -> None:
        bars = normalise_bars(batch, ticker, price, when, order)
        store.upsert(bars, order=order or "ord")

    writer = (stream.writeStream.foreachBatch(merge)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
