"""Join helpers: broadcast only behind a measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from fxledger.session import materialise

# Default bound for broadcasting a derived table (bytes of its values).  A rate
# domain of 200 currencies x 25 years of days is about 1.8M rows of 40 bytes.
MAX_BROADCAST_BYTES = 96 << 20


def value_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values: text and binary by length, the rest eight each."""
    sizes = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 8
             if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8)
             for f in df.schema.fields]
    total = F.lit(8)
    for s in sizes:
        total = total + s
    return total


def sized(small: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Materialise ``small`` in the shared checkpoint folder and measure it.

    Returns the materialised table and whether its values take at most
    ``max_bytes``.  The size is observed while the checkpoint is written (one job).
    The checkpoint also cuts the lineage, so a lost executor never
    recomputes the derivation.  (A checkpoint carries no size statistics,
    which is why the caller decides on broadcasting from this size.)
    """
    seen = Observation()
    small = materialise(small.observe(seen, F.sum(value_bytes(small)).alias("bytes")))
    return small, (max_bytes > 0 and (seen.get["bytes"] or 0) <= max_bytes)


def broadcast_if(df: DataFrame, within_bound: bool) -> DataFrame:
    """Mark ``df`` for broadcast when its size bound has been proven."""
    return F.broadcast(df) if within_bound else df


def bounded_broadcast(small: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Materialise and measure ``small``; mark it for broadcast only when it
    takes at most ``max_bytes``.  Beyond the bound the caller's join stays a
    shuffle join (AQE splits skewed partitions)."""
    df, ok = sized(small, max_bytes)
    return broadcast_if(df, ok)
