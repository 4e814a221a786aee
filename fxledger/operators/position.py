"""Order as data: the place of each row in a total order, without a single task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from fxledger.session import write_scratch

_IN_PARTITION = (1 << 33) - 1  # the low bits of monotonically_increasing_id


def with_position(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """``df`` with the place of each row (from 1) by ``order``.

    Rows are dealt by range and sorted within the ranges; a row's place is its number
    in its range plus the rows of the ranges before.  Those counts are one short row
    for each range.  Rows that ``order`` does not tell apart follow each other in
    any order.  The sorted rows are written once, so both steps see the same ranges.
    """
    placed = write_scratch(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))), "ordered")
    counts = sorted((r["_part"], r["n"]) for r in
                    placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before = [0, *accumulate(n for _, n in counts)]
    offsets = df.sparkSession.createDataFrame(
        [(part, first) for (part, _), first in zip(counts, before)], "_part int, _before long")
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_before") + F.col("_seq") + 1).drop("_part", "_seq", "_before"))
