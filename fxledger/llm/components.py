"""Connected components of a large edge table by alternating star contraction.

Each round links every node to the smallest of its neighbourhood, first towards
larger, then towards smaller neighbours, until the edges are stars.  Only
minima are aggregated, so a node with very many neighbours costs no single
task; the edges are written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fxledger.session import write_scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node of an edge between
    different nodes.  Direction, repeats and loops do not matter."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = write_scratch(e, "edges")
    before = None
    while True:
        n, check = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, check) == before or n == 0:
            break
        before = (n, check)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "k")
        large = (both.where("v > u").join(least, F.col("u") == F.col("k"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = (large.join(least, F.col("u") == F.col("k"))
                 .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
                         .alias("x")).select("x.*").where("u <> v").distinct())
        e = write_scratch(small, "edges")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
