"""The corpus pipeline: quality rules, near duplicates, repeated passages,
benchmark passages, packing.

Each stage takes the documents that its predecessor kept and returns a Spark
table; all but the last return the columns of ``documents``, whatever these
are.  A stage that changes a text also brings ``n_chars`` up to date.

Defined results, of every stage: an empty table stays empty.  A null text has no words:
the quality rules reject it; other stages keep it as it is, with no link and no span.
Null ids stay, as do repeated rows, but of equal texts one document of the smallest id
is kept by the second stage (rows that repeat it stay with it, and a null id counts as
the smallest).  Ties are settled by doc_id and place in the text.  Texts of any length
are taken whole.  Columns may have any names, those of the operators' results too.
The pipeline fails loudly if the operators are missing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from fxledger.llm import fm_index, jaccard_join, packing, quality, queries, substring_dedup
from fxledger.llm.shipping import ship
from fxledger.session import delete_scratch, settled

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the default quality policy rejects."""
    ship(spark)
    return quality.keep(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group of near duplicates."""
    ship(spark)
    return jaccard_join.representatives(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of twenty words or more that an earlier document, or an
    earlier part of the same one, holds."""
    ship(spark)
    return substring_dedup.clean(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the passages that occur in the benchmark."""
    return fm_index.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of what is left into sequences: one row for each piece."""
    ship(spark)
    pieces = packing.pack(docs, queries.tokenizer(), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each writes its result as Parquet in
    the shared folder, and the next one reads that.  What a stage wrote on the way is
    deleted when it ends, and its input once the next result is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = settled(spark, name, partial(stage, spark, docs, sf_dir))
        if before is not None:
            delete_scratch(spark, before)
        before = path
    return docs
