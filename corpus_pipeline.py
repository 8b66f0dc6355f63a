"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, mixing.

Every stage takes all documents that the one before kept and returns their columns; what
it decides is gone for the next one. The last returns how often the mix takes a document.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questloom.llm import decontam, lines, mixing, neardup, quality
from questloom.llm.common import row_key, written
from questloom.llm.registry import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the text rules or lie outside the perplexity bands go."""
    return quality.accept(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents share go; ``n_chars`` follows the text."""
    kept = lines.dedup_lines(docs).drop("_n_lines", "_n_dropped")
    if "n_chars" in kept.columns:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", size)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays, once.

    Rows without an id cannot be told apart by it and stay.
    """
    groups = neardup.near_duplicates(docs)
    first = groups.filter(F.col("component_id") == F.col("doc_id")).select(F.col("doc_id").alias("_first")).distinct()
    names = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    key, text = (f"_c{names.index(n)}" for n in ("doc_id", "text"))
    stay = (
        plain.join(first, F.col(key) == F.col("_first"), "left_semi")
        .select("*", *row_key(text))
        .dropDuplicates([key, "_k1", "_k2"])
        .drop("_k1", "_k2")
    )
    return stay.union(plain.filter(F.col(key).isNull())).toDF(*names)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, with the number of times the mix takes it."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mix_stage),
]

#: Perplexity bands and alignments have no SQL form; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
            gc.collect()  # lets go of the plans of the stage, which the driver holds through Python
    return docs
