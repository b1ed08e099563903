"""The corpus pipeline: documents that pass the quality rules, less repeated lines, near copies and benchmark leaks, packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from strataloom.llm.common import store


def pass_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has."""
    return line_dedup.dedup(docs).select(*docs.columns).withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", pass_rules), ("line dedup", drop_lines), ("near dedup", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: The divergence rules and the packing are beyond SQL: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each one keeps is a stored table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, _ = store(docs, name.replace(" ", "-"))
    return docs
