"""The corpus pipeline: stages that turn `documents` into training data, each written as Parquet and read by the next.

Stages keep the columns of documents; the last one adds what it computes. SQL cannot express the perplexity model, so
ORACLE_SQL is None and tests hold the pipeline against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lineweave.llm import op2_line_dedup, op4_pieces, op7_quality, op8_ngram_join, op9_decontamination
from lineweave.llm.shared import ship_package, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(step: Stage) -> Stage:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return step(spark, docs, sf_dir)
    return run


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", _stage(op7_quality.quality_stage)),
    ("line_dedup", _stage(op2_line_dedup.line_stage)),
    ("ngram_join", _stage(op8_ngram_join.ngram_stage)),
    ("decontamination", _stage(op9_decontamination.decontamination_stage)),
    ("pieces", _stage(op4_pieces.pieces_stage)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
