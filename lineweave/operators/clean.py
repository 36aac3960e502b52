"""Row filters and projections on a table of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave import fixed_values as fv
from lineweave.functions import text as tx


def strip_line_comments(lines: DataFrame) -> DataFrame:
    lines = lines.where(~tx.is_comment_line(F.col("line"))).withColumn("line", tx.cut_hash_and_dashes(F.col("line")))
    return tx.computed_once(lines, "line", tx.cut_block_comments(F.col("line")))


def strip_comments_hashslash(lines: DataFrame) -> DataFrame:
    return (lines.where(~tx.is_hash_slash_line(F.col("line")))
            .withColumn("line", tx.cut_first_block_comment(F.col("line"))))


def drop_boilerplate_lines(lines: DataFrame, tokens: list[str] = fv.BOILERPLATE_TOKENS) -> DataFrame:
    return lines.where(~tx.is_boilerplate(F.col("line"), tokens))


def normalize_lines(lines: DataFrame) -> DataFrame:
    return tx.computed_once(lines, "line", tx.normalize_line(F.col("line")))


def drop_job_control_lines(lines: DataFrame) -> DataFrame:
    return lines.where(~tx.is_job_control(F.col("line")))


def wrap_first_call(lines: DataFrame) -> DataFrame:
    """Blanks around the first `spark.sql(…)` of each script that closes on its own line (C9); other lines stay as they are."""
    calls = F.col("line").rlike(tx.ONE_LINE_CALL)
    first = lines.where(calls).groupBy("script_id").agg(F.min("src_line_no").alias("src_line_no")).withColumn("first", F.lit(True))
    return lines.join(first, ["script_id", "src_line_no"], "left").withColumn(
        "line", F.when(F.col("first"), tx.pad_call(F.col("line"))).otherwise(F.col("line"))).drop("first")
