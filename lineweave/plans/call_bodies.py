"""Script texts to the first call body of each, and to their DataFrame/SQL pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave import fixed_values as fv
from lineweave.functions import spans
from lineweave.functions.text import lines_of
from lineweave.operators import pairs


def first_call_bodies(texts: DataFrame) -> DataFrame:
    """Replace `text` by status, df_name and body."""
    keys = [c for c in texts.columns if c != "text"]
    return (texts.withColumn("span", spans.first_balanced_span(F.col("text")))
            .withColumn("call", spans.first_call_body(F.col("text"), F.col("span")))
            .select(*keys, "call.*"))


def df_sql_pairs(texts: DataFrame, chunk_lines: int = fv.CHUNK_LINES) -> DataFrame:
    """The pairs of texts (script_id, text); see `operators.pairs`."""
    lines = texts.select("script_id", F.posexplode(lines_of(F.col("text"))).alias("i", "line"))
    return pairs.df_sql_pairs(lines.select("script_id", (F.col("i") + 1).alias("src_line_no"), "line"), chunk_lines)
