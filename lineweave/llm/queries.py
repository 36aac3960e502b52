"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lineweave.llm import (
    op1_url_filter, op2_line_dedup, op3_html_extraction, op4_pieces, op5_sentence_spans, op6_suffix_dedup, op7_quality,
    op8_ngram_join, op9_decontamination, op10_warc, op11_whitening, op12_chat, op13_spelling)
from lineweave.llm.shared import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)
    return run


def queries() -> dict[str, Query]:
    found = {
        "op1_url_filter": op1_url_filter.op1_url_filter,
        "op2_line_dedup": op2_line_dedup.op2_line_dedup,
        "op3_html_extraction": op3_html_extraction.op3_html_extraction,
        "op4_pieces": op4_pieces.op4_pieces,
        "op5_sentence_spans": op5_sentence_spans.op5_sentence_spans,
        "op6_suffix_dedup": op6_suffix_dedup.op6_suffix_dedup,
        "op7_quality": op7_quality.op7_quality,
        "op8_ngram_join": op8_ngram_join.op8_ngram_join,
        "op9_decontamination": op9_decontamination.op9_decontamination,
        "op10_warc": op10_warc.op10_warc,
        "op11_whitening": op11_whitening.op11_whitening,
        "op12_chat": op12_chat.op12_chat,
        "op13_spelling": op13_spelling.op13_spelling,
    }
    return {name: _shipped(q) for name, q in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": op1_url_filter.OP1_SQL, "op12_chat": op12_chat.OP12_SQL}
