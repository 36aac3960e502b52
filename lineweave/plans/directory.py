"""A directory of scripts to its program-to-table map and to its call bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave import fixed_values as fv
from lineweave.operators import pairs
from lineweave.plans.call_bodies import first_call_bodies
from lineweave.plans.program_map import MAP_COLUMNS, bad_scripts, program_table_map
from lineweave.sources import files, script_files


def _located(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"script_path": files.script_path(F.col("script_id")), "script_name": files.script_name(F.col("script_id"))})


def map_directory(spark: SparkSession, root: str, strd_dt: str, extensions: list[str] = fv.SCRIPT_EXTENSIONS,
                  schemas: list[str] = fv.KNOWN_SCHEMAS, chunk_lines: int = fv.CHUNK_LINES) -> DataFrame:
    """The program-to-table map of every script below `root`."""
    lines, sizes = script_files.script_lines(script_files.script_scan(spark, root, extensions), root)
    rows = program_table_map(lines, strd_dt, schemas, chunk_lines=chunk_lines, sizes=sizes)
    return _located(rows).select(MAP_COLUMNS)


def ended_scripts(spark: SparkSession, root: str, extensions: list[str] = fv.SCRIPT_EXTENSIONS, chunk_lines: int = fv.CHUNK_LINES) -> DataFrame:
    """(script_path, script_name, bad_line_no): the scripts below `root` that the map leaves off before their end, and at which line."""
    lines, sizes = script_files.script_lines(script_files.script_scan(spark, root, extensions), root)
    return _located(bad_scripts(lines, chunk_lines, sizes)).select("script_path", "script_name", "bad_line_no")


def call_bodies(spark: SparkSession, root: str, extensions: list[str] = fv.SCRIPT_EXTENSIONS) -> DataFrame:
    """The first call body of every script below `root`, with the name it is assigned to."""
    contents = script_files.script_contents(script_files.script_scan(spark, root, extensions))
    return _located(first_call_bodies(files.script_texts(contents, root))).select("script_path", "script_name", "status", "df_name", "body")


def df_sql_pairs(spark: SparkSession, root: str, extensions: list[str] = fv.SCRIPT_EXTENSIONS) -> DataFrame:
    """DataFrame names and their SQL texts of every script below `root`."""
    lines, _ = script_files.script_lines(script_files.script_scan(spark, root, extensions), root)
    return _located(pairs.df_sql_pairs(lines)).select("script_path", "script_name", "status", "df_name", "sql_text")
