"""Columns of script files: encoding, paths, lines (S2-S4). `script_files` lists and reads the files."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.functions.text import lines_of


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Removes what will be written at `path` when the session ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def script_decode(content: Column) -> Column:
    """UTF-8 when the whole content is valid, else latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(
        F.decode(content, "ISO-8859-1"))


def relative_path(path: Column, root: str) -> Column:
    """Path below `root`, whatever the file system prefix."""
    return F.regexp_replace(path, rf"^(?:[A-Za-z0-9]+:(?://[^/]*)?)?{re.escape(root.rstrip('/'))}/", "")


def script_path(relative: Column) -> Column:
    return F.when(relative.contains("/"), F.regexp_replace(relative, "/[^/]*$", "")).otherwise(".")


def script_name(relative: Column) -> Column:
    return F.substring_index(relative, "/", -1)


def script_texts(scan: DataFrame, root: str) -> DataFrame:
    """(script_id, text); the relative path is the id, and line ends are LF."""
    text = F.regexp_replace(script_decode(F.col("content")), "\r\n?", "\n")
    return scan.select(relative_path(F.col("path"), root).alias("script_id"), text.alias("text"))


def script_lines(texts: DataFrame, cut: Callable[[Column], Column] = lines_of) -> DataFrame:
    """(script_id, src_line_no, n_src_lines, line), line numbers from 1 (S3). Narrow."""
    return (texts.withColumn("rows", cut(F.col("text")))
            .select("script_id", F.size("rows").cast("bigint").alias("n_src_lines"), F.posexplode("rows").alias("i", "line"))
            .select("script_id", (F.col("i") + 1).cast("bigint").alias("src_line_no"), "n_src_lines", "line"))
