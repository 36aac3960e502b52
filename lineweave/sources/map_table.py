"""The stored program-to-table map: partitioned table and delimited export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.plans.program_map import MAP_COLUMNS, expand_copies

MAP_SCHEMA = ("script_path string, script_name string, line_no long, df_var string, stmt_type string, table_name string, "
              "in_line boolean, line string, copies long, strd_dt string")


def write_map(rows: DataFrame, path: str) -> None:
    """Replace the partitions of the dates in `rows`; other dates stay."""
    (rows.select(MAP_COLUMNS).write.partitionBy("strd_dt").mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """The stored map; a filter on `strd_dt` reads only its partitions."""
    return spark.read.schema(MAP_SCHEMA).option("basePath", path).parquet(path)


def reset_map(spark: SparkSession, path: str) -> None:
    """Empty the stored map: the folder stays, all its days go."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(folder, True)
    fs.mkdirs(folder)


def record_text() -> Column:
    """The eight fields of a row, delimited; names absent from their line mark the variable."""
    variable = F.when(F.col("in_line"), F.col("df_var")).otherwise(F.concat(F.lit("@@##"), F.col("df_var")))
    return F.concat_ws("|", "strd_dt", "script_path", "script_name", F.col("line_no").cast("string"),
                       variable, "stmt_type", "table_name", "line")


def export_records(rows: DataFrame, path: str) -> None:
    """One delimited text line per row and copy."""
    expand_copies(rows).select(record_text().alias("value")).write.mode("overwrite").text(path)
