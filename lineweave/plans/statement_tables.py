"""SQL statements to table references and table sets. Every step is narrow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave import fixed_values as fv
from lineweave.functions import refs


def with_references(statements: DataFrame) -> DataFrame:
    """Add `refs`, the references of the cleaned `sql`."""
    return (statements.withColumn("sql", refs.clean_statement(F.col("sql")))
            .withColumn("refs", refs.statement_table_refs(F.col("sql"))))


def reference_rows(statements: DataFrame) -> DataFrame:
    """One row per reference, with its position `ref_no` and its label."""
    keys = [c for c in statements.columns if c != "sql"]
    return (with_references(statements)
            # the outer form: the inner one would also filter by size, computing the array twice
            .select(*keys, F.posexplode_outer("refs").alias("ref_no", "ref"))
            .where(F.col("ref_no").isNotNull())
            .select(*keys, F.col("ref_no").cast("bigint").alias("ref_no"), "ref.*")
            .withColumn("label", refs.reference_label(F.col("table_name"), F.col("alias"))))


def table_rows(statements: DataFrame, schemas: list[str] = fv.STATEMENT_SCHEMAS) -> DataFrame:
    """One row per distinct table of a statement, split by schema membership (`schema_known`)."""
    keys = [c for c in statements.columns if c != "sql"]
    return (with_references(statements)
            .select(*keys, F.explode_outer(refs.statement_tables(F.col("sql"), F.col("refs"))).alias("table_name"))
            .where(F.col("table_name").isNotNull())
            .withColumn("schema_known", refs.in_schemas(F.col("table_name"), schemas)))
