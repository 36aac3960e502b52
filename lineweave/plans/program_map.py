"""Script lines to the program-to-table map, end to end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave import fixed_values as fv
from lineweave.operators import assemble, clean, lineage, variables
from lineweave.operators.scan import cut_lineage, levels_for

MAP_COLUMNS = ["strd_dt", "script_path", "script_name", "line_no", "df_var", "stmt_type", "table_name",
               "in_line", "line", "copies"]


def with_length(lines: DataFrame, chunk_lines: int) -> DataFrame:
    """Add `n_src_lines` to lines that lack it, as far as telling long scripts needs it.

    Only the first `chunk_lines` lines of a script have to ask whether there are more, so the join
    sees no more than that many rows of any script.
    """
    beyond = lines.where(F.col("src_line_no") > chunk_lines)
    long_scripts = beyond.groupBy("script_id").agg(F.max("src_line_no").alias("n_src_lines"))
    head = lines.where(F.col("src_line_no") <= chunk_lines).join(long_scripts, "script_id", "left")
    return head.withColumn("n_src_lines", F.coalesce("n_src_lines", "src_line_no")).unionByName(
        beyond.withColumn("n_src_lines", F.col("src_line_no")))


def by_length(lines: DataFrame, body: Callable[[DataFrame, int], DataFrame],
              chunk_lines: int = fv.CHUNK_LINES, sizes: DataFrame | None = None, lines_a_task: int = fv.LINES_A_TASK) -> DataFrame:
    """Run `body(lines, levels)` on short scripts and, where there are any, on the chunks of long ones.

    `lines` has (script_id, src_line_no, line) and, from sources that know it, n_src_lines. Short
    scripts need one shuffle on script_id and no join; only scripts above `chunk_lines` pay for
    carrying state. The longest script and the number of lines are asked for first, from `sizes`
    (script_id, n_src_lines) when that is cheaper to read than `lines`. Lines are dealt to so many tasks
    that each has about `lines_a_task` of them, whatever the number of all.
    """
    measured = lines if sizes is None else sizes
    longest, total = measured.agg(F.max("n_src_lines" if "n_src_lines" in measured.columns else "src_line_no"),
                                  F.count("*") if sizes is None else F.sum("n_src_lines")).first()
    levels = levels_for(longest or 0, chunk_lines)
    # an explicit number: Spark would size tasks by shuffled bytes, of which repetitive text has few, while every window sorts whole rows
    tasks = max(lines.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // lines_a_task))
    placed = lines.withColumn("pos", F.col("src_line_no"))
    if not levels:
        return body(placed.select("script_id", "pos", "line").repartition(tasks, "script_id"), 0)
    if "n_src_lines" not in lines.columns:
        placed = with_length(lines, chunk_lines).withColumn("pos", F.col("src_line_no"))
    is_long = F.col("n_src_lines") > chunk_lines
    chunk = F.floor((F.col("pos") - 1) / chunk_lines).alias("chunk")
    short = body(placed.where(~is_long).select("script_id", "pos", "line").repartition(tasks, "script_id"), 0)
    long = body(placed.where(is_long).select("script_id", "pos", "line", chunk).repartition(tasks, "script_id", "chunk"), levels)
    return short.unionByName(long.select(*short.columns))


def cleaned(lines: DataFrame, tokens: list[str] = fv.BOILERPLATE_TOKENS) -> DataFrame:
    return clean.drop_boilerplate_lines(clean.strip_line_comments(lines), tokens)


def substituted(lines: DataFrame, levels: int) -> DataFrame:
    lines = cut_lineage(cleaned(lines), levels)
    lines = clean.normalize_lines(variables.fill_placeholders(lines, levels))
    return clean.drop_job_control_lines(lines)


def assembled(lines: DataFrame, levels: int) -> DataFrame:
    """(script_id, pos, line_no, line): cleaned, filled, joined and numbered."""
    lines = cut_lineage(assemble.join_continuations(substituted(lines, levels), levels), levels)
    return assemble.fill_save_dir(lines, levels)


def owned(lines: DataFrame, levels: int) -> DataFrame:
    return cut_lineage(lineage.block_owner(assembled(lines, levels), levels), levels)


def statements(lines: DataFrame, levels: int) -> DataFrame:
    """Typed lines with owner, found names and view uses, up to the first bad line of each script."""
    stmts = lineage.temp_view_use(lineage.classify(owned(lines, levels), keep_bad=True), levels)
    return cut_lineage(lineage.drop_after_bad_line(stmts, levels), levels)


def program_table_map(lines: DataFrame, strd_dt: str, schemas: list[str] = fv.KNOWN_SCHEMAS,
                      rejected: list[str] = fv.REJECTED_SCHEMA_PREFIXES,
                      chunk_lines: int = fv.CHUNK_LINES, sizes: DataFrame | None = None) -> DataFrame:
    """One row per statement and table name: (script_id, strd_dt, line_no, df_var, stmt_type,
    table_name, in_line, line, copies).

    A view declared n times is used n times by every later statement that names it. Such equal rows
    are one row with `copies` = n, which keeps the map linear in the scripts; see `expand_copies`.
    """
    def body(part: DataFrame, levels: int) -> DataFrame:
        stmts = lineage.carried_refs(statements(part, levels), levels, schemas, rejected)
        return lineage.name_rows(stmts).select(
            "script_id", F.lit(strd_dt).alias("strd_dt"), "line_no", F.col("owner").alias("df_var"),
            F.col("kind").alias("stmt_type"), "table_name", "in_line", "line", "copies")

    return by_length(lines, body, chunk_lines, sizes)


def bad_scripts(lines: DataFrame, chunk_lines: int = fv.CHUNK_LINES, sizes: DataFrame | None = None) -> DataFrame:
    """(script_id, bad_line_no): the scripts the map leaves off before their end, and where."""
    def body(part: DataFrame, levels: int) -> DataFrame:
        stmts = lineage.temp_view_use(lineage.classify(assembled(part, levels), keep_bad=True), levels)
        return stmts.where(lineage.is_bad()).select("script_id", "line_no")

    rows = by_length(lines, body, chunk_lines, sizes)
    return rows.groupBy("script_id").agg(F.min("line_no").alias("bad_line_no"))


def expand_copies(rows: DataFrame) -> DataFrame:
    """One row per copy."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copy", "copies")
