
from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lineweave.functions import names as nm
from lineweave.functions import refs, spans
from lineweave.functions import text as tx
from lineweave.operators import assemble, clean, lineage, pairs, variables
from lineweave.plans import call_bodies, program_map, statement_tables
from lineweave.sources import corpus, files, map_table, script_files

try:  # the training-data operators and their pipeline may be absent, or a package that they need
    import corpus_pipeline
    from lineweave.llm import queries as training
except ImportError:
    corpus_pipeline = training = None

Query = Callable[[SparkSession, str], DataFrame]
DATE = "20240101"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_length(body: Callable[[DataFrame, int], DataFrame]) -> Query:
    return lambda spark, sf_dir: program_map.by_length(
        corpus.corpus_lines(spark, sf_dir), body, sizes=corpus.script_sizes(spark, sf_dir))


def _lines(step: Callable[[DataFrame], DataFrame]) -> Query:
    """A narrow step on the corpus lines."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return step(corpus.corpus_lines(spark, sf_dir).select("script_id", "src_line_no", "line"))
    return run


def _doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("script_id"), "text")


def _doc_lines(spark: SparkSession, sf_dir: str, cut: Callable = tx.lines_of) -> DataFrame:
    return files.script_lines(_doc_texts(spark, sf_dir), cut).select("script_id", "src_line_no", "line")


def _pages(**columns: Callable) -> Query:
    """Columns computed from each page; `struct` is taken apart."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = _table(spark, sf_dir, "pages")
        out = pages.select("page_id", *[make(F.col("html"), F.col("url")).alias(name) for name, make in columns.items()])
        return out.select("page_id", "struct.*") if "struct" in columns else out
    return run


def _page_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_bodies.first_call_bodies(_table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")))


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as bytes, in latin-1 where it fits and in UTF-8 where it does not, decoded again."""
    text = F.col("text")
    content = F.when(text.rlike(r"^[\x00-\xff]*$"), F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(files.script_decode(content)).alias("text_md5"))


def _document_files(spark: SparkSession, sf_dir: str) -> str:
    """Every text of `documents` as a file: hidden names and folders, one extension that is none, latin-1 where it fits."""
    root = _stored_map(spark).replace("/map-", "/scripts-")
    files.remove_at_exit(spark, root)
    text, i = F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")
    names = [(i, ".sql"), (F.concat(F.lit("_x"), i), ".py"), (F.concat(F.lit(".h/"), i), ".sh"), (F.concat(F.lit("sub/_y/"), i), ".sql"), (i, ".SQL"),
             (F.concat(F.lit("sub/.w"), i), ".py")]
    name = F.element_at(F.array(*[F.concat(a, F.lit(b)) for a, b in names]), (F.col("doc_id") % 6 + 1).cast("int"))
    content = F.when(text.rlike(r"^[\x00-\xff]*$"), F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    script_files.write_scripts(_table(spark, sf_dir, "documents").select(name.alias("name"), content.alias("content")), root)
    return root


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _document_files(spark, sf_dir)
    path = files.relative_path(F.col("path"), root)
    return script_files.script_scan(spark, root).select(files.script_path(path).alias("script_path"), files.script_name(path).alias("script_name"), "length")


def _range_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the files, read in ranges so short that most files are cut."""
    root = _document_files(spark, sf_dir)
    lines, _ = script_files.script_lines(script_files.script_scan(spark, root), root, 1 << 12)
    return lines


def _assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = program_map.cleaned(corpus.corpus_lines(spark, sf_dir)).withColumnRenamed("src_line_no", "pos")
    return variables.assignments(lines).withColumnRenamed("pos", "src_line_no")


def _assignment_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = program_map.cleaned(corpus.corpus_lines(spark, sf_dir)).withColumnRenamed("src_line_no", "pos")
    return variables.assignment_map(lines)


def _pos(df: DataFrame) -> DataFrame:
    return df.select("script_id", F.col("pos").alias("src_line_no"), "line")


def _filled(lines: DataFrame, levels: int) -> DataFrame:
    return _pos(variables.fill_placeholders(program_map.cleaned(lines), levels))


def _joined(lines: DataFrame, levels: int) -> DataFrame:
    return _pos(assemble.join_continuations(program_map.substituted(lines, levels), levels))


def _numbered(lines: DataFrame, levels: int) -> DataFrame:
    return program_map.assembled(lines, levels).select("script_id", F.col("pos").alias("src_line_no"), "line_no")


def _df_variables(lines: DataFrame, levels: int) -> DataFrame:
    return (program_map.assembled(lines, levels).where(F.col("line").contains("df_"))
            .select("script_id", "line_no", nm.df_variable(F.col("line")).alias("df_var")))


def _kinds(lines: DataFrame, levels: int) -> DataFrame:
    return lineage.classify(program_map.assembled(lines, levels)).select("script_id", "line_no", F.col("kind").alias("stmt_type"))


def _found(lines: DataFrame, levels: int) -> DataFrame:
    return lineage.classify(program_map.assembled(lines, levels)).select(
        "script_id", "line_no", F.col("kind").alias("stmt_type"), F.posexplode("found").alias("ref_no", "table_ref")
    ).withColumn("ref_no", F.col("ref_no").cast("bigint"))


def _owners(lines: DataFrame, levels: int) -> DataFrame:
    return lineage.block_owner(program_map.assembled(lines, levels), levels).select("script_id", "line_no", "owner")


def _view_uses(lines: DataFrame, levels: int) -> DataFrame:
    stmts = lineage.temp_view_use(lineage.classify(program_map.assembled(lines, levels)), levels)
    return (stmts.select("script_id", "line_no", F.inline("uses"))
            .select("script_id", "line_no", F.col("name").alias("view_name"), "copies"))


def _statements(lines: DataFrame, levels: int) -> DataFrame:
    stmts = lineage.temp_view_use(lineage.classify(program_map.assembled(lines, levels), keep_bad=True), levels)
    return lineage.drop_after_bad_line(stmts, levels)


def _normal_names(lines: DataFrame, levels: int) -> DataFrame:
    names = nm.chosen_names(F.col("line"), F.col("found"), F.col("kind"))
    return _statements(lines, levels).select(
        "script_id", "line_no", F.col("kind").alias("stmt_type"), F.posexplode(names).alias("ref_no", "table_name")
    ).withColumn("ref_no", F.col("ref_no").cast("bigint"))


def _schema_test(lines: DataFrame, levels: int) -> DataFrame:
    names = nm.chosen_names(F.col("line"), F.col("found"), F.col("kind"))
    name, line = F.col("table_name"), F.col("line")
    return (_statements(lines, levels)
            .select("script_id", "line_no", "line", F.posexplode(names).alias("ref_no", "table_name"))
            .withColumn("ref_no", F.col("ref_no").cast("bigint"))
            .withColumn("is_table", nm.known_table(name) & ~nm.masked_by_line(name, line, F.upper(line))).drop("line"))


def _named(lines: DataFrame, levels: int) -> DataFrame:
    return lineage.carried_refs(program_map.statements(lines, levels), levels)


def _carried(lines: DataFrame, levels: int) -> DataFrame:
    return _named(lines, levels).select("script_id", "line_no", F.col("kind").alias("stmt_type"), F.col("name").alias("table_name"), "copies")


def _flags(lines: DataFrame, levels: int) -> DataFrame:
    return lineage.name_rows(_named(lines, levels)).select("script_id", "line_no", "table_name", "in_line")


def _cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every script: a write statement without a path ends some."""
    kept = _by_length(lambda lines, levels: _statements(lines, levels).select("script_id", "line_no"))(spark, sf_dir)
    return kept.groupBy("script_id").agg(F.count("*").alias("n_statements"), F.max("line_no").alias("last_line_no"))


def _bad_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program_map.bad_scripts(corpus.corpus_lines(spark, sf_dir), sizes=corpus.script_sizes(spark, sf_dir))


def _map(spark: SparkSession, sf_dir: str, date: str = DATE) -> DataFrame:
    rows = program_map.program_table_map(
        corpus.corpus_lines(spark, sf_dir), date, sizes=corpus.script_sizes(spark, sf_dir))
    return rows.withColumns({
        "script_path": F.concat(F.lit("jobs/"), (F.col("script_id") % 100).cast("string")),
        "script_name": F.concat(F.lit("job_"), F.col("script_id").cast("string"), F.lit(".py")),
    }).select(program_map.MAP_COLUMNS)


def _stored_map(spark: SparkSession) -> str:
    """A new path in the folder that all executors share; removed when the session ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/map-{uuid.uuid4().hex}"
    files.remove_at_exit(spark, path)
    return path


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _stored_map(spark)
    map_table.write_map(_map(spark, sf_dir), path)
    return map_table.read_map(spark, path).select(program_map.MAP_COLUMNS)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir).select(map_table.record_text().alias("record"), "copies")


def _replaced_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day is stored and the map emptied; then two days are stored, and the second again with its FROM statements only."""
    path, rows = _stored_map(spark), _map(spark, sf_dir)
    second = F.lit("20240102").alias("strd_dt")
    rest = [c for c in program_map.MAP_COLUMNS if c != "strd_dt"]
    map_table.write_map(rows.select(F.lit("20231231").alias("strd_dt"), *rest), path)
    map_table.reset_map(spark, path)
    if not map_table.read_map(spark, path).isEmpty():
        raise RuntimeError(f"the map at {path} still has rows after its reset")
    map_table.write_map(rows, path)
    first = map_table.read_map(spark, path).where(F.col("strd_dt") == DATE)
    map_table.write_map(first.select(second, *rest), path)
    map_table.write_map(first.where("stmt_type = 'FROM'").select(second, *rest), path)
    return map_table.read_map(spark, path).groupBy("strd_dt", "stmt_type").agg(F.count("*").alias("n"))


def _cleaned_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_statements(spark, sf_dir).withColumn("sql", refs.clean_statement(F.col("sql")))


def _insert_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (_cleaned_statements(spark, sf_dir)
            .select("script_id", "stmt_no", refs.insert_target(F.col("sql")).alias("table_name")).where("table_name <> ''"))


def _reference_rows(*columns: str) -> Query:
    return lambda spark, sf_dir: statement_tables.reference_rows(
        corpus.corpus_statements(spark, sf_dir)).select("script_id", "stmt_no", "ref_no", *columns)


def entry(spark: SparkSession) -> DataFrame:
    """The program-to-table map of the smallest corpus."""
    return _map(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return _reference_queries() | ({} if training is None else training.queries() | {"pipeline": corpus_pipeline.run})


def _reference_queries() -> dict[str, Query]:
    return {
        "script_scan": _scanned,
        "script_decode": _decoded,
        "script_lines_by_range": _range_lines,
        "script_lines": _doc_lines,
        "relative_path": _pages(
            script_path=lambda html, url: files.script_path(files.relative_path(url, "/")),
            script_name=lambda html, url: files.script_name(files.relative_path(url, "/"))),
        "mapping_sink": _stored,
        "mapping_record": _records,
        "mapping_table_reset": _replaced_day,
        "strip_line_comments": _lines(clean.strip_line_comments),
        "strip_comments_text": lambda spark, sf_dir: _table(spark, sf_dir, "documents").select(
            "doc_id", tx.strip_comments_text(F.col("text")).alias("text")),
        "strip_comments_hashslash": lambda spark, sf_dir: clean.strip_comments_hashslash(_doc_lines(spark, sf_dir, tx.all_lines_of)),
        "strip_comments_stmt": lambda spark, sf_dir: corpus.corpus_statements(spark, sf_dir).withColumn(
            "sql", tx.strip_comments_stmt(F.col("sql"))),
        "drop_boilerplate_lines": _lines(program_map.cleaned),
        "drop_job_control_lines": _lines(clean.drop_job_control_lines),
        "normalize_line": _lines(clean.normalize_lines),
        "pad_parentheses": _pages(html=lambda html, url: tx.pad_parentheses(html)),
        "wrap_sql_call": _lines(clean.wrap_first_call),
        "strip_placeholder_marks": _pages(html=lambda html, url: tx.strip_placeholder_marks(html)),
        "assignment_map": _assignment_map,
        "assignment_value": _assignments,
        "placeholder_collapse": _lines(lambda d: program_map.cleaned(d).withColumn("line", variables.collapse_placeholders(F.col("line")))),
        "placeholder_substitute": _by_length(_filled),
        "join_continuations": _by_length(_joined),
        "save_dir_fill": _by_length(lambda lines, levels: _pos(program_map.assembled(lines, levels))),
        "line_number": _by_length(_numbered),
        "df_variable": _by_length(_df_variables),
        "stmt_type": _by_length(_kinds),
        "table_refs": _by_length(_found),
        "block_owner": _by_length(_owners),
        "temp_view_use": _by_length(_view_uses),
        "table_name_norm": _by_length(_normal_names),
        "schema_filter": _by_length(_schema_test),
        "carried_refs": _by_length(_carried),
        "in_line_flag": _by_length(_flags),
        "bad_script_cutoff": _cutoff,
        "bad_scripts": _bad_scripts,
        "program_table_map": _map,
        "first_balanced_span": _pages(struct=lambda html, url: spans.first_balanced_span(html)),
        "first_call_body": _page_calls,
        "widest_call_body": _pages(struct=lambda html, url: spans.widest_call_body(html)),
        "paren_groups": _pages(struct=lambda html, url: spans.paren_groups(html)),
        "df_sql_pairs": _lines(pairs.df_sql_pairs),
        "from_tables": lambda spark, sf_dir: _cleaned_statements(spark, sf_dir).select(
            "script_id", "stmt_no", F.posexplode(refs.from_tables(F.col("sql"))).alias("ref_no", "table_name")
        ).withColumn("ref_no", F.col("ref_no").cast("bigint")),
        "insert_target": _insert_targets,
        "statement_table_refs": _reference_rows("role", "table_schema", "table_name", "alias", "is_function"),
        "reference_label": _reference_rows("label"),
        "statement_tables_distinct": lambda spark, sf_dir: statement_tables.table_rows(
            corpus.corpus_statements(spark, sf_dir)).drop("schema_known"),
        "schema_membership_split": lambda spark, sf_dir: statement_tables.table_rows(corpus.corpus_statements(spark, sf_dir)),
    }


def oracle_sql() -> dict[str, str]:
    from oracles import all_sql

    own = {} if training is None else training.oracle_sql()
    if corpus_pipeline is not None and corpus_pipeline.ORACLE_SQL is not None:
        own["pipeline"] = corpus_pipeline.ORACLE_SQL
    return all_sql() | own
