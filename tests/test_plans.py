"""Shapes of the physical plans: what is shuffled, what is read, and that nothing leaves the JVM."""

import pytest

import __spark_entry__ as entry

NARROW = [
    "script_decode", "script_lines", "relative_path", "strip_comments_text", "strip_comments_hashslash",
    "pad_parentheses", "strip_placeholder_marks", "first_balanced_span", "first_call_body", "widest_call_body", "paren_groups",
]
# the keys that statements are derived from are dealt out; all that follows is narrow
STATEMENTS = ["from_tables", "insert_target", "statement_table_refs", "reference_label", "statement_tables_distinct", "schema_membership_split",
              "strip_comments_stmt"]
# numbering the derived lines takes three shuffles of keys; everything that follows takes one more
STATEFUL = ["placeholder_substitute", "join_continuations", "line_number", "block_owner", "temp_view_use", "carried_refs",
            "program_table_map"]


def plan(spark, tiny, name):
    return entry.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NARROW)
def test_narrow(spark, tiny, name):
    assert "Exchange" not in plan(spark, tiny, name)


@pytest.mark.parametrize("name", STATEMENTS)
def test_narrow_after_the_keys(spark, tiny, name):
    assert plan(spark, tiny, name).count("Exchange") == 1


@pytest.mark.parametrize("name", STATEFUL)
def test_one_shuffle_after_the_source(spark, tiny, name):
    text = plan(spark, tiny, name)
    source = plan(spark, tiny, "strip_line_comments")
    assert text.count("Exchange hashpartitioning") == source.count("Exchange hashpartitioning") + 1
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


@pytest.mark.parametrize("name", sorted(entry._reference_queries()))
def test_no_python_and_no_cross_join(spark, tiny, name):
    if name.startswith("mapping_") or name in ("df_sql_pairs", "script_scan", "script_lines_by_range"):
        return  # the first write what program_table_map gives; the others walk chunks and read files in Python workers
    text = plan(spark, tiny, name)
    for bad in ("Python", "Pandas", "CartesianProduct", "NestedLoopJoin"):
        assert bad not in text


def test_long_scripts_join_by_key_only(spark, tiny):
    from lineweave.plans import program_map as pm
    from lineweave.sources.corpus import corpus_lines

    rows = pm.program_table_map(corpus_lines(spark, tiny), "20240101", chunk_lines=16)
    text = rows._jdf.queryExecution().executedPlan().toString()
    for bad in ("Python", "CartesianProduct", "NestedLoopJoin"):
        assert bad not in text
