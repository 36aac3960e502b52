"""Configuration variables: collecting assignments, filling placeholders (V1-V4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave import fixed_values as fv
from lineweave.functions.text import WORD, drop_text, matches_any, strip
from lineweave.operators.lookup import names_within
from lineweave.operators.scan import CHUNK_KEYS

PLACEHOLDER = r"\{[^}]+\}"
_QUALIFIED_MARK = rf"\{{{WORD[:-1]}.]+\}}\.\{{?{WORD}+\}}?"
# `{` to the next `}`, the content ending in `.word`; group 1 is the second dotted part
_DOTTED_MARK = rf"\{{(?=[^}}]+\.{WORD}+\}})[^.}}]*\.([^.}}]*)(?:\.[^}}]*)?\}}"


# --- V1, V2 ---------------------------------------------------------------------------------------

def is_assignment(line: Column) -> Column:
    one_equals = F.length(line) - F.length(F.replace(line, F.lit("="), F.lit(""))) == 1
    return one_equals & ~line.contains("\\") & ~matches_any(F.upper(line), fv.NOT_ASSIGNMENT_TOKENS)


def assigned_name(line: Column) -> Column:
    return strip(F.replace(strip(F.substring_index(line, "=", 1)), F.lit("{"), F.lit("")))


def assigned_text(line: Column) -> Column:
    return strip(drop_text(F.substring_index(line, "=", -1), 'f"', "f'", '"', "'"))


def plain_value(text: Column) -> Column:
    """The second dotted part, or a path without its configuration prefix; no braces."""
    value = (F.when(text.contains("/"), F.when(text.contains("."), drop_text(text, *fv.VALUE_PREFIXES)).otherwise(text))
             .when(text.contains("."), F.split_part(text, F.lit("."), F.lit(2))).otherwise(text))
    return F.translate(value, "{}", "")


def schema_value(name: Column, value: Column) -> Column:
    """Values of names with `DB` are schemas and end at their first underscore."""
    cut = F.when(value.contains("IP_"), fv.WHOLE_SCHEMA).otherwise(F.substring_index(value, "_", 1))
    return F.when(name.contains("DB") & value.contains("_"), cut).otherwise(value)


def with_assignment(lines: DataFrame) -> DataFrame:
    """Add `var_name` and `var_value`, null on lines that assign nothing (V1, V2). Narrow.

    One column per step: each step is used more than once by the next and should be computed once.
    """
    line = F.col("line")
    return (lines.withColumn("assigns", is_assignment(line))
            .withColumns({"var_name": F.when(F.col("assigns"), assigned_name(line)),
                          "var_text": F.when(F.col("assigns"), assigned_text(line))})
            .withColumn("var_plain", plain_value(F.col("var_text")))
            .withColumn("var_value", schema_value(F.col("var_name"), F.col("var_plain")))
            .drop("assigns", "var_text", "var_plain"))


def assignments(lines: DataFrame) -> DataFrame:
    """(script_id, pos, var_name, var_value), one row per assignment. Narrow."""
    return (with_assignment(lines.where(is_assignment(F.col("line"))))
            .select("script_id", "pos", "var_name", "var_value"))


def assignment_map(lines: DataFrame) -> DataFrame:
    """(script_id, var_name, var_value, first_pos): the last value, at the first position."""
    return assignments(lines).groupBy("script_id", "var_name").agg(
        F.max_by("var_value", "pos").alias("var_value"), F.min("pos").alias("first_pos"))


# --- V3, V4 ---------------------------------------------------------------------------------------

def collapse_placeholders(line: Column) -> Column:
    """`{Cfg.NAME}` becomes `{NAME}` on lines that hold a qualified table mark (V3)."""
    return F.when(
        line.contains("}.") & line.rlike(_QUALIFIED_MARK), F.regexp_replace(line, _DOTTED_MARK, "{$1}")
    ).otherwise(line)


def placeholders(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(PLACEHOLDER), F.lit(0))


def _filled(mark: Column, value: Column) -> Column:
    last = F.substring_index(mark, ".", -1)
    text = F.when(mark.contains("."), F.concat(value, F.lit("_"), last)).otherwise(value)
    return F.coalesce(F.concat(F.lit("{"), text, F.lit("}")), mark)


def _fill(line: Column, value_of: Callable[[Column], Column]) -> Column:
    marks = F.transform(placeholders(line), lambda m: _filled(m, value_of(m)))
    filled = F.array_join(
        F.zip_with(F.split(line, PLACEHOLDER, -1), marks, lambda text, m: F.concat(text, F.coalesce(m, F.lit("")))), "")
    return F.when(line.contains("{"), filled).otherwise(line)


def fill_placeholders(lines: DataFrame, levels: int) -> DataFrame:
    """Each `{…}` takes the value of the first variable whose name it holds (V3, V4)."""
    return _fill_long(lines) if levels else _fill_short(lines)


def _fill_short(lines: DataFrame) -> DataFrame:
    """The script's own assignments, at most as many as it has lines, are a column of each line."""
    whole = (Window.partitionBy("script_id").orderBy("pos")
             .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    pair = F.struct(F.col("var_name").alias("k"), F.col("var_value").alias("v"))

    def value_of(mark: Column) -> Column:
        # the variables that a mark holds are looked for once, not again for each variable
        held = F.array(F.filter("vars", lambda v: F.contains(mark, v.k)))
        last = F.transform(held, lambda vs: F.try_element_at(F.filter(vs, lambda v: v.k == F.get(vs, F.lit(0)).k), F.lit(-1)).v)
        return F.get(last, F.lit(0))

    lines = with_assignment(lines)
    return (lines.withColumn("vars", F.collect_list(F.when(F.col("var_name").isNotNull(), pair)).over(whole))
            .drop("var_name", "var_value")
            .withColumn("line", collapse_placeholders(F.col("line")))
            .withColumn("line", _fill(F.col("line"), value_of))
            .drop("vars"))


def _fill_long(lines: DataFrame) -> DataFrame:
    """Resolve the distinct placeholders of each chunk by looking for the names in them.

    The number of variables of a long script has no bound, so they are never gathered in one place.
    """
    names = assignment_map(lines)
    per_script = names.groupBy("script_id").agg(
        F.min(F.when(F.col("var_name") == "", F.col("first_pos"))).alias("empty_pos"),
        F.max(F.when(F.col("var_name") == "", F.col("var_value"))).alias("empty_value"))
    lines = lines.withColumn("line", collapse_placeholders(F.col("line")))
    used = (lines.select(*CHUNK_KEYS, F.explode_outer(F.array_distinct(placeholders(F.col("line")))).alias("mark"))
            .where(F.col("mark").isNotNull()).distinct())
    # by way of the chunks: a long script has few of them, but may have many placeholders
    chunks = used.select(*CHUNK_KEYS).distinct().join(per_script, "script_id")
    marks = used.join(chunks, CHUNK_KEYS).groupBy("script_id", "mark").agg(
        F.first("empty_pos").alias("empty_pos"), F.first("empty_value").alias("empty_value"))

    parts = names_within(marks.select("script_id", "mark", F.col("mark").alias("text")),
                         names.where("var_name <> ''").select("script_id", F.col("var_name").alias("name")), ["script_id", "mark"])
    hits = parts.withColumnRenamed("name", "var_name").join(names, ["script_id", "var_name"]).groupBy("script_id", "mark").agg(
        F.min(F.struct(F.col("first_pos").alias("at"), F.col("var_value").alias("value"))).alias("hit"))
    # the empty name is held by every placeholder
    empty = F.when(F.col("empty_pos").isNotNull(),
                   F.struct(F.col("empty_pos").alias("at"), F.col("empty_value").alias("value")))
    values = (marks.join(hits, ["script_id", "mark"], "left")
              .select("script_id", "mark", F.least(F.col("hit"), empty).value.alias("value"))
              .where(F.col("value").isNotNull()))
    per_chunk = (used.join(values, ["script_id", "mark"]).groupBy(*CHUNK_KEYS)
                 .agg(F.map_from_entries(F.collect_list(F.struct("mark", "value"))).alias("values")))
    return (lines.join(per_chunk, CHUNK_KEYS, "left")
            .withColumn("line", _fill(F.col("line"), lambda m: F.try_element_at(F.col("values"), m)))
            .drop("values"))
