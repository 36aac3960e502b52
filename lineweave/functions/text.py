"""Text expressions: comments, boilerplate, padding. Every function is Column -> Column.

The character classes are spelled out because `\\w`, `\\s` and `.` mean different things in the
regex dialects at hand; scripts hold Hangul names, so the Unicode meaning is the wanted one.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave import fixed_values as fv

# All characters that count as blank, as a trim set and as a regex class body.
BLANKS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
BLANK = r"\t-\r\x1c-\x20\x85\p{Z}"
WORD = r"[\p{L}\p{N}_]"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Set a column through a generator. A projected expression is substituted into the filters that
    read it and computed again for each mention; a generator's output is not."""
    return df.select(*[c for c in df.columns if c != name], F.explode_outer(F.array(value)).alias(name))


def drop_text(c: Column, *texts: str) -> Column:
    """Remove every occurrence of each text."""
    return reduce(lambda acc, t: F.replace(acc, F.lit(t), F.lit("")), texts, c)


def holds_any(c: Column, tokens: list[str]) -> Column:
    """True when one of the tokens occurs; for a column that is at hand, as each token reads it."""
    return reduce(lambda a, b: a | b, [c.contains(t) for t in tokens], F.lit(False))


def matches_any(c: Column, tokens: list[str]) -> Column:
    """The same as one pattern, for an expression that should be computed once."""
    return c.rlike("|".join(map(re.escape, tokens))) if tokens else F.lit(False)


def starts_with_any(c: Column, tokens: list[str]) -> Column:
    """True when the text, after leading blanks, starts with one of the tokens."""
    return c.rlike(rf"^[{BLANK}]*(?:{'|'.join(map(re.escape, tokens))})")


def before(c: Column, mark: str) -> Column:
    """Text before the first mark; all of it when the mark is absent."""
    return F.substring_index(c, mark, 1)


def lines_of(text: Column) -> Column:
    """Array of lines; CRLF, CR and LF all end a line (S3)."""
    return F.split(text, r"\r\n|\r|\n", -1)


def all_lines_of(text: Column) -> Column:
    """Array of lines as C3 cuts them: the separators of Unicode and of ASCII end a line too, and the last line end starts none."""
    lines = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


# --- C1 -----------------------------------------------------------------------------------------

def is_comment_line(line: Column) -> Column:
    return starts_with_any(line, ["#", "--"])


def cut_hash_and_dashes(line: Column) -> Column:
    """Cut `#` on spark.sql lines, then `--`."""
    line = F.when(line.contains("#") & starts_with_any(line, ["spark.sql"]), before(line, "#")).otherwise(line)
    return before(line, "--")


def cut_block_comments(line: Column) -> Column:
    """Cut every `/*…*/` that closes within the line."""
    return F.when(line.contains("/*"), F.regexp_replace(line, r"(?s)/\*.*?\*/", "")).otherwise(line)


# --- C2, C4: whole texts ------------------------------------------------------------------------

def strip_comments_text(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?s)/\*.*?\*/", " ")
    text = F.regexp_replace(text, r"--[^\n]*", " ")
    return strip(F.regexp_replace(text, r"#[^\n]*", " "))


def strip_comments_stmt(text: Column) -> Column:
    text = F.when(
        starts_with_any(text, ["#", "//"]), F.regexp_replace(text, r"(?<=^|\n)#[^\n]*", "")
    ).otherwise(text)
    text = F.when(
        starts_with_any(text, ["spark.sql"]), F.regexp_replace(text, r"#[^\n]*", "")
    ).otherwise(text)
    text = F.regexp_replace(text, r"--[^\n]*", "")
    return F.regexp_replace(text, r"(?s)/\*.*?\*/", "")


# --- C3 -----------------------------------------------------------------------------------------

def is_hash_slash_line(line: Column) -> Column:
    return starts_with_any(line, ["#", "//"])


def cut_first_block_comment(line: Column) -> Column:
    """Remove from the first `/*` to the first `*/`, wherever they stand."""
    start, stop = F.instr(line, "/*"), F.instr(line, "*/")
    cut = F.concat(F.substring(line, F.lit(1), start - 1), F.substring(line, stop + 2, F.length(line)))
    return F.when((start > 0) & (stop > 0), cut).otherwise(line)


# --- C5-C10 -------------------------------------------------------------------------------------

def is_boilerplate(line: Column, tokens: list[str] = fv.BOILERPLATE_TOKENS) -> Column:
    return holds_any(line, tokens)


def is_job_control(line: Column) -> Column:
    """Job control, or blank."""
    tokens = "|".join(map(re.escape, fv.JOB_CONTROL_TOKENS))
    return F.upper(line).rlike(rf"{tokens}|^[{BLANK}]*$")


def normalize_line(line: Column) -> Column:
    line = drop_text(line, *fv.CONFIG_PREFIXES)
    return rstrip(F.replace(line, F.lit("\t"), F.lit("    ")))


def pad_parentheses(text: Column) -> Column:
    text = F.replace(text, F.lit("("), F.lit(" ( "))
    return strip(F.replace(text, F.lit(")"), F.lit(" ) ")))


ONE_LINE_CALL = r"spark\.sql\([^\n]*?\)"


def pad_call(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?s)^(.*?)({ONE_LINE_CALL})", "$1 $2 ")


def wrap_sql_call(text: Column) -> Column:
    """Blanks around the first `spark.sql(…)` that closes on its own line."""
    return strip(pad_call(text))


def strip_placeholder_marks(text: Column) -> Column:
    return drop_text(text, "${", "}")
