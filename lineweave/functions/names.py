"""Statement kinds and table names of a line (X1-X3, X6, X7, X9). Column -> Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineweave import fixed_values as fv
from lineweave.functions.text import BLANK, WORD, drop_text

_WORD_DOT = WORD[:-1] + ".]"
DF_VARIABLE = rf"df_[^{BLANK}.=]+"
DOTTED = rf"{WORD}+\}}?\.{WORD}+"
QUALIFIED = rf"\{{?{_WORD_DOT}+\}}?\.\{{?{WORD}+\}}?"
PATH_PART = rf"{WORD}+\}}/{WORD}+"
QUOTED_PATH = rf"/{WORD}+[^{BLANK}]+[\"|']"

DECLARES = "CREATEORREPLACETEMPVIEW"
PATH_TYPES = ["SAVE", "READ_PARQUET"]
PAREN_TYPES = ["TEMP_VIEW", "DF_UNION"]
UNFILTERED_TYPES = ["TEMP_VIEW", "SAVE", "DF_UNION", "WRITE_MODE", "READ_PARQUET"]


def df_variable(line: Column) -> Column:
    """First DataFrame variable; empty text when there is none."""
    return F.regexp_extract(line, DF_VARIABLE, 0)


def declares_view(line: Column) -> Column:
    return F.upper(line).contains(DECLARES)


def stmt_type(line: Column, upper: Column) -> Column:
    """Statement kind, null when the line is no statement (X2). The first rule that holds decides."""
    u = upper
    return (
        F.when(u.contains(".WRITE.MODE("), "WRITE_MODE")
        .when(u.contains(".UNION("), "DF_UNION")
        .when(u.contains(DECLARES), "TEMP_VIEW")
        .when(line.contains("read.parquet"), "READ_PARQUET")
        .when(u.contains("LOCATION ") & ~u.contains("_LOCATION"), "LOCATION")
        .when(u.contains("SAVE_DIR") | u.contains(".SAVE"), "SAVE")
        .when(u.contains("JOIN "), "JOIN")
        .when(u.contains("FROM "), "FROM")
        .when(u.contains("INSERT "), "INSERT")
        .when(u.contains("INSERTINTO"), "INSERTINTO")
        .when(u.contains("ALTER "), "ALTER")
        .when(u.contains("DROP "), "DROP")
        .when(u.contains("CREATE ") & u.contains("TABLE "), "CREATE")
        .when(u.contains("CREATE OR REPLACE") & u.contains("VIEW"), "VIEW")
        .when(line.rlike(DOTTED), "ETC")
    )


def table_refs(line: Column, kind: Column) -> Column:
    """All table-like names of a line, as written; the pattern depends on the kind."""
    def every(text: Column, pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    return (
        F.when(kind == "WRITE_MODE", every(line, QUOTED_PATH))
        .when(kind.isin(PATH_TYPES), every(line, PATH_PART))
        .when(kind == "ETC", every(line, DOTTED))
        .when(kind.isNotNull(), every(drop_text(line, "spark.sql"), QUALIFIED))
    )


def bare(name: Column) -> Column:
    """Upper case without quotes, braces and parentheses."""
    return F.upper(F.translate(name, "'\"{}()", ""))


def in_parentheses(line: Column) -> Column:
    """Text between the first and the second `(`."""
    return F.split_part(line, F.lit("("), F.lit(2))


def view_name(line: Column) -> Column:
    """Name of the temp view a line declares, null for other lines."""
    return F.when(declares_view(line), bare(in_parentheses(line)))


def _two_parts(name: Column) -> Column:
    """Of a bare name, `SCHEMA.TABLE`, the schema cut at its first underscore."""
    whole = re.escape(fv.WHOLE_SCHEMA)
    name = F.regexp_replace(name, rf"(?s)^(?![^.]*{whole})([^._]*)[^.]*\.([^.]*).*$", "$1.$2")
    return F.regexp_replace(name, rf"(?s)^[^.]*{whole}[^.]*\.([^.]*).*$", f"{fv.WHOLE_SCHEMA}.$1")


def normal_names(names: Column) -> Column:
    """Every name in upper case, as `SCHEMA.TABLE` when it has a dot."""
    return F.transform(F.transform(names, bare), _two_parts)


def chosen_names(line: Column, found: Column, kind: Column) -> Column:
    """The names a statement of this kind stands for, normalized."""
    first = F.get(found, F.lit(0))
    path = F.concat(F.split_part(first, F.lit("/"), F.lit(2)), F.lit("."), F.split_part(first, F.lit("/"), F.lit(3)))
    picked = (
        F.when(kind.isin(PAREN_TYPES), F.array(in_parentheses(line)))
        .when(kind.isin(PATH_TYPES), F.array(F.replace(first, F.lit("/"), F.lit("."))))
        .when(kind == "WRITE_MODE", F.array(path))
        .otherwise(found)
    )
    return normal_names(picked)


def lacks_name(line: Column, found: Column, kind: Column) -> Column:
    """True when a statement misses the part its name is taken from."""
    first = F.get(found, F.lit(0))
    return (
        (kind.isin(PATH_TYPES) & (F.size(found) == 0))
        | ((kind == "WRITE_MODE") & ((F.size(found) == 0) | (F.size(F.split(first, "/", -1)) < 3)))
        | (declares_view(line) & ~line.contains("("))
    )


def known_table(name: Column, schemas: list[str] = fv.KNOWN_SCHEMAS,
                rejected: list[str] = fv.REJECTED_SCHEMA_PREFIXES) -> Column:
    """The part of the schema test that depends on the normal name alone (X7), as one pattern."""
    whole = fv.WHOLE_SCHEMA
    whole_known = any(whole.startswith(s) and whole.endswith(s) for s in schemas)
    return name.rlike(
        r"(?s)^(?=.{3})"                                       # more than two characters
        r"(?=[^.]*$|[^.]*\.[^.]{3})"                           # second part, if any, of three or more
        r"(?:DB_)?+"                                           # not part of the schema
        r"(?![^.]*[가-힣])"
        + "".join(rf"(?!{re.escape(p)})" for p in rejected)
        + rf"(?:(?=[^.]*{whole}){'' if whole_known else '(?!)'}"
        + rf"|(?![^.]*{whole})(?:{_starts_and_ends(schemas)})(?=[_.]|$))")


def _starts_and_ends(schemas: list[str]) -> str:
    """Pattern of the texts that both start and end with one of the schemas, up to a `_` or `.`; a
    schema that holds a `_` is no such text."""
    ways = ["(?!)"]
    for s in schemas:
        if "_" in s:
            continue
        ways.append(rf"{re.escape(s)}(?:[^_.]*{re.escape(s)})?")
        # start and end may share characters
        ways += [re.escape(s + s[n:]) for n in range(1, len(s)) if s.endswith(s[:n])]
    return "|".join(ways)


def masked_by_line(name: Column, line: Column, upper: Column) -> Column:
    """The part of the schema test that depends on the line the name stands in."""
    return F.contains(line, F.concat(F.lit("("), name)) | F.contains(upper, F.concat(F.lit("CASE WHEN "), name))


def shown_name(name: Column, kind: Column) -> Column:
    """Temp-view statements show the name without its schema."""
    return F.when(kind.contains("TEMP_VIEW") & name.contains("."), F.split_part(name, F.lit("."), F.lit(2))).otherwise(name)


def in_line(name: Column, line: Column) -> Column:
    return F.contains(F.upper(drop_text(line, "}")), name)
