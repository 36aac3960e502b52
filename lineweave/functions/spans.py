"""Parenthesis spans and call bodies of one text value (Q1-Q4). Row-local folds, no shuffle.

Positions count characters from 0; -1 means absent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineweave.functions.text import BLANK, WORD, strip

_NAME_BEFORE_EQUALS = rf"({WORD}+)[{BLANK}]*="


def _pieces(text: Column) -> Column:
    """The text cut after every parenthesis: each piece but the last ends in one."""
    return F.split(text, "(?<=[()])", -1)


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def first_balanced_span(text: Column) -> Column:
    """struct(start, stop) of the first `( … )` that closes (Q1)."""
    zero = F.struct(_long(0).alias("depth"), _long(0).alias("at"), _long(-1).alias("start"), _long(-1).alias("stop"))

    def step(acc: Column, piece: Column) -> Column:
        here = acc.at + F.length(piece) - 1
        opens, closes = F.endswith(piece, F.lit("(")), F.endswith(piece, F.lit(")"))
        live = acc.stop < 0
        return F.struct(
            F.when(opens, acc.depth + 1).when(closes, acc.depth - 1).otherwise(acc.depth).alias("depth"),
            (here + 1).alias("at"),
            F.when(live & opens & (acc.depth == 0), here).otherwise(acc.start).alias("start"),
            F.when(live & closes & (acc.depth == 1), here).otherwise(acc.stop).alias("stop"))

    return F.aggregate(_pieces(text), zero, step, lambda acc: F.struct(acc.start.alias("start"), acc.stop.alias("stop")))


def first_call_body(text: Column, span: Column) -> Column:
    """struct(status, df_name, body): the text in the first balanced span and the name assigned
    ahead of it (Q2). `span` is the text's `first_balanced_span`, given as a column of its own."""
    found = (span.start >= 0) & (span.stop >= 0)
    ahead = F.substring(text, F.lit(1), span.start.cast("int"))
    name = F.when(found, F.regexp_extract(ahead, _NAME_BEFORE_EQUALS, 1))
    body = F.substring(text, (span.start + 2).cast("int"), (span.stop - span.start - 1).cast("int"))
    ok = found & (name != "")
    return F.struct(
        F.when(~found, "no_balanced_call").when(name == "", "no_name").otherwise("ok").alias("status"),
        F.when(ok, name).alias("df_name"), F.when(ok, strip(body)).alias("body"))


def widest_call_body(text: Column) -> Column:
    """struct(status, df_name, body): first `(` to last `)`; the name keeps its `=` (Q3)."""
    start = F.instr(text, "(")
    stop = F.when(text.contains(")"), F.length(text) - F.instr(F.reverse(text), ")") + 1).otherwise(0)
    found = (start > 0) & (stop > start)
    name = strip(F.regexp_extract(text, _NAME_BEFORE_EQUALS, 0))
    ok = found & (name != "")
    return F.struct(
        F.when(~found, "no_call").when(name == "", "no_name").otherwise("ok").alias("status"),
        F.when(ok, name).alias("df_name"),
        F.when(ok, strip(F.substring(text, start + 1, stop - start - 1))).alias("body"))


def paren_groups(text: Column) -> Column:
    """struct(n_groups, group_text): how many outermost groups close, and the one text that stands
    for each of them: the first `(` to the first `)` (Q4)."""
    zero = F.struct(_long(0).alias("depth"), _long(0).alias("n"))

    def step(acc: Column, piece: Column) -> Column:
        closes = F.endswith(piece, F.lit(")")) & (acc.depth > 0)
        return F.struct(
            F.when(F.endswith(piece, F.lit("(")), acc.depth + 1).when(closes, acc.depth - 1).otherwise(acc.depth).alias("depth"),
            F.when(closes & (acc.depth == 1), acc.n + 1).otherwise(acc.n).alias("n"))

    start, stop = F.instr(text, "("), F.instr(text, ")")
    shown = F.substring(text, start, F.greatest(stop - start + 1, F.lit(0)))
    return F.struct(F.aggregate(_pieces(text), zero, step, lambda acc: acc.n).alias("n_groups"), shown.alias("group_text"))
