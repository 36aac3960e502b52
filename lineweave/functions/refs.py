"""Table references of one cleaned SQL statement (Q6-Q11). Row-local, no shuffle.

One pattern marks what matters in a statement: role words and commas with the name behind them, parentheses, words that end a
table list. A fold over the marks keeps a stack of open parentheses: a sub-select, a group of joins, or anything else,
in which role words and commas mean nothing. Nesting has no bound.

Not covered: quoted names that hold blanks next to a dot.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineweave import fixed_values as fv
from lineweave.functions.text import BLANK, WORD, drop_text, strip, strip_comments_stmt, strip_placeholder_marks

_B = f"[{BLANK}]"
_FROM = rf"(?<!{WORD})(?i:FROM){_B}+([\p{{L}}\p{{N}}_.]+)"
_INSERT = rf"(?:OVERWRITE|INTO){_B}+TABLE{_B}+({WORD}+\.{WORD}+)"

# words that end a table list, so neither a table name nor an alias
_STOP_WORDS = (
    "AND|AS|COPY|CROSS|CLUSTER|DISTRIBUTE|EXCEPT|FROM|FULL|GROUP|HAVING|IF|INNER|INSERT|INTERSECT|INTO|JOIN|LATERAL|LEFT|"
    "LIMIT|LOCATION|MINUS|NATURAL|ON|OR|ORDER|OUTER|OVERWRITE|PARTITION|RIGHT|SELECT|SEMI|ANTI|SET|SORT|STORED|"
    "PIVOT|TABLE|TABLESAMPLE|UNION|UNPIVOT|UPDATE|USING|VALUES|WHEN|WHERE|WINDOW|WITH"
)


def _any_of(words: list[str]) -> str:
    """Pattern of the words in any case, grouped by their first letters: a word is refused after one comparison for each of these."""
    first = sorted({w[0] for w in words})
    return "(?i:" + "|".join(f"{c}(?:{'|'.join(w[1:] for w in words if w[0] == c)})" for c in first) + ")"


_END = rf"(?!{WORD})"
# stop words that need no mark: a table list has ended before them, or a JOIN follows
_SILENT = "AND|ANTI|AS|CROSS|FULL|INNER|LEFT|NATURAL|OR|OUTER|RIGHT|SEMI|PIVOT|TABLESAMPLE|UNPIVOT".split("|")
_STOP = _any_of(_STOP_WORDS.split("|")) + _END
_WORD_OR_QUOTED = rf'(?:"[^"]*"|(?!{_STOP}){WORD}+)'
_NAME = rf"({_WORD_OR_QUOTED})(?:\.({_WORD_OR_QUOTED}))?(?:\.{_WORD_OR_QUOTED})*"
_ALIAS = rf"(?:{_B}+(?i:AS))?{_B}+({_WORD_OR_QUOTED})"
_ROLES = ["COPY", "FROM", "INTO", "UPDATE", "TABLE", "JOIN", "USING"]
# a name; what it opens, arguments or a sample; or else its alias
_ITEM = rf"{_NAME}(?:({_B}*\(|{_B}+(?i:TABLESAMPLE|PIVOT|UNPIVOT)(?!{WORD})[^()]*\()|{_ALIAS})?"

# --- the marks of a statement

_BREAK, _FIELD = "\x01", "\x02"
_MARKS = (
    # words, tried at their first letter only
    rf"(?=[A-Za-z])(?<![A-Za-z0-9_])(?<!{WORD})(?:(?i:IS{_B}+(?:NOT{_B}+)?DISTINCT{_B}+FROM){_END}"
    rf"|({_any_of(_ROLES)}){_END}(?:{_B}+(?:(?i:ONLY){_B}+)?{_ITEM})?"
    rf"|({_any_of([w for w in _STOP_WORDS.split('|') if w not in _SILENT])}){_END})"
    # signs
    rf"|(?=[(),'\"])(?:(\({_B}*(?i:SELECT|WITH|VALUES){_END})"
    rf"|([,(])(?:{_B}*{_ITEM})?"
    rf"|(\))(?:{_ALIAS})?"
    r"|('(?:[^']|'')*')"
    r'|("[^"]*"))'
)
# the mark, the first two parts of its name, what that opens, its alias; alternatives that did not match give no text
_AS_FIELDS = f"{_BREAK}$1$6$7$8$13$15$16{_FIELD}$2$9{_FIELD}$3$10{_FIELD}$4$11{_FIELD}$5$12$14{_FIELD}"


# what a mark is
_ROLE, _COMMA, _OPEN, _SUBSELECT, _CLOSE, _LATERAL, _OTHER = range(7)


def _marks(sql: Column) -> Column:
    """array of (kind, word, first, second, arguments, opens, alias): every mark with its parts as written."""
    marked = F.regexp_replace(F.translate(sql, _BREAK + _FIELD, "  "), _MARKS, _AS_FIELDS)
    parts = F.split(marked, _BREAK, -1)
    parts = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda m: F.split(m, _FIELD, -1))
    merges = sql.rlike(rf"^{_B}*(?i:MERGE|DELETE){_END}")

    def kind(word: Column) -> Column:
        return (F.when(word == ",", _COMMA).when(word == "(", _OPEN).when(word == ")", _CLOSE).when(word.isin(_ROLES[:-1]), _ROLE)
                .when(word == "LATERAL", _LATERAL).when(word.startswith("("), _SUBSELECT)
                .when(word == "USING", F.when(merges, _ROLE).otherwise(_OTHER)).otherwise(_OTHER))

    # in two steps: what a lambda uses several times is bound once
    parts = F.transform(parts, lambda m: F.struct(F.upper(m[0]).alias("word"), m[1].alias("first"), m[2].alias("second"), m[3].alias("opened"), m[4].alias("alias")))
    return F.transform(parts, lambda m: F.struct(
        kind(m["word"]).alias("kind"), m["word"].alias("word"), m["first"].alias("first"), m["second"].alias("second"),
        (F.ltrim(m["opened"]) == "(").alias("arguments"), (m["opened"] != "").alias("opens"), m["alias"].alias("alias")))


# --- the fold: a frame is its mode and, in steps of 16, the list it is in or the reference it belongs to

_OUTSIDE, _ARGUMENTS, _WANTS_NAME, _IN_LIST = range(4)
_STEP = 16
_STATE = "struct<stack:array<int>,roles:array<string>,commas:array<int>,refs:array<struct<list:int,first:string,second:string,arguments:boolean,alias:string>>>"


def _folded(sql: Column) -> Column:
    """The state after the last mark: the role of every table list, the lists that have a comma, the references."""
    def step(acc: Column, mark: Column) -> Column:
        kind, alias = mark["kind"], mark["alias"]
        top = F.element_at(acc["stack"], -1)
        mode, own = top.bitwiseAND(_STEP - 1), F.shiftright(top, 4)
        known, named = F.size(acc["refs"]), mark["first"] != ""
        starts = (kind == _ROLE) & (mode != _ARGUMENTS)
        goes_on = (kind == _COMMA) & (mode == _IN_LIST)
        nested = (kind == _OPEN) & (mode == _WANTS_NAME)
        takes = named & (starts | goes_on | nested)
        lst = F.when(kind == _ROLE, F.size(acc["roles"])).otherwise(own)
        in_list = lambda n: n * _STEP + F.when(named, _IN_LIST).otherwise(_WANTS_NAME)

        def with_top(new: Column) -> Column:
            return F.concat(F.slice(acc["stack"], F.lit(1), F.size(acc["stack"]) - 1), F.array(new))

        stack = (F.when(kind == _CLOSE, F.when(F.size(acc["stack"]) > 1, F.slice(acc["stack"], F.lit(1), F.size(acc["stack"]) - 1)).otherwise(acc["stack"]))
                 .when(starts | goes_on, with_top(in_list(lst)))
                 .when(nested, F.concat(with_top(own * _STEP + _IN_LIST), F.array(in_list(own))))
                 .when(kind == _OPEN, F.concat(acc["stack"], F.array(F.lit(_ARGUMENTS))))
                 .when(kind == _SUBSELECT, F.concat(F.when(mode == _WANTS_NAME, with_top(own * _STEP + _IN_LIST)).otherwise(acc["stack"]),
                                                    F.array(F.lit(_OUTSIDE))))
                 .when((mode == _WANTS_NAME) & (kind != _LATERAL) | (mode == _IN_LIST) & mark["word"].rlike("^[A-Z]"), with_top(F.lit(_OUTSIDE)))
                 .otherwise(acc["stack"]))
        # the alias of a name with arguments stands behind them
        stack = F.when(mark["opens"], F.concat(stack, F.array(F.when(takes, (known + 1) * _STEP + _ARGUMENTS).otherwise(_ARGUMENTS)))).otherwise(stack)

        ref = lambda lst, of, alias: F.struct(
            lst.alias("list"), of["first"].alias("first"), of["second"].alias("second"), of["arguments"].alias("arguments"), alias.alias("alias"))
        old = F.get(acc["refs"], own - 1)
        renamed = F.concat(F.slice(acc["refs"], F.lit(1), own - 1), F.array(ref(old["list"], old, alias)), F.slice(acc["refs"], own + 1, known))
        refs = (F.when(takes, F.concat(acc["refs"], F.array(ref(lst, mark, alias))))
                .when((kind == _CLOSE) & (mode == _ARGUMENTS) & (own > 0) & (alias != ""), renamed).otherwise(acc["refs"]))
        return F.struct(
            stack.alias("stack"), F.when(starts, F.concat(acc["roles"], F.array(mark["word"]))).otherwise(acc["roles"]).alias("roles"),
            F.when(goes_on, F.concat(acc["commas"], F.array(own))).otherwise(acc["commas"]).alias("commas"), refs.alias("refs"))

    nothing = F.struct(F.array(F.lit(_OUTSIDE)).alias("stack"), F.array().alias("roles"), F.array().alias("commas"), F.array().alias("refs"))
    return F.aggregate(_marks(sql), nothing.cast(_STATE), step)


def clean_statement(sql: Column) -> Column:
    return strip_placeholder_marks(strip_comments_stmt(sql))


def from_tables(sql: Column) -> Column:
    """Names after FROM, as written (Q6)."""
    return F.regexp_extract_all(sql, F.lit(_FROM), F.lit(1))


def insert_target(sql: Column) -> Column:
    """`a.b` of the first OVERWRITE TABLE or INTO TABLE; empty text when there is none (Q7)."""
    return F.regexp_extract(sql, _INSERT, 1)


def _is_lower(name: Column) -> Column:
    return (F.lower(name) == name) & (F.upper(name) != name)


def _reference_parts(state: Column) -> Column:
    """The references with their written parts; further dotted parts of a name do not count."""
    return F.transform(state.refs, lambda r: F.struct(
        F.get(state.roles, r["list"]).alias("role"), F.array_contains(state.commas, r["list"]).alias("listed"),
        r["first"].alias("first"), r["second"].alias("second"), r["arguments"].alias("arguments"), r["alias"].alias("alias")))


def _references(parts: Column, is_insert: Column) -> Column:
    """Names in a list stay as written; a name that stands alone is lower-cased unless quoted, and
    then keeps its written form as alias. In steps: what a lambda uses several times is bound once."""
    def named(p: Column) -> Column:
        dotted = p["second"] != ""
        text = F.concat(p["first"], p["second"], p["alias"])
        return F.struct(
            p["role"].alias("role"), p["listed"].alias("listed"), p["arguments"].alias("arguments"),
            F.when(dotted, drop_text(p["first"], '"')).alias("schema"), drop_text(F.when(dotted, p["second"]).otherwise(p["first"]), '"').alias("name"),
            F.when(p["alias"] != "", drop_text(p["alias"], '"')).alias("alias"), p["alias"].endswith('"').alias("alias_quoted"),
            (dotted & p["first"].startswith('"')).alias("schema_quoted"), (F.length(text) - F.length(drop_text(text, '"'))).alias("quotes"))

    def judged(p: Column) -> Column:
        name_quoted = (p["quotes"] > 2) | ((p["quotes"] > 0) & ~p["schema_quoted"])
        return F.struct(p.alias("p"), name_quoted.alias("quoted"), _is_lower(p["name"]).alias("lower"))

    def reference(x: Column) -> Column:
        p = x["p"]
        needs_quotes = p["alias_quoted"] | (x["quoted"] & p["alias"].isNull() & x["lower"])
        lone = F.when(needs_quotes, F.concat(F.lit('"'), F.coalesce(p["alias"], p["name"]), F.lit('"'))).otherwise(p["alias"])
        lowered = ~x["quoted"] & ~x["lower"]
        return F.struct(
            p["role"].alias("role"),
            F.when(p["listed"] | p["schema_quoted"], p["schema"]).otherwise(F.lower(p["schema"])).alias("table_schema"),
            F.when(~p["listed"] & lowered, F.lower(p["name"])).otherwise(p["name"]).alias("table_name"),
            F.when(p["listed"], p["alias"]).when(lowered, F.coalesce(lone, p["name"])).otherwise(lone).alias("alias"),
            (p["arguments"] & ~is_insert).alias("is_function"))

    return F.transform(F.transform(F.transform(parts, named), judged), reference)


def statement_table_refs(sql: Column) -> Column:
    """array of (role, table_schema, table_name, alias, is_function), in order of appearance (Q8).

    The column list of an INSERT is neither a function call nor a source of names. USING names a table in
    MERGE and DELETE only.
    """
    is_insert = F.upper(strip(sql)).startswith("INSERT")
    # bound to a variable, as each mention of the fold would run it again
    parts = F.transform(F.array(_folded(sql)), _reference_parts)
    return _references(F.flatten(parts), is_insert)


def reference_label(name: Column, alias: Column) -> Column:
    """How a reference is called in its statement (Q9)."""
    as_is = _is_lower(name) | name.startswith('"')
    return F.coalesce(alias, F.when(as_is, name).otherwise(F.concat(F.lit('"'), name, F.lit('"'))))


def statement_tables(sql: Column, references: Column) -> Column:
    """Distinct upper-case names of both searches; a missing schema reads NONE (Q10)."""
    named = F.transform(references, lambda r: F.concat(
        F.coalesce(r.table_schema, F.lit("None")), F.lit("."), r.table_name))
    return F.array_distinct(F.transform(F.concat(from_tables(sql), named), lambda n: F.upper(n)))


def in_schemas(table: Column, schemas: list[str] = fv.STATEMENT_SCHEMAS) -> Column:
    """Is the schema of a `schema.name` in the list (Q11)?"""
    return F.substring_index(table, ".", 1).isin(schemas)
