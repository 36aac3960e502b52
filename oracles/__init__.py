"""DuckDB SQL for every registered query, written in another form than the Spark side: relational
joins and recursive line-by-line folds in place of windows and higher-order functions."""

from __future__ import annotations

from lineweave import fixed_values as fv
from lineweave.functions.text import BLANKS
from lineweave.sources.corpus import BLOCKS, HEADER, SHAPES

W = r"[\p{L}\p{N}_]"
WS = "||".join(f"chr({ord(c)})" for c in BLANKS)
B = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NB = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(map(q, items)) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def lstrip(x: str) -> str:
    return f"ltrim({x}, {WS})"


def drop(x: str, *texts: str) -> str:
    for t in texts:
        x = f"replace({x}, {q(t)}, '')"
    return x


def any_in(x: str, tokens) -> str:
    return f"len(list_filter({sql_list(tokens)}, lambda t: contains({x}, t))) > 0"


def block() -> str:
    cases = " ".join(f"WHEN {k} THEN {q(b)}" for k, b in enumerate(BLOCKS))
    x = f"CASE CASE WHEN o_orderkey % 97 = 5 THEN 10 ELSE o_orderkey % 10 END {cases} END"
    for mark, value in (("<a>", "(o_orderkey % 97)::VARCHAR"), ("<b>", "(o_orderkey % 89)::VARCHAR"),
                        ("<c>", "(o_custkey % 7)::VARCHAR"), ("<bs>", "chr(92)"), ("<sq>", "chr(39)")):
        x = f"replace({x}, '{mark}', {value})"
    return x


CORPUS = f"""
blocks AS (
  SELECT o_custkey AS script_id, o_orderkey AS blk, string_split({block()}, '~') AS rows FROM orders
  UNION ALL
  SELECT DISTINCT o_custkey, -1, string_split({q(HEADER)}, '~') FROM orders),
corpus AS (
  SELECT script_id, blk, p, line,
         row_number() OVER (PARTITION BY script_id ORDER BY blk, p) AS src_line_no
  FROM (SELECT script_id, blk, unnest(rows) AS line, generate_subscripts(rows, 1) - 1 AS p FROM blocks))"""

# the references of every shape: (shape, ref_no, role, schema, name, alias, is_function), with the marks of its text
SHAPE_REFS = [
    (0, 0, "FROM", "swg", "a<a>", "x", False), (1, 0, "FROM", "act", "t<a>", None, False), (2, 0, "FROM", "tmp", "t<a>", None, False),
    (3, 0, "FROM", "swg", "a<a>", None, False), (3, 1, "FROM", "TMP", "After<b>", None, False),
    (4, 0, "FROM", "swg", "t<a>", "x", False), (4, 1, "FROM", "tmp", "t<b>", None, False),
    (5, 0, "FROM", "swg", "f<a>", "f", True), (5, 1, "FROM", "tmp", "z<b>", None, False),
    (6, 0, "FROM", "swg", "a<a>", None, False), (6, 1, "JOIN", "tmp", "b<b>", None, False), (6, 2, "JOIN", "act", "c<a>", None, False),
    (6, 3, "JOIN", "stg", "d<b>", None, False),
    (7, 0, "INTO", "swg", "t<a>", "t", False), (7, 1, "USING", "tmp", "u<b>", "u", False),
    (8, 0, "FROM", "swg", "t<a>", None, False), (8, 1, "USING", "tmp", "u<b>", None, False),
    (9, 0, "FROM", "swg", "a<a>", None, False), (9, 1, "FROM", "tmp", "b<b>", None, False), (9, 2, "FROM", "stg", "c<a>", None, False),
    (9, 3, "FROM", None, "q", None, False), (9, 4, "FROM", "act", "e<b>", None, False), (9, 5, "FROM", "bcm", "f<a>", None, False),
    (10, 0, "FROM", "swg", "a<a>", None, False), (10, 1, "FROM", "tmp", "b<b>", None, False),
    (10, 2, "FROM", "act", "h<a>", None, False), (10, 3, "FROM", "stg", "i<b>", None, False),
]


def marked(x: str) -> str:
    return f"replace(replace({x}, '<a>', (o_orderkey % 97)::VARCHAR), '<b>', (o_orderkey % 89)::VARCHAR)"


_PLAIN = "o_orderkey % 10 = 9"
_SHAPE = f"(o_orderkey // 10) % {len(SHAPES)}"
STATEMENTS = f"""
shaped AS (
  SELECT o_custkey AS script_id, o_orderkey AS stmt_no, {marked(f"{sql_list(SHAPES)}[{_SHAPE} + 1]")} AS sql FROM orders WHERE {_PLAIN}),
shape_refs AS (
  SELECT o_custkey AS script_id, o_orderkey AS stmt_no, ref_no::BIGINT AS ref_no, role, table_schema, {marked("table_name")} AS table_name, alias, is_function
  FROM orders JOIN (VALUES {", ".join("(" + ", ".join("NULL" if v is None else q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in SHAPE_REFS)})
    r(shape, ref_no, role, table_schema, table_name, alias, is_function) ON {_PLAIN} AND shape = {_SHAPE}),
block_statements AS (
  SELECT o_custkey AS script_id, o_orderkey AS stmt_no,
         replace(array_to_string(rows[first + 1 : last - 1], chr(10)), '{{', '${{') AS sql
  FROM (SELECT *, list_position(list_transform(rows, lambda r: ends_with(r, '\"\"\"')), true) AS first,
               list_position(rows, '\"\"\")') AS last
        FROM (SELECT o_custkey, o_orderkey, string_split({block()}, '~') AS rows FROM orders))
  WHERE first IS NOT NULL),
statements AS (SELECT * FROM block_statements UNION ALL SELECT * FROM shaped)"""

# --- cleaning and variables -----------------------------------------------------------------------

C1 = f"""
c1 AS (
  SELECT script_id, src_line_no,
         regexp_replace(split_part(CASE WHEN starts_with({lstrip('line')}, 'spark.sql') THEN split_part(line, '#', 1)
                                        ELSE line END, '--', 1), '/\\*.*?\\*/', '', 'gs') AS line
  FROM lines WHERE NOT starts_with({lstrip('line')}, '#') AND NOT starts_with({lstrip('line')}, '--'))"""

C5 = f"""
c5 AS (SELECT * FROM c1 WHERE NOT ({any_in('line', fv.BOILERPLATE_TOKENS)}))"""

_RIGHT = strip(drop("split_part(line, '=', 2)", 'f"', "f'", '"', "'"))
V12 = f"""
assigns AS (
  SELECT script_id, src_line_no, {strip(drop(strip("split_part(line, '=', 1)"), '{'))} AS var_name, {_RIGHT} AS raw
  FROM c5
  WHERE length(line) - length(replace(line, '=', '')) = 1 AND NOT contains(line, chr(92))
    AND NOT ({any_in('upper(line)', fv.NOT_ASSIGNMENT_TOKENS)})),
valued AS (
  SELECT script_id, src_line_no, var_name,
         CASE WHEN NOT (contains(var_name, 'DB') AND contains(v, '_')) THEN v
              WHEN contains(v, 'IP_') THEN 'IP_PLF' ELSE split_part(v, '_', 1) END AS var_value
  FROM (SELECT *, {drop(f'''CASE WHEN NOT contains(raw, '.') THEN raw
                                 WHEN contains(raw, '/') THEN {drop('raw', *fv.VALUE_PREFIXES)}
                                 ELSE string_split(raw, '.')[2] END''', '{', '}')} AS v FROM assigns)),
vars AS (
  SELECT script_id, var_name, arg_max(var_value, src_line_no) AS var_value, min(src_line_no) AS first_pos
  FROM valued GROUP BY ALL)"""


def rebuild(source: str, pattern: str, marks: str, name: str) -> str:
    """Put the filled marks (script_id, src_line_no, i, filled) back between the text pieces."""
    return f"""
{name} AS (
  SELECT s.script_id, s.src_line_no,
         coalesce(array_to_string(list_transform(range(1, len(m.filled) + 1),
           lambda i: string_split_regex(s.line, {q(pattern)})[i] || m.filled[i]), '')
           || string_split_regex(s.line, {q(pattern)})[-1], s.line) AS line
  FROM {source} s LEFT JOIN (
    SELECT script_id, src_line_no, list(filled ORDER BY i) AS filled FROM {marks} GROUP BY ALL) m
  USING (script_id, src_line_no))"""


_P3 = rf"\{{[^}}]+\.{W}+\}}"
_P4 = r"\{[^}]+\}"
V3 = rf"""
marks3 AS (
  SELECT script_id, src_line_no, i, '{{' || replace(string_split(m, '.')[2], '}}', '') || '}}' AS filled
  FROM (SELECT script_id, src_line_no, unnest(regexp_extract_all(line, {q(_P3)})) AS m,
               generate_subscripts(regexp_extract_all(line, {q(_P3)}), 1) AS i
        FROM c5 WHERE regexp_matches(line, '\{{[\p{{L}}\p{{N}}_.]+\}}\.\{{?{W}+\}}?'))),
{rebuild('c5', _P3, 'marks3', 'v3').strip()}"""

V4 = rf"""
marks4 AS (
  SELECT script_id, src_line_no, i, coalesce('{{' || value || CASE WHEN contains(m, '.')
           THEN '_' || string_split(m, '.')[-1] ELSE '' END || '}}', m) AS filled
  FROM (SELECT k.script_id, src_line_no, i, m, arg_min(var_value, first_pos) AS value
        FROM (SELECT script_id, src_line_no, unnest(regexp_extract_all(line, {q(_P4)})) AS m,
                     generate_subscripts(regexp_extract_all(line, {q(_P4)}), 1) AS i FROM v3) k
        LEFT JOIN vars ON vars.script_id = k.script_id AND contains(m, var_name)
        GROUP BY ALL)),
{rebuild('v3', _P4, 'marks4', 'v4').strip()}"""

C7 = f"""
c7 AS (SELECT script_id, src_line_no, rtrim(replace({drop('line', *fv.CONFIG_PREFIXES)}, chr(9), '    '), {WS}) AS line FROM v4)"""
C6 = f"""
c6 AS (SELECT * FROM c7 WHERE NOT ({any_in('upper(line)', fv.JOB_CONTROL_TOKENS)}) AND {strip('line')} <> '')"""

# --- line assembly --------------------------------------------------------------------------------

L1 = f"""
l1 AS (
  SELECT script_id, max(src_line_no) AS pos,
         CASE WHEN coalesce(string_agg(piece, '' ORDER BY src_line_no), '') = '' THEN max(line) FILTER (NOT goes)
              ELSE string_agg(piece, '' ORDER BY src_line_no) || {strip("max(line) FILTER (NOT goes)")} END AS line
  FROM (SELECT *, ends_with(line, chr(92)) AS goes,
               CASE WHEN ends_with(line, chr(92)) THEN {strip('left(line, length(line) - 1)')}
                    || CASE WHEN contains(line, '=') THEN ' ' ELSE '' END END AS piece,
               sum(CASE WHEN ends_with(line, chr(92)) THEN 0 ELSE 1 END) OVER (
                 PARTITION BY script_id ORDER BY src_line_no DESC) AS gid
        FROM c6)
  GROUP BY script_id, gid HAVING bool_or(NOT goes))"""

L2 = f"""
l2 AS (
  SELECT script_id, pos, row_number() OVER (PARTITION BY script_id ORDER BY pos) AS line_no,
         CASE WHEN starts_with(line, 'df_') AND contains(line, '.write')
              THEN replace(line, 'save_dir', coalesce(dir, '')) ELSE line END AS line
  FROM (SELECT l.*, d.dir FROM l1 l ASOF LEFT JOIN (
          SELECT script_id, pos, 'save_dir-' || {strip("string_split(line, '=')[2]")} AS dir
          FROM l1 WHERE contains(line, 'save_dir') AND contains(line, '=')) d
        ON l.script_id = d.script_id AND l.pos >= d.pos)
  WHERE NOT (contains(line, 'save_dir') AND contains(line, '=')))"""

# --- lineage --------------------------------------------------------------------------------------

_OPENS = f"starts_with({lstrip('line')}, 'df_') AND ({any_in('line', fv.OPENING_TOKENS)})"
_VAR = f"regexp_extract(line, {q(r'df_[^\t-\r\x1c-\x20\x{85}\p{Z}.=]+')})"

OWNER = f"""
owners AS (
  SELECT script_id, 0::BIGINT AS line_no, 'None' AS owner, 'None' AS label, false AS owned, 0::BIGINT AS opened, false AS in_sql
  FROM (SELECT DISTINCT script_id FROM l2)
  UNION ALL
  SELECT script_id, line_no, label2,
         CASE WHEN tv AND owned2 AND NOT ends THEN 'None_' || opened2 ELSE label2 END, owned2 AND NOT ends, opened2, in_sql2 AND NOT ends
  FROM (SELECT *, CASE WHEN ends THEN '#' WHEN opens THEN var WHEN owned2 OR (in_sql2 AND contains(label, 'None')) THEN label
                       ELSE 'None_' || line_no END AS label2
        FROM (SELECT f.script_id, l.line_no, f.label, opens, var, tv, f.owned OR opens AS owned2,
                     CASE WHEN opens THEN l.line_no ELSE f.opened END AS opened2,
                     f.in_sql OR starts AS in_sql2, closes AND (f.in_sql OR starts) AS ends
              FROM owners f JOIN (
                SELECT script_id, line_no, {_OPENS} AS opens, {_VAR} AS var, contains(line, 'createOrReplaceTempView') AS tv,
                       contains(line, 'spark.sql(') AS starts, contains(line, '\"\"\")') AS closes FROM l2) l
              ON l.script_id = f.script_id AND l.line_no = f.line_no + 1)))"""

_KINDS = [
    ("contains(u, '.WRITE.MODE(')", "WRITE_MODE"), ("contains(u, '.UNION(')", "DF_UNION"),
    ("contains(u, 'CREATEORREPLACETEMPVIEW')", "TEMP_VIEW"), ("contains(line, 'read.parquet')", "READ_PARQUET"),
    ("contains(u, 'LOCATION ') AND NOT contains(u, '_LOCATION')", "LOCATION"),
    ("contains(u, 'SAVE_DIR') OR contains(u, '.SAVE')", "SAVE"), ("contains(u, 'JOIN ')", "JOIN"),
    ("contains(u, 'FROM ')", "FROM"), ("contains(u, 'INSERT ')", "INSERT"), ("contains(u, 'INSERTINTO')", "INSERTINTO"),
    ("contains(u, 'ALTER ')", "ALTER"), ("contains(u, 'DROP ')", "DROP"),
    ("contains(u, 'CREATE ') AND contains(u, 'TABLE ')", "CREATE"),
    ("contains(u, 'CREATE OR REPLACE') AND contains(u, 'VIEW')", "VIEW"),
    (f"regexp_matches(line, {q(rf'{W}+\}}?\.{W}+')})", "ETC"),
]


def bare(x: str) -> str:
    return f"upper({drop(x, chr(39), chr(34), '{', '}', '(', ')')})"


def normal(x: str) -> str:
    schema = f"split_part({bare(x)}, '.', 1)"
    return f"""CASE WHEN NOT contains({bare(x)}, '.') THEN {bare(x)} ELSE
      CASE WHEN contains({schema}, 'IP_PLF') THEN 'IP_PLF' ELSE split_part({schema}, '_', 1) END
      || '.' || split_part({bare(x)}, '.', 2) END"""


def known(x: str) -> str:
    schema = f"regexp_replace(split_part({x}, '.', 1), '^DB_', '')"
    cut = f"CASE WHEN contains({schema}, 'IP_PLF') THEN 'IP_PLF' ELSE split_part({schema}, '_', 1) END"
    rejected = " AND ".join(f"NOT starts_with({schema}, {q(p)})" for p in fv.REJECTED_SCHEMA_PREFIXES)
    return f"""(length({x}) > 2 AND NOT regexp_matches({schema}, '[가-힣]') AND {rejected}
      AND (NOT contains({x}, '.') OR length(split_part({x}, '.', 2)) >= 3)
      AND len(list_filter({sql_list(fv.KNOWN_SCHEMAS)}, lambda s: starts_with({cut}, s) AND ends_with({cut}, s))) > 0)"""


def masked(x: str, line: str) -> str:
    return f"(contains({line}, '(' || {x}) OR contains(upper({line}), 'CASE WHEN ' || {x}))"


_QUALIFIED = rf"\{{?[\p{{L}}\p{{N}}_.]+\}}?\.\{{?{W}+\}}?"
TYPED = f"""
typed AS (
  SELECT *, CASE WHEN own_kind = 'WRITE_MODE' THEN regexp_extract_all(line, {q(rf'/{W}+{NB}+["|' + chr(39) + ']')})
                 WHEN own_kind IN ('SAVE', 'READ_PARQUET') THEN regexp_extract_all(line, {q(rf'{W}+\}}/{W}+')})
                 WHEN own_kind = 'ETC' THEN regexp_extract_all(line, {q(rf'{W}+\}}?\.{W}+')})
                 ELSE regexp_extract_all(replace(line, 'spark.sql', ''), {q(_QUALIFIED)}) END AS found
  FROM (SELECT *, CASE {' '.join(f"WHEN {c} THEN '{k}'" for c, k in _KINDS)} END AS own_kind
        FROM (SELECT *, upper(line) AS u FROM l2))
  WHERE own_kind IS NOT NULL)"""

USES = f"""
views AS (
  SELECT script_id, line_no, {bare("split_part(line, '(', 2)")} AS view_name FROM typed
  WHERE contains(u, 'CREATEORREPLACETEMPVIEW')),
uses AS (
  SELECT t.script_id, t.line_no, view_name, count(*) AS copies
  FROM typed t JOIN views v ON v.script_id = t.script_id AND v.line_no <= t.line_no AND contains(t.u, view_name)
  WHERE own_kind <> 'TEMP_VIEW' GROUP BY ALL),
used AS (
  SELECT typed.*, coalesce(use_list, []::VARCHAR[]) AS use_list,
         CASE WHEN use_list IS NULL THEN own_kind ELSE 'TEMP_VIEW_USE' END AS kind
  FROM typed LEFT JOIN (
    SELECT script_id, line_no, flatten(list(list_transform(range(copies), lambda i: 'TEMPVIEW.' || view_name))) AS use_list
    FROM uses GROUP BY ALL) USING (script_id, line_no)),
stmts AS (
  SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY line_no) AS k,
         (kind IN ('SAVE', 'READ_PARQUET') AND len(found) = 0)
         OR (kind = 'WRITE_MODE' AND (len(found) = 0 OR len(string_split(found[1], '/')) < 3))
         OR (contains(u, 'CREATEORREPLACETEMPVIEW') AND NOT contains(line, '('))
         OR ({_OPENS} AND {_VAR} = '') AS bad
  FROM used),
good AS (
  SELECT * FROM stmts s WHERE NOT EXISTS (
    SELECT 1 FROM stmts b WHERE b.script_id = s.script_id AND b.bad AND b.line_no <= s.line_no))"""

_CHOSEN = """CASE WHEN kind IN ('TEMP_VIEW', 'DF_UNION') THEN [split_part(line, '(', 2)]
         WHEN kind IN ('SAVE', 'READ_PARQUET') THEN [replace({x}[1], '/', '.')]
         WHEN kind = 'WRITE_MODE' THEN [split_part({x}[1], '/', 2) || '.' || split_part({x}[1], '/', 3)]
         ELSE {x} END"""
_FREE = "kind IN ('TEMP_VIEW', 'SAVE', 'DF_UNION', 'WRITE_MODE', 'READ_PARQUET')"
CARRIED = f"""
carried AS (
  SELECT script_id, 0::BIGINT AS k, 0::BIGINT AS line_no, '' AS kind, '' AS line, []::VARCHAR[] AS names
  FROM (SELECT DISTINCT script_id FROM good)
  UNION ALL
  SELECT script_id, k, line_no, kind, line,
         CASE WHEN {_FREE} THEN named ELSE list_filter(named, lambda x: {known('x')} AND NOT {masked('x', 'line')}) END
  FROM (SELECT script_id, k, line_no, kind, line, list_transform({_CHOSEN.format(x='held')}, lambda x: {normal('x')}) AS named
        FROM (SELECT g.script_id, g.k, g.line_no, g.kind, g.line,
                     list_concat(CASE WHEN g.own_kind IN ('SAVE', 'READ_PARQUET', 'WRITE_MODE', 'ETC') OR len(g.found) > 0
                                      THEN g.found ELSE f.names END, g.use_list) AS held
              FROM carried f JOIN good g ON g.script_id = f.script_id AND g.k = f.k + 1))),
name_rows AS (
  SELECT script_id, line_no, kind, line, name, count(*) AS copies
  FROM (SELECT script_id, line_no, kind, line, unnest(names) AS name FROM carried) GROUP BY ALL),
shown AS (
  SELECT script_id, line_no, kind, line, table_name, contains(upper(replace(line, '}}', '')), table_name) AS in_line,
         sum(copies)::BIGINT AS copies
  FROM (SELECT *, CASE WHEN contains(kind, 'TEMP_VIEW') AND contains(name, '.') THEN split_part(name, '.', 2) ELSE name END AS table_name
        FROM name_rows) GROUP BY ALL)"""

LINES = "\nlines AS (SELECT script_id, src_line_no, line FROM corpus)"
SUBSTITUTED = [C1, C5, V12, V3, V4, C7, C6]
ASSEMBLED = [*SUBSTITUTED, L1, L2]
NAMED = [*ASSEMBLED, OWNER, TYPED, USES, CARRIED]


def over(ctes: list[str], select: str, lines: str = LINES) -> str:
    return "WITH RECURSIVE" + ",".join([CORPUS, lines, *ctes]) + "\n" + select


DATE = "20240101"
MAP = f"""SELECT '{{date}}' AS strd_dt, 'jobs/' || script_id % 100 AS script_path, 'job_' || script_id || '.py' AS script_name,
       s.line_no, o.owner AS df_var, kind AS stmt_type, table_name, in_line, line, copies
FROM shown s JOIN owners o USING (script_id, line_no)"""

# --- statements -----------------------------------------------------------------------------------

_STOP = ("AND AS COPY CROSS CLUSTER DISTRIBUTE EXCEPT FROM FULL GROUP HAVING IF INNER INSERT INTERSECT INTO JOIN LATERAL LEFT LIMIT "
         "LOCATION MINUS NATURAL ON OR ORDER OUTER OVERWRITE PARTITION RIGHT SELECT SEMI ANTI SET SORT STORED TABLE UNION UPDATE "
         "USING VALUES WHEN WHERE WINDOW WITH").split()
CLEAN_STMT = """
cleaned AS (
  SELECT script_id, stmt_no, replace(replace(array_to_string(list_transform(string_split(cut, chr(10)),
           lambda r: split_part(r, '--', 1)), chr(10)), '${', ''), '}', '') AS sql
  FROM (SELECT *, regexp_replace(sql, '/\\*.*?\\*/', '', 'gs') AS cut FROM statements))"""
_BLOCK = "stmt_no % 10 <> 9"
# tokens of a statement of a block; a name follows its role word, an alias follows the name
REFS = rf"""
tokens AS (
  SELECT script_id, stmt_no, t, i, lead(t) OVER w AS t1, lead(t, 2) OVER w AS t2
  FROM (SELECT script_id, stmt_no, unnest(l) AS t, generate_subscripts(l, 1) AS i
        FROM (SELECT *, regexp_extract_all(sql, '[\p{{L}}\p{{N}}_.]+|[^\p{{L}}\p{{N}}_.\s]') AS l FROM cleaned WHERE {_BLOCK}))
  WINDOW w AS (PARTITION BY script_id, stmt_no ORDER BY i)),
named_tokens AS (
  SELECT *, CASE WHEN contains(t1, '.') THEN split_part(t1, '.', 2) ELSE t1 END AS own FROM tokens),
refs AS (
  SELECT script_id, stmt_no, row_number() OVER (PARTITION BY script_id, stmt_no ORDER BY i) - 1 AS ref_no, upper(t) AS role,
         lower(CASE WHEN contains(t1, '.') THEN split_part(t1, '.', 1) END) AS table_schema,
         lower(own) AS table_name,
         CASE WHEN regexp_matches(t2, '^{W}+$') AND NOT list_contains({sql_list(_STOP)}, upper(t2)) THEN t2
              WHEN lower(own) <> own THEN own END AS alias,
         coalesce(t2 = '(', false) AS is_function
  FROM named_tokens
  WHERE upper(t) IN ('COPY', 'FROM', 'INTO', 'UPDATE', 'TABLE', 'JOIN') AND regexp_matches(t1, '^{W}')
    AND NOT list_contains({sql_list(_STOP)}, upper(t1))
  UNION ALL SELECT * FROM shape_refs)"""
FROMS = rf"""
froms AS (
  SELECT script_id, stmt_no, unnest(l) AS table_name, generate_subscripts(l, 1) - 1 AS ref_no
  FROM (SELECT *, regexp_extract_all(sql, '(?i:^|[^\p{{L}}\p{{N}}_])(?i:FROM){B}+([\p{{L}}\p{{N}}_.]+)', 1) AS l FROM cleaned))"""
TABLES = """
tables AS (
  SELECT script_id, stmt_no, upper(table_name) AS table_name FROM froms
  UNION
  SELECT script_id, stmt_no, upper(coalesce(table_schema, 'None') || '.' || table_name) FROM refs)"""


def stmt(ctes: list[str], select: str) -> str:
    return "WITH" + ",".join([STATEMENTS, CLEAN_STMT, *ctes]) + "\n" + select


# --- texts ----------------------------------------------------------------------------------------

SPAN = """
marks AS (
  SELECT page_id, html, i, c, sum(CASE c WHEN '(' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i) AS depth
  FROM (SELECT page_id, html, unnest(range(1, length(html) + 1)) AS i, unnest(string_split(html, '')) AS c FROM pages)
  WHERE c IN ('(', ')')),
stops AS (SELECT page_id, min(i) AS stop FROM marks WHERE c = ')' AND depth = 0 GROUP BY page_id),
spans AS (
  SELECT p.page_id, p.html, coalesce(s.stop, 0) - 1 AS stop,
         coalesce((SELECT max(i) FROM marks m WHERE m.page_id = p.page_id AND c = '(' AND depth = 1 AND (s.stop IS NULL OR i < s.stop)), 0) - 1 AS start
  FROM pages p LEFT JOIN stops s USING (page_id))"""

DOC_LINES = r"""
doc_lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no
  FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents))"""

FILE_NAMES = """
SELECT doc_id, [doc_id || '.sql', '_x' || doc_id || '.py', '.h/' || doc_id || '.sh', 'sub/_y/' || doc_id || '.sql', doc_id || '.SQL',
                'sub/.w' || doc_id || '.py'][doc_id % 6 + 1] AS name,
       CASE WHEN regexp_full_match(text, '[\\x{00}-\\x{ff}]*', 's') THEN length(text) ELSE strlen(text) END AS length
FROM documents"""

ALL_DOC_LINES = r"""
doc_lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no
  FROM (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l
        FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents)))"""

FILES = """
files AS (SELECT script_id, src_line_no, line, row_number() OVER (PARTITION BY script_id ORDER BY src_line_no) AS n FROM corpus)"""
PAIRS = f"""
walk AS (
  SELECT script_id, 0::BIGINT AS n, 'name' AS want, NULL::VARCHAR AS name, '' AS text, false AS done
  FROM (SELECT DISTINCT script_id FROM files)
  UNION ALL
  SELECT script_id, n,
         CASE WHEN want = 'name' THEN CASE WHEN starts_with({strip('line')}, 'df_') THEN 'call' ELSE 'name' END
              WHEN hit AND contains(line, ')') THEN 'name' WHEN hit THEN 'end' ELSE want END,
         CASE WHEN want = 'name' THEN {strip(f"split_part({strip('line')}, '=', 1)")} ELSE name END,
         CASE WHEN want = 'name' THEN ''
              WHEN want = 'call' AND hit THEN text || line[strpos(line, 'spark.sql(') :] || chr(10)
              ELSE text || line || chr(10) END,
         want <> 'name' AND hit AND contains(line, ')')
  FROM (SELECT w.script_id, f.n, w.want, w.name, w.text, f.line,
               w.want = 'end' OR (w.want = 'call' AND contains(f.line, 'spark.sql(')) AS hit
        FROM walk w JOIN files f ON f.script_id = w.script_id AND f.n = w.n + 1)),
ended AS (SELECT script_id, arg_max(want, n) = 'end' AS open FROM walk GROUP BY ALL),
pairs AS (
  SELECT script_id, 'ok' AS status, name AS df_name, {strip('arg_max(text, n)')} AS sql_text
  FROM walk JOIN ended USING (script_id) WHERE done AND NOT open GROUP BY script_id, name
  UNION ALL
  SELECT script_id, 'unterminated', NULL, NULL FROM ended WHERE open)"""

_NAME_EQ = rf"({W}+){B}*="


def all_sql() -> dict[str, str]:
    return {
        # sources and sinks
        "script_scan": f"""
            SELECT CASE WHEN contains(name, '/') THEN regexp_replace(name, '/[^/]*$', '') ELSE '.' END AS script_path, string_split(name, '/')[-1] AS script_name, length
            FROM ({FILE_NAMES}) WHERE NOT ends_with(name, '.SQL')""",
        "script_lines_by_range": f"""WITH{DOC_LINES}
            SELECT name AS script_id, line_no AS src_line_no, max(line_no) OVER (PARTITION BY name) AS n_src_lines, line
            FROM doc_lines JOIN ({FILE_NAMES}) USING (doc_id) WHERE NOT ends_with(name, '.SQL')""",
        "script_decode": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
        "script_lines": f"WITH{DOC_LINES} SELECT doc_id AS script_id, line_no AS src_line_no, line FROM doc_lines",
        "relative_path": """
            SELECT page_id, array_to_string(parts[1 : len(parts) - 1], '/') AS script_path, parts[-1] AS script_name
            FROM (SELECT page_id, CASE WHEN len(p) > 1 THEN p ELSE list_prepend('.', p) END AS parts
                  FROM (SELECT page_id, CASE WHEN len(string_split(url, '/')) > 3 THEN string_split(url, '/')[4 :]
                                             ELSE string_split(url, '/') END AS p FROM pages))""",
        "mapping_sink": over(NAMED, MAP.format(date=DATE)),
        "mapping_record": over(NAMED, f"""
            SELECT '{DATE}|' || script_path || '|' || script_name || '|' || line_no || '|' || CASE WHEN in_line THEN '' ELSE '@@##' END
                   || df_var || '|' || stmt_type || '|' || table_name || '|' || line AS record, copies
            FROM ({MAP.format(date=DATE)})"""),
        "mapping_table_reset": over(NAMED, f"""
            SELECT strd_dt, stmt_type, count(*) AS n FROM (
              SELECT * FROM ({MAP.format(date=DATE)}) UNION ALL
              SELECT * FROM ({MAP.format(date='20240102')}) WHERE stmt_type = 'FROM') GROUP BY ALL"""),
        # cleaning
        "strip_line_comments": over([C1], "SELECT * FROM c1"),
        "strip_comments_text": f"""
            SELECT doc_id, {strip(r"""array_to_string(list_transform(list_transform(string_split(regexp_replace(text, '/\*(.*?)\*/', ' ', 'gs'), chr(10)),
              lambda r: CASE WHEN contains(r, '--') THEN split_part(r, '--', 1) || ' ' ELSE r END),
              lambda r: CASE WHEN contains(r, '#') THEN split_part(r, '#', 1) || ' ' ELSE r END), chr(10))""")} AS text FROM documents""",
        "strip_comments_hashslash": f"""WITH{ALL_DOC_LINES}
            SELECT doc_id AS script_id, line_no AS src_line_no,
                   CASE WHEN contains(line, '/*') AND contains(line, '*/')
                        THEN left(line, strpos(line, '/*') - 1) || line[strpos(line, '*/') + 2 :] ELSE line END AS line
            FROM doc_lines WHERE NOT starts_with({lstrip('line')}, '#') AND NOT starts_with({lstrip('line')}, '//')""",
        "strip_comments_stmt": f"""WITH{STATEMENTS}
            SELECT script_id, stmt_no, regexp_replace(array_to_string(list_transform(string_split(sql, chr(10)),
                   lambda r: split_part(r, '--', 1)), chr(10)), '/\\*.*?\\*/', '', 'gs') AS sql FROM statements""",
        "drop_boilerplate_lines": over([C1, C5], "SELECT * FROM c5"),
        "normalize_line": over([C7.replace("FROM v4", "FROM lines")], "SELECT * FROM c7"),
        "drop_job_control_lines": over([C6.replace("FROM c7", "FROM lines")], "SELECT * FROM c6"),
        "pad_parentheses": f"SELECT page_id, {strip('''array_to_string(string_split(array_to_string(string_split(html, '('), ' ( '), ')'), ' ) ')''')} AS html FROM pages",
        "wrap_sql_call": over([], """
            SELECT script_id, src_line_no, CASE WHEN src_line_no = first THEN left(line, strpos(line, m) - 1) || ' ' || m || ' '
                   || substr(line, strpos(line, m) + length(m)) ELSE line END AS line
            FROM (SELECT *, min(src_line_no) FILTER (WHERE m <> '') OVER (PARTITION BY script_id) AS first
                  FROM (SELECT script_id, src_line_no, line, regexp_extract(line, 'spark\\.sql\\([^\\n]*?\\)') AS m FROM lines))"""),
        "strip_placeholder_marks": "SELECT page_id, array_to_string(string_split(array_to_string(string_split(html, '${'), ''), '}'), '') AS html FROM pages",
        # variables
        "assignment_map": over([C1, C5, V12], "SELECT script_id, var_name, var_value, first_pos FROM vars"),
        "assignment_value": over([C1, C5, V12], "SELECT script_id, src_line_no, var_name, var_value FROM valued"),
        "placeholder_collapse": over([C1, C5, V3], "SELECT * FROM v3"),
        "placeholder_substitute": over([C1, C5, V12, V3, V4], "SELECT * FROM v4"),
        # assembly
        "join_continuations": over([*SUBSTITUTED, L1], "SELECT script_id, pos AS src_line_no, line FROM l1"),
        "save_dir_fill": over(ASSEMBLED, "SELECT script_id, pos AS src_line_no, line FROM l2"),
        "line_number": over(ASSEMBLED, "SELECT script_id, pos AS src_line_no, line_no FROM l2"),
        # lineage
        "df_variable": over(ASSEMBLED, f"SELECT script_id, line_no, {_VAR} AS df_var FROM l2 WHERE contains(line, 'df_')"),
        "stmt_type": over([*ASSEMBLED, TYPED], "SELECT script_id, line_no, own_kind AS stmt_type FROM typed"),
        "table_refs": over([*ASSEMBLED, TYPED], """
            SELECT script_id, line_no, own_kind AS stmt_type, unnest(found) AS table_ref, generate_subscripts(found, 1) - 1 AS ref_no FROM typed"""),
        "block_owner": over([*ASSEMBLED, OWNER], "SELECT script_id, line_no, owner FROM owners WHERE line_no > 0"),
        "temp_view_use": over([*ASSEMBLED, TYPED, USES], "SELECT script_id, line_no, view_name, copies FROM uses"),
        "table_name_norm": over([*ASSEMBLED, TYPED, USES], f"""
            SELECT script_id, line_no, stmt_type, {normal('name')} AS table_name, ref_no FROM (
              SELECT script_id, line_no, kind AS stmt_type, unnest(l) AS name, generate_subscripts(l, 1) - 1 AS ref_no
              FROM (SELECT *, {_CHOSEN.format(x='found')} AS l FROM good))"""),
        "schema_filter": over([*ASSEMBLED, TYPED, USES], f"""
            SELECT script_id, line_no, table_name, ref_no, {known('table_name')} AND NOT {masked('table_name', 'line')} AS is_table FROM (
              SELECT script_id, line_no, line, {normal('name')} AS table_name, ref_no FROM (
                SELECT script_id, line_no, line, unnest(l) AS name, generate_subscripts(l, 1) - 1 AS ref_no
                FROM (SELECT *, {_CHOSEN.format(x='found')} AS l FROM good)))"""),
        "carried_refs": over(NAMED, "SELECT script_id, line_no, kind AS stmt_type, name AS table_name, copies FROM name_rows"),
        "in_line_flag": over(NAMED, "SELECT script_id, line_no, table_name, in_line FROM shown"),
        "bad_script_cutoff": over([*ASSEMBLED, TYPED, USES], """
            SELECT script_id, count(*) AS n_statements, max(line_no) AS last_line_no FROM good GROUP BY ALL"""),
        "bad_scripts": over([*ASSEMBLED, TYPED, USES], """
            SELECT script_id, min(line_no) AS bad_line_no FROM stmts WHERE bad GROUP BY ALL"""),
        "program_table_map": over(NAMED, MAP.format(date=DATE)),
        # texts and statements
        "first_balanced_span": f"WITH{SPAN} SELECT page_id, start, stop FROM spans",
        "first_call_body": rf"""WITH{SPAN}
            SELECT page_id, CASE WHEN NOT found THEN 'no_balanced_call' WHEN name = '' THEN 'no_name' ELSE 'ok' END AS status,
                   CASE WHEN found AND name <> '' THEN name END AS df_name,
                   CASE WHEN found AND name <> '' THEN {strip('html[start + 2 : stop]')} END AS body
            FROM (SELECT *, start >= 0 AND stop >= 0 AS found, regexp_extract(left(html, start), '{_NAME_EQ}', 1) AS name FROM spans)""",
        "widest_call_body": rf"""
            SELECT page_id, CASE WHEN NOT found THEN 'no_call' WHEN name = '' THEN 'no_name' ELSE 'ok' END AS status,
                   CASE WHEN found AND name <> '' THEN name END AS df_name, CASE WHEN found AND name <> '' THEN body END AS body
            FROM (SELECT page_id, regexp_matches(html, '(?s)\(.*\)') AS found, {strip(rf"regexp_extract(html, '{_NAME_EQ}')")} AS name,
                         {strip(r"regexp_extract(html, '(?s)\((.*)\)', 1)")} AS body FROM pages)""",
        "paren_groups": r"""
            SELECT page_id, coalesce((SELECT count(*) FROM (
                     SELECT c, d - least(0, min(d) OVER (ORDER BY i)) AS depth, i, d - lag(d, 1, 0) OVER (ORDER BY i) AS move,
                            lag(d - least(0, low)) OVER (ORDER BY i) AS was
                     FROM (SELECT c, i, d, min(d) OVER (ORDER BY i) AS low
                           FROM (SELECT c, i, sum(CASE c WHEN '(' THEN 1 ELSE -1 END) OVER (ORDER BY i) AS d
                                 FROM (SELECT unnest(l) AS c, generate_subscripts(l, 1) AS i)))) WHERE c = ')' AND was = 1), 0) AS n_groups,
                   group_text
            FROM (SELECT page_id, regexp_extract_all(html, '[()]') AS l,
                         CASE WHEN strpos(html, '(') = 0 THEN left(html, strpos(html, ')'))
                              WHEN strpos(html, ')') > strpos(html, '(') THEN html[strpos(html, '(') : strpos(html, ')')] ELSE '' END AS group_text
                  FROM pages)""",
        "df_sql_pairs": over([FILES, PAIRS], "SELECT * FROM pairs"),
        "from_tables": stmt([FROMS], "SELECT * FROM froms"),
        "insert_target": stmt([], rf"""
            SELECT script_id, stmt_no, regexp_extract(sql, '(?:OVERWRITE|INTO){B}+TABLE{B}+({W}+\.{W}+)', 1) AS table_name
            FROM cleaned WHERE regexp_matches(sql, '(?:OVERWRITE|INTO){B}+TABLE{B}+{W}+\.{W}+')"""),
        "statement_table_refs": stmt([REFS], "SELECT script_id, stmt_no, ref_no, role, table_schema, table_name, alias, is_function FROM refs"),
        "reference_label": stmt([REFS], """
            SELECT script_id, stmt_no, ref_no, coalesce(alias, CASE WHEN lower(table_name) = table_name AND upper(table_name) <> table_name THEN table_name
                   ELSE '"' || table_name || '"' END) AS label FROM refs"""),
        "statement_tables_distinct": stmt([REFS, FROMS, TABLES], "SELECT * FROM tables"),
        "schema_membership_split": stmt([REFS, FROMS, TABLES], f"""
            SELECT *, list_contains({sql_list(fv.STATEMENT_SCHEMAS)}, split_part(table_name, '.', 1)) AS schema_known FROM tables"""),
    }
