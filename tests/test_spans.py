"""Parenthesis and call-body operators against a character loop."""

import random
import re

from pyspark.sql import functions as F

from lineweave.functions import spans
from lineweave.operators.pairs import df_sql_pairs as line_pairs
from lineweave.plans.call_bodies import df_sql_pairs, first_call_bodies


def balanced(text):
    depth, start = 0, -1
    for i, c in enumerate(text):
        if c == "(":
            start, depth = (i if depth == 0 else start), depth + 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return start, i
    return start, -1


def groups(text):
    depth = n = 0
    for c in text:
        if c == "(":
            depth += 1
        elif c == ")" and depth:
            depth -= 1
            n += depth == 0
    return n


def texts(n=800):
    rnd = random.Random(3)
    return ["".join(rnd.choice(["(", ")", "a ", "=", "df_1", "é", "\n"]) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_spans(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "n int, text string")
    got = {r.n: r for r in df.select(
        "n", spans.first_balanced_span(F.col("text")).alias("span"), spans.paren_groups(F.col("text")).alias("g"),
        spans.widest_call_body(F.col("text")).alias("w")).collect()}
    first = {r.n: r for r in first_call_bodies(df).collect()}
    for n, text in rows:
        start, stop = balanced(text)
        assert (got[n].span.start, got[n].span.stop) == (start, stop), text
        assert got[n].g.n_groups == groups(text)
        if groups(text):
            assert got[n].g.group_text == text[text.find("("):text.find(")") + 1]
        name = re.search(r"\b(\w+)\s*=", text[:start]) if stop >= 0 else None
        expected = "no_balanced_call" if stop < 0 else "ok" if name else "no_name"
        assert first[n].status == expected
        if name:
            assert (first[n].df_name, first[n].body) == (name.group(1), text[start + 1:stop].strip())
        a, b = text.find("("), text.rfind(")")
        names = re.findall(r"\b\w+\b\s*=", text)
        if a < 0 or b < a:
            assert got[n].w.status == "no_call"
        elif not names:
            assert got[n].w.status == "no_name"
        else:
            assert (got[n].w.df_name, got[n].w.body) == (names[0].strip(), text[a + 1:b].strip())


def pairs(text):
    lines, out, i = text.splitlines(keepends=True), {}, 0
    name = None
    sql = ""
    calling = False
    for line in lines:
        if name is None:
            if line.strip().startswith("df_"):
                name, sql = line.strip().split("=")[0].strip(), ""
            continue
        if not calling and "spark.sql(" in line:
            calling, line = True, line
            sql += line[line.find("spark.sql("):]
        else:
            sql += line
        if calling and ")" in line:
            out[name] = sql.strip()
            name, calling = None, False
    return None if calling else out


def test_df_sql_pairs(spark):
    rnd = random.Random(5)
    parts = ["df_a = 1", "df_b=spark.sql(", " spark.sql('''", "x) spark.sql(", "SELECT 1", "''')", "# df_c", "", "  df_d.x = y"]
    rows = [(n, "\n".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))) for n in range(500)]
    texts = spark.createDataFrame(rows, "script_id int, text string")
    for chunk_lines in (3, 1000):
        got = {}
        for r in df_sql_pairs(texts, chunk_lines).collect():
            got.setdefault(r.script_id, {})[r.df_name] = r.sql_text if r.status == "ok" else r.status
        for n, text in rows:
            expected = pairs(text)
            assert got.get(n, {}) == ({None: "unterminated"} if expected is None else expected), text


def test_short_scripts_are_walked_in_one_stream(spark):
    """Thousands of short scripts: none is a Python call of its own, and each gets its pairs."""
    n = 20_000
    rows = spark.range(n).select(F.concat(F.lit("s"), "id").alias("script_id"), F.posexplode(F.array(
        F.concat(F.lit("df_"), "id", F.lit(" = 1")), F.lit("x spark.sql("), F.concat("id", F.lit(")")))).alias("i", "line"))
    found = line_pairs(rows.select("script_id", (F.col("i") + 1).alias("src_line_no"), "line"))
    assert "InPandas" not in found._jdf.queryExecution().toString()
    expected = F.concat(F.lit("spark.sql(\n"), F.substring("script_id", 2, 9), F.lit(")"))
    assert found.where((F.col("sql_text") == expected) & (F.col("status") == "ok") & (F.col("df_name") == F.concat(F.lit("df_"), F.substring("script_id", 2, 9)))).count() == n
    nothing = line_pairs(spark.createDataFrame([(None, 1, "df_A"), (None, 2, "spark.sql(")], "script_id string, src_line_no int, line string"))
    assert [tuple(r) for r in nothing.collect()] == [(None, "unterminated", None, None)]
