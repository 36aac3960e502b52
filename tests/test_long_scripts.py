"""Steps whose state could grow with a script: long placeholders, many views, long continued lines."""

import random

import pytest
import sequential
from pyspark.sql import functions as F

from lineweave.operators import assemble, pairs, variables
from lineweave.operators.lookup import names_within
from lineweave.plans import program_map as pm


def lines_of(spark, texts, chunk):
    return spark.createDataFrame([(0, n, line, n // chunk) for n, line in enumerate(texts, 1)], "script_id long, pos long, line string, chunk long")


def test_names_within(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abÀ𝄞") for _ in range(n))
    names = [(s, w) for s in range(3) for w in {word(rnd.randint(1, 6)) for _ in range(25)}]
    texts = [(rnd.randrange(4), k, word(rnd.choice((0, 1, 5, 40, 9000)))) for k in range(40)]
    found = names_within(spark.createDataFrame(texts, "script_id long, k long, text string"), spark.createDataFrame(names, "script_id long, name string"), ["script_id", "k"])
    rows = [(r.script_id, r.k, r.name) for r in found.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(s, k, w) for s, k, t in texts for x, w in names if x == s and w in t}


def test_long_placeholders(spark):
    """A placeholder of 100,000 characters, names of 200, names that are parts of each other, and none."""
    rnd = random.Random(8)
    names = ["".join(rnd.choice("abc") for _ in range(200)) for _ in range(5)] + ["ab", "abc", "zz"]
    long = "".join(rnd.choice("xyz") for _ in range(60_000)) + names[3] + "q" * 39_000 + names[1]
    texts = [f"{n} = {k}v" for k, n in enumerate(names)] + ["SELECT {%s} x" % long, "{%s.t} {%s}" % (names[2], names[0][1:]), "{q}", "{" + "y" * 100_000 + "}"]
    expected = list(sequential.substitute(texts, sequential.variables(texts)))
    for chunk, levels in ((3, 1), (1 << 20, 0)):
        got = variables.fill_placeholders(lines_of(spark, texts, chunk), levels).orderBy("pos").collect()
        assert [r.line for r in got] == expected


@pytest.mark.parametrize("n", [50_000])
def test_one_long_continued_line(spark, n):
    texts = ["a = 1"] + [f"p{k} \\" for k in range(n)] + ["last", "lone"] + ["open \\"] * 3
    for chunk, levels in ((1 << 14, 1), (1 << 20, 0)):
        got = assemble.join_continuations(lines_of(spark, texts, chunk), levels).orderBy("pos").collect()
        assert [(r.pos, r.line) for r in got] == [(1, "a = 1"), (n + 2, "".join(f"p{k}" for k in range(n)) + "last"), (n + 3, "lone")]


def test_many_views_in_one_script(spark):
    """16,000 declarations, each used once; no line holds the others."""
    n = 32_000
    lines = spark.range(1, n + 1).select(
        F.lit(0).cast("long").alias("script_id"), F.col("id").cast("int").alias("src_line_no"), F.lit(n).alias("n_src_lines"),
        F.when(F.col("id") % 2 == 1, F.concat(F.lit('df_A.createOrReplaceTempView("V'), F.col("id").cast("string"), F.lit('_X")')))
        .otherwise(F.concat(F.lit("FROM SWG.TB_1 y JOIN V"), (F.col("id") - 1).cast("string"), F.lit("_X z"))).alias("line"))
    rows = pm.program_table_map(lines, "20240101").where("stmt_type = 'TEMP_VIEW_USE' AND table_name <> 'TB_1'")
    assert rows.agg(F.count("*"), F.sum("copies"), F.max("copies")).first() == (n // 2, n // 2, 1)
    assert rows.where(F.col("table_name") != F.concat(F.lit("V"), (F.col("line_no") - 1).cast("string"), F.lit("_X"))).isEmpty()


@pytest.mark.parametrize("last, status", [("df_B = x", "ok"), ("df_B = spark.sql(", "unterminated")])
def test_names_whose_call_never_closes(spark, last, status):
    """The rest of a long script behind an open name or call is not gathered; pairs before an open name stay, an open call voids them."""
    texts = ["df_A = 1", "y = spark.sql('s'", "t)", "df_A = 2", "spark.sql(u)", last, *(["spark.sql("] if status != "ok" else []), *["FROM SWG.T x"] * 40_000]
    rows = spark.createDataFrame([(0, n, t) for n, t in enumerate(texts, 1)], "script_id long, src_line_no int, line string")
    for chunk_lines in (1 << 14, 1 << 20):
        found = pairs.df_sql_pairs(rows, chunk_lines)
        assert [tuple(r) for r in found.collect()] == ([(0, "ok", "df_A", "spark.sql(u)")] if status == "ok" else [(0, "unterminated", None, None)])
