"""The whole map, on random scripts and on the derived corpus, against the sequential statement of the rules."""

import random
import time
from collections import Counter

import pytest
import sequential
from pyspark.sql import functions as F

from lineweave.operators import scan, variables
from lineweave.plans import program_map as pm
from lineweave.sources.corpus import corpus_lines

PARTS = [
    "DB_SWG = DwCfg.SWG_P", 'DB_TMP = "TMP"', "DB_IP = IP_PLF_X", "= 'X'", "P = {MartCfg.DB_A}/x.y", "BRAND = 1",
    "# note", "  -- note", "import os", "print(1)", "", "   ", "spark.stop()", "a = 1 /* b */ -- c",
    "spark.sql('x') # cut", 'df_A = spark.sql(f"""', 'spark.sql(f"""', '""")', '  """)', "SELECT A.ID, B.NM",
    " FROM {DB_SWG}.TB_ONE A", "LEFT JOIN {MartCfg.DB_TMP}.TB_TWO B", "FROM NODOT", "JOIN (STG_V1 ", "FROM STG_V1 x",
    'df_A.createOrReplaceTempView("V_ONE")', 'df_B.createOrReplaceTempView("V_ON")',
    'df_B.createOrReplaceTempView("STG_V1")', 'df_C.union(df_A).createOrReplaceTempView("V_C")',
    "x.createOrReplaceTempView()", "SELECT 1 FROM V_ONE", "FROM V_ON, STG_V1", "drop table V_C",
    'df_P = spark.read.parquet(f"{DB_STG}/TB_X")', 'df_P = spark.read.parquet("x")',
    'save_dir = f"/TMP/TB_5"', 'df_P.write.mode("overwrite") \\', "  .option(a=1) \\", '.parquet(save_dir + "/p")',
    'df_P.write.mode("overwrite").parquet("/TMP/TB_1/x")', 'df_P.write.mode("overwrite").parquet(save_dir)',
    "df_U = df_P.union(df_A)", "\\", "df_ = spark.sql('x')", 'df_X.save(f"{STG}/TB_Q")', "X.SAVE",
    "INSERT OVERWRITE TABLE {DB_TMP.X}.TB_3", "CASE WHEN TMP.TB_9 > 1 FROM TMP.TB_9", "FROM (TMP.TB_8) x",
    "ALTER TABLE {DB_IP}.TB_7 ADD", "LOCATION '/w/1'", "CREATE OR REPLACE VIEW {DB_SWG}.V_1 AS",
    "TAST.TB_1 FROM TAST.TB_2", "FROM 가나.TB_1 x", "FROM SWG.AB x", "x = {CommonCfg.A}_lower()}\t", "DROP {DB_SWG}.TB_9 ",
    "FROM IP_PLF.TB_K JOIN {A_B.C}.D", "spark.sql(f\"DROP TABLE IF EXISTS {DB_TMP}.TB_5\")", "createOrReplaceTempView (",
    "df_ = save", "FROM V_ONE JOIN", "JOIN CASE WHEN STG_V1", "df_Z = spark.sql(\"\"\"SELECT 1 FROM {DB_SWG}.TB_Z \"\"\")",
]
# lines that end a script, alone or with others of the list
FATAL = {"df_ = save", 'df_P = spark.read.parquet("x")', "df_ = spark.sql('x')", "X.SAVE", "\\", '.parquet(save_dir + "/p")',
         'df_P.write.mode("overwrite").parquet(save_dir)', 'df_P.write.mode("overwrite") \\', "  .option(a=1) \\"}


def random_scripts(n, longest, seed):
    rnd = random.Random(seed)
    calm = [p for p in PARTS if p not in FATAL]
    for i in range(n):
        pool = PARTS if i % 4 == 0 else rnd.sample(calm, rnd.randint(4, len(calm)))
        yield i, [rnd.choice(pool) for _ in range(rnd.randint(1, longest))]


def as_lines(spark, scripts):
    rows = [(i, n, len(lines), line) for i, lines in scripts for n, line in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "script_id bigint, src_line_no int, n_src_lines int, line string")


def got(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.script_id, Counter())[
            (r.line_no, r.df_var, r.stmt_type, r.table_name, r.in_line, r.line)] += r.copies
    return out


def compare(expected, actual):
    for i, rows in expected.items():
        assert actual.get(i, Counter()) == rows, i
    assert set(actual) <= set(expected)


@pytest.mark.parametrize("chunk_lines, fan_out", [(1 << 20, 16), (7, 16), (1, 8)])
def test_random_scripts(spark, monkeypatch, chunk_lines, fan_out):
    """One window per script; one level of chunks; two levels, of single lines and of eight chunks."""
    monkeypatch.setattr(scan, "FAN_OUT", fan_out)
    assert scan.levels_for(60, chunk_lines) == {1 << 20: 0, 7: 1, 1: 2}[chunk_lines]
    scripts = list(random_scripts(400, 60, 11))
    expected = {i: sequential.program_map(lines) for i, lines in scripts}
    assert sum(map(len, expected.values())) > 1000
    actual = got(pm.program_table_map(as_lines(spark, scripts), "20240101", chunk_lines=chunk_lines))
    compare(expected, actual)


@pytest.mark.parametrize("chunk_lines", [1 << 20, 20])
def test_lines_without_sizes(spark, chunk_lines):
    scripts = list(random_scripts(60, 60, 23))
    lines = as_lines(spark, scripts).drop("n_src_lines")
    compare({i: sequential.program_map(ls) for i, ls in scripts},
            got(pm.program_table_map(lines, "20240101", chunk_lines=chunk_lines)))


def test_one_script_holds_a_third_of_all_lines(spark):
    """The long script goes through chunks, the others through one window each; both come out whole."""
    rnd = random.Random(4)
    calm = [p for p in PARTS if p not in FATAL and "createOrReplaceTempView()" not in p and "createOrReplaceTempView (" not in p]
    scripts = [(0, [rnd.choice(calm) for _ in range(700)])] + list(random_scripts(60, 45, 31))[1:]
    rows = pm.program_table_map(as_lines(spark, scripts), "20240101", chunk_lines=64)
    compare({i: sequential.program_map(ls) for i, ls in scripts}, got(rows))


@pytest.mark.parametrize("chunk_lines", [1 << 20, 16])
def test_corpus(spark, tiny, chunk_lines):
    lines = corpus_lines(spark, tiny)
    scripts = {}
    for r in lines.orderBy("src_line_no").collect():
        scripts.setdefault(r.script_id, []).append(r.line)
    compare({i: sequential.program_map(ls) for i, ls in scripts.items()},
            got(pm.program_table_map(lines, "20240101", chunk_lines=chunk_lines)))


def test_expand_copies(spark):
    scripts = [(1, ['df_A.createOrReplaceTempView("V_ONE")'] * 3 + ["FROM V_ONE x", "FROM V_ONE y"])]
    rows = pm.program_table_map(as_lines(spark, scripts), "20240101")
    assert {(r.line_no, r.copies) for r in rows.collect()} == {(1, 1), (2, 1), (3, 1), (4, 3), (5, 6)}
    assert pm.expand_copies(rows).count() == 12
    assert "copies" not in pm.expand_copies(rows).columns


def test_one_shuffle_and_no_python(spark):
    lines = spark.createDataFrame([(1, 1, 1, "FROM SWG.TB_1 x")], "script_id bigint, src_line_no int, n_src_lines int, line string")
    plan = pm.program_table_map(lines, "20240101")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(script_id") == 1
    assert plan.count("Exchange") == 1
    assert "Python" not in plan and "Join" not in plan


def test_tasks_follow_the_number_of_lines(spark):
    """Ten times the lines are ten times the tasks, not tasks of ten times the lines; the map is the same."""
    def lines(n):
        return spark.range(n).select(F.col("id").alias("script_id"), F.posexplode(F.array(*map(F.lit, ["df_A = 1", "FROM SWG.TB_ONE x"]))).alias("i", "line")).select(
            "script_id", (F.col("i") + 1).cast("long").alias("src_line_no"), "line")

    def steps(part, levels):
        return pm.assembled(part, levels)

    for n in (2_000, 20_000):
        found = pm.by_length(lines(n), steps, lines_a_task=100)
        assert found.rdd.getNumPartitions() == 2 * n // 100 and found.count() == 2 * n
    # chunks of long scripts
    assert pm.by_length(lines(500).withColumn("src_line_no", 2 * F.col("script_id") + F.col("src_line_no")).withColumn("script_id", F.lit(1)),
                        lambda part, levels: part, chunk_lines=100, lines_a_task=50).rdd.getNumPartitions() >= 20


def test_many_variables_in_a_short_script(spark):
    """A mark asks each variable once: 1,500 variables and as many marks are no cube of that number."""
    n = 1500
    texts = [f'v{k:04}x = "A{k}"' for k in range(n)] + [f'v{7:04}x = "LAST"'] + [f"FROM {{v{k:04}x}}" for k in range(n)]
    rows = spark.createDataFrame([(1, p, t) for p, t in enumerate(texts, 1)], "script_id long, pos long, line string")
    before = time.monotonic()
    got = [r.line for r in variables.fill_placeholders(rows, 0).orderBy("pos").collect()][n + 1 :]
    assert got == [f"FROM {{{'LAST' if k == 7 else f'A{k}'}}}" for k in range(n)]
    assert time.monotonic() - before < 30
