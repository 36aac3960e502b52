"""Statement-level operators on hand-made statements."""

from lineweave.plans import statement_tables as st


def refs(spark, *sqls):
    df = spark.createDataFrame(list(enumerate(sqls)), "n int, sql string")
    out = {}
    for r in st.reference_rows(df).orderBy("n", "ref_no").collect():
        out.setdefault(r.n, []).append((r.role, r.table_schema, r.table_name, r.alias, r.is_function, r.label))
    return [out.get(i, []) for i in range(len(sqls))]


def test_references(spark):
    got = refs(
        spark,
        "SELECT * FROM ${DB}.Ta x LEFT OUTER JOIN (SELECT a FROM s.tb GROUP BY a) q ON x.a = q.a",
        "INSERT INTO sch.tgt (c1, c2) SELECT c1, c2 FROM src_a A, SRC_B b WHERE 1 = 1",
        "select * from gen_rows(1, 2) g join Other on g.a = Other.a -- from gone",
        'UPDATE "Sch"."Tab" SET a = 1',
        "DROP TABLE IF EXISTS s.t",
        "COPY log_in FROM 's3'",
        'SELECT 1 FROM "low" union all select 2 from a.b c /* from d */',
        "CREATE TABLE SWG.T1 LOCATION '/x'",
        "SELECT 1 FROM s.t WHERE note = 'moved FROM archive' AND b = 'it''s FROM x'",
        "SELECT EXTRACT(YEAR FROM CAST(d AS DATE)), TRIM(BOTH FROM e) FROM s.t WHERE a IN (SELECT b FROM s.u)",
        "SELECT 1 FROM s.t3 TABLESAMPLE (10 PERCENT) JOIN s.t4 x",
    )
    assert got[0] == [("FROM", "db", "ta", "x", False, "x"), ("FROM", "s", "tb", None, False, "tb")]
    assert got[1] == [("INTO", "sch", "tgt", None, False, "tgt"), ("FROM", None, "src_a", "A", False, "A"),
                      ("FROM", None, "SRC_B", "b", False, "b")]
    assert got[2] == [("FROM", None, "gen_rows", "g", True, "g"), ("JOIN", None, "other", "Other", False, "Other")]
    assert got[3] == [("UPDATE", "Sch", "Tab", None, False, '"Tab"')]
    assert got[4] == []
    assert got[5] == [("COPY", None, "log_in", None, False, "log_in")]
    assert got[6] == [("FROM", None, "low", '"low"', False, '"low"'), ("FROM", "a", "b", "c", False, "c")]
    assert [r[:3] for r in got[8]] == [("FROM", "s", "t")]
    assert [r[:3] for r in got[9]] == [("FROM", "s", "t"), ("FROM", "s", "u")]
    assert [r[:4] for r in got[10]] == [("FROM", "s", "t3", None), ("JOIN", "s", "t4", "x")]
    assert got[7] == [("TABLE", "swg", "t1", "T1", False, "T1")]


def test_nested_references(spark):
    cases = {
        "SELECT 1 FROM s.a a WHERE a.x IS DISTINCT FROM b.y AND a.z IS NOT DISTINCT FROM c.z": ["FROM s.a a"],
        "SELECT EXTRACT(YEAR FROM CAST(COALESCE(a, NVL(b, TRIM(c))) AS DATE)) FROM s.q": ["FROM s.q"],
        "SELECT 1 FROM ONLY s.t": ["FROM s.t"],
        "SELECT 1 FROM (SELECT 1 FROM s.a) q, s.after": ["FROM s.a", "FROM s.after"],
        "SELECT 1 FROM s.t3 TABLESAMPLE (10 PERCENT) x, s.t4": ["FROM s.t3 x", "FROM s.t4"],
        "SELECT 1 FROM s.f(g(h(1))) f, s.z": ["FROM s.f f ()", "FROM s.z"],
        "SELECT 1 FROM s.a JOIN (s.b JOIN s.c ON 1 = 1) ON 1 = 1 JOIN s.d USING (i), s.no": ["FROM s.a", "JOIN s.b", "JOIN s.c", "JOIN s.d"],
        "MERGE INTO s.t USING s.u u ON a = b WHEN MATCHED THEN UPDATE SET x = 1": ["INTO s.t", "USING s.u u"],
        "MERGE INTO s.t t USING (SELECT 1 FROM s.v, s.w) q ON 1 = 1": ["INTO s.t t", "FROM s.v", "FROM s.w"],
        "DELETE FROM s.t USING s.u WHERE 1 = 1": ["FROM s.t", "USING s.u"],
        "SELECT a, COALESCE(NVL(b, c), d) x FROM ((SELECT 1 FROM s.a) UNION (SELECT 2 FROM s.b)) q, S.C cc JOIN s.d dd ON (1=1)": [
            "FROM s.a", "FROM s.b", "FROM S.C cc", "JOIN s.d dd"],
        "SELECT 1 FROM TABLE(s.f(1, (SELECT 1 FROM s.q))) t, s.k AS kk": ["TABLE s.f ()", "FROM s.q", "TABLE s.k kk"],
        "SELECT 1 FROM s.f((SELECT 1 FROM s.q)) z": ["FROM s.f z ()", "FROM s.q"],
        "CREATE TABLE s.n (a DECIMAL(10, 2), b INT) USING parquet": ["TABLE s.n ()"],
        "INSERT INTO s.t (a, b) SELECT 1 FROM s.x, s.y": ["INTO s.t", "FROM s.x", "FROM s.y"],
        "COPY s.t FROM 's3://x' (FORMAT csv)": ["COPY s.t"],
        "SELECT 1 FROM s.a PIVOT (sum(x) FOR y IN (1, 2)) p JOIN s.b ON 1=1, s.no": ["FROM s.a p", "JOIN s.b"],
        "SELECT 1) FROM s.a, (s.b": ["FROM s.a", "FROM s.b"],
        "SELECT 1 FROM s.a, (SELECT 2 FROM s.b": ["FROM s.a", "FROM s.b"],
        "": [], "FROM": [], "((((": [], "))))": [], ", a FROM": [],
        "SELECT " + "f(" * 300 + "1" + ")" * 300 + " FROM " + "(SELECT 1 FROM s.x, " * 60 + "s.deep" + ")" * 60 + ", s.last": ["FROM s.x"] * 60 + ["FROM s.deep", "FROM s.last"],
    }
    shown = [[" ".join(x for x in (r[0], f"{r[1]}.{r[2]}", r[3], "()" if r[4] else None) if x) for r in found] for found in refs(spark, *cases)]
    assert shown == list(cases.values())


def test_a_null_statement_has_no_references(spark):
    assert st.reference_rows(spark.createDataFrame([(1, None)], "n int, sql string")).collect() == []


def test_table_split_on_a_long_insert(spark):
    sql = """
      INSERT OVERWRITE TABLE ${TMP}.SALES_DAY PARTITION (P='1')
      SELECT A.ID, NVL(C.CD, '#') AS CD   -- seller
        FROM ${TMP}.SALES_RAW A
        LEFT OUTER JOIN (SELECT B1.ID, MAX(B1.SEQ) AS SEQ FROM ${SWG}.RECEIPT B1 GROUP BY B1.ID
                          UNION ALL
                         SELECT B1.ID, MAX(B1.SEQ) FROM ${DB_X}.RECEIPT_OLD B1) B ON A.ID = B.ID
        LEFT OUTER JOIN ${DB_X}.ORG C ON B.ORG = C.ORG"""
    df = spark.createDataFrame([(1, sql)], "n int, sql string")
    assert {(r.table_name, r.schema_known) for r in st.table_rows(df).collect()} == {
        ("TMP.SALES_DAY", True), ("TMP.SALES_RAW", True), ("SWG.RECEIPT", True),
        ("DB_X.RECEIPT_OLD", False), ("DB_X.ORG", False)}
    assert st.table_rows(df)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
