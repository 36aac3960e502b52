"""Files in, stored map out."""

from collections import Counter

import sequential
from pyspark.sql import functions as F

from lineweave.functions.text import all_lines_of
from lineweave.plans import directory
from lineweave.plans import program_map as pm
from lineweave.sources import files, map_table, script_files

SCRIPT = 'DB_T = "TMP"\r\ndf_A = spark.sql(f"""\rSELECT 1 FROM {DB_T}.TB_ONE\n""")\ndf_A.createOrReplaceTempView("V_A1")\nFROM V_A1 x'


def write(root):
    (root / "sub").mkdir()
    (root / "a.py").write_bytes(SCRIPT.encode())
    (root / "sub" / "b.sql").write_bytes("-- note\nSELECT é FROM SWG.TB_TWO".encode("latin-1"))
    (root / "sub" / "c.SQL").write_text("FROM SWG.TB_NO x")
    (root / "sub" / "d.sh").write_text("")
    (root / "e.txt").write_text("FROM SWG.TB_NO x")


def test_files_to_map(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    write(root)
    texts = files.script_texts(script_files.script_contents(script_files.script_scan(spark, str(root))), str(root))
    got = {r.script_id: r.text for r in texts.collect()}
    plain = SCRIPT.replace("\r\n", "\n").replace("\r", "\n")
    assert got == {"a.py": plain, "sub/b.sql": "-- note\nSELECT é FROM SWG.TB_TWO", "sub/d.sh": ""}

    lines = files.script_lines(texts)
    assert [r.line for r in lines.where("script_id = 'a.py'").orderBy("src_line_no").collect()] == [
        'DB_T = "TMP"', 'df_A = spark.sql(f"""', "SELECT 1 FROM {DB_T}.TB_ONE", '""")',
        'df_A.createOrReplaceTempView("V_A1")', "FROM V_A1 x"]
    rows = directory.map_directory(spark, str(root), "20240101")
    assert rows.columns == pm.MAP_COLUMNS
    expected = Counter(sequential.program_map(plain.split("\n")))
    assert {(r.line_no, r.df_var, r.stmt_type, r.table_name, r.in_line, r.line): r.copies
            for r in rows.where("script_name = 'a.py'").collect()} == expected
    other = rows.where("script_name = 'b.sql'").collect()
    assert [(r.script_path, r.script_name, r.table_name) for r in other] == [("sub", "b.sql", "SWG.TB_TWO")]
    assert [r.script_path for r in rows.where("script_name = 'a.py'").limit(1).collect()] == ["."]
    longer = directory.map_directory(spark, str(root), "20240101", chunk_lines=2)
    assert sorted(map(tuple, longer.collect())) == sorted(map(tuple, rows.collect()))

    calls = {r.script_name: (r.status, r.df_name, r.body) for r in directory.call_bodies(spark, str(root)).collect()}
    assert calls["a.py"] == ("ok", "DB_T", 'f"""\nSELECT 1 FROM {DB_T}.TB_ONE\n"""')
    assert calls["b.sql"] == ("no_balanced_call", None, None)


def test_stored_map(spark, tmp_path):
    path = str(tmp_path / "map")
    one = spark.createDataFrame(
        [("20240101", "p", "s.py", 1, "df_A", "FROM", "SWG.T1X", True, "FROM SWG.T1X", 2),
         ("20240102", "p", "s.py", 2, "df_A", "FROM", "SWG.T2X", False, "FROM", 1)],
        "strd_dt string, script_path string, script_name string, line_no int, df_var string, stmt_type string, "
        "table_name string, in_line boolean, line string, copies bigint")
    map_table.write_map(one, path)
    map_table.write_map(one.where("strd_dt = '20240102'").withColumn("table_name", F.lit("SWG.T3X")), path)
    assert {(r.strd_dt, r.table_name) for r in map_table.read_map(spark, path).collect()} == {
        ("20240101", "SWG.T1X"), ("20240102", "SWG.T3X")}
    plan = map_table.read_map(spark, path).where("strd_dt = '20240102'")
    assert plan.count() == 1

    out = str(tmp_path / "out")
    map_table.export_records(one, out)
    assert sorted(r.value for r in spark.read.text(out).collect()) == [
        "20240101|p|s.py|1|df_A|FROM|SWG.T1X|FROM SWG.T1X", "20240101|p|s.py|1|df_A|FROM|SWG.T1X|FROM SWG.T1X",
        "20240102|p|s.py|2|@@##df_A|FROM|SWG.T2X|FROM"]
    map_table.reset_map(spark, path)
    assert spark.read.schema(one.schema).parquet(path).count() == 0


def test_hidden_and_empty_scripts_are_read(spark, tmp_path):
    root = tmp_path / "in"
    names = ["a.py", "__init__.py", "_x.sql", ".h/x.py", ".h.sh", "sub/_y/z.sql", "sub/_y/.w/v.sh", "py", "x.py.txt", "_n.txt", "sub/A.SQL"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("FROM SWG.TB_ONE")
    (root / "empty.sql").write_text("")
    (root / "no" / "files").mkdir(parents=True)
    expected = {n: 15 for n in names[:7]} | {"empty.sql": 0}
    for folders in (1, 2, 64):
        scanned = script_files.script_scan(spark, str(root), folders=folders).collect()
        assert {r.path.split("/in/")[1]: r.length for r in scanned} == expected and len(scanned) == len(expected)
    rows = directory.map_directory(spark, f"file:{root}", "20240101").collect()
    assert {f"{r.script_path}/{r.script_name}".removeprefix("./") for r in rows} == set(names[:7])
    assert script_files.script_scan(spark, str(root / "no")).collect() == []
    assert directory.map_directory(spark, str(root / "no"), "20240101").collect() == []


def test_scripts_that_end_early_are_listed(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "good.py").write_text("FROM SWG.TB_ONE x\nSELECT A.B")
    (tmp_path / "sub" / "_bad.py").write_text('# note\nFROM SWG.TB_ONE x\ndf_A.write.mode("overwrite").parquet(target)\nFROM SWG.TB_TWO x')
    for chunk_lines in (1 << 14, 2):
        found = directory.ended_scripts(spark, str(tmp_path), chunk_lines=chunk_lines).collect()
        assert [(r.script_path, r.script_name, r.bad_line_no) for r in found] == [("sub", "_bad.py", 2)]


def test_lines_over_range_borders(spark, tmp_path):
    """Ranges of a few bytes cut line ends, characters and lines at every place; all equal the whole read."""
    contents = {
        "crlf.py": "ab\r\ncd\r\n\r\n\r\re\n\nf".encode(), "utf8.py": "é€𝄞\r\nüß\n𝄞𝄞𝄞\rx".encode(), "latin.sql": "é€𝄞\r\nabc".encode() + b"\xe9\r\nx\xff",
        "bad_end.sql": b"abc\n" + "é".encode()[:1], "long.sh": b"x" * 500, "ends.sh": b"\r\n" * 40, "cr.sh": b"\r" * 33, "empty.sh": b"", "one.py": b"a", "nl.py": b"\n",
        "surrogate.py": b"ok\n\xed\xa0\x80\n", "latin_late.py": b"a\n" * 200 + b"\xfc",
    }
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)

    def plain(data):
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = data.decode("latin-1")
        return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")

    for range_bytes in (1, 3, 100):
        lines, sizes = script_files.script_lines(script_files.script_scan(spark, str(tmp_path)), str(tmp_path), range_bytes)
        got = {}
        for r in lines.collect():
            assert r.src_line_no not in got.setdefault(r.script_id, {})
            got[r.script_id][r.src_line_no] = r.line
            assert r.n_src_lines == len(plain(contents[r.script_id]))
        assert {n: [x[k] for k in sorted(x)] for n, x in got.items()} == {n: plain(d) for n, d in contents.items()}
        assert all(sorted(x) == list(range(1, len(x) + 1)) for x in got.values())
        assert dict(map(tuple, sizes.collect())) == {n: len(plain(d)) for n, d in contents.items()}


def test_short_ranges_make_no_more_tasks(spark, tmp_path):
    """What a task reads does not shrink with the ranges: 5,000 ranges of a byte are read by as many tasks as two files."""
    for name in ("a.py", "b.py"):
        (tmp_path / name).write_text("FROM SWG.TB\n" * 208)
    lines, _ = script_files.script_lines(script_files.script_scan(spark, str(tmp_path)), str(tmp_path), 1)
    assert lines.count() == 2 * 209
    assert lines.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism


def test_lines_of_hash_and_slash_comments(spark):
    texts = ["a\r\nb\x0bc\u2028d\x85e\n", "", "\n\n", "x\x1cy\x0c", "one", "\r\r\n\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", all_lines_of(F.col("text")).alias("lines")).collect()
    assert {r.n: r.lines for r in rows} == {n: t.splitlines() for n, t in enumerate(texts)}
