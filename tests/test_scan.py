"""The counted multiset of a script: random lines against a plain fold, and long stretches without a reset."""

import random
from collections import Counter

import pytest
import sequential
from pyspark.sql import functions as F

from lineweave.operators import scan
from lineweave.plans import program_map as pm

SCHEMA = "script_id long, pos long, chunk long, resets boolean, entries array<struct<name:string,shown:long,added:long>>, bad string"


def plain(lines):
    """{(pos, name): copies} of one script."""
    out, held = {}, Counter()
    for _, pos, _, resets, entries, bad in lines:
        if resets:
            held = Counter()
        held.update({n: added for n, _, added in entries})
        shown = {n: s for n, s, _ in entries if s is not None}
        for n in [n for n in held if n == bad and n not in shown]:
            del held[n]
        out.update({(pos, n): c for n, c in (held | shown).items() if c})
    return out


def random_lines(script, n, chunk, rnd):
    out, pos = [], 0
    for _ in range(n):
        pos += rnd.choice((1, 1, 2, 5))
        resets = rnd.random() < 0.12
        names = rnd.sample("abcd", rnd.choice((0, 0, 1, 2)))
        entries = [(x, rnd.randint(0, 2) if resets else None, rnd.randint(0, 2)) for x in names]
        out.append((script, pos, pos // chunk, resets, [e if resets or e[2] else (e[0], None, 1) for e in entries], rnd.choice(("a", "b", "x", "x", None))))
    return out


@pytest.mark.parametrize("levels, chunk, fan_out", [(0, 1, 16), (1, 7, 1 << 20), (2, 3, 4), (3, 1, 4)])
def test_counted(spark, monkeypatch, levels, chunk, fan_out):
    monkeypatch.setattr(scan, "FAN_OUT", fan_out)
    rnd = random.Random(17)
    scripts = {i: random_lines(i, rnd.randint(1, 40), chunk, rnd) for i in range(120)}
    lines = spark.createDataFrame([x for s in scripts.values() for x in s], SCHEMA).repartition(5)
    if not levels:
        lines = lines.drop("chunk")
    found = scan.counted(lines, levels, "entries", F.col("name") == F.coalesce("bad", F.lit("")))
    got = {}
    for r in found.collect():
        key = (r["pos"], r["name"])
        assert key not in got.setdefault(r["script_id"], {})
        got[r["script_id"]][key] = r["copies"]
    assert {i: p for i, p in ((i, plain(x)) for i, x in scripts.items()) if p} == got


@pytest.mark.parametrize("n, chunk_lines", [(16_000, 1 << 14), (100_000, 1 << 14)])
def test_long_stretches_without_a_reset(spark, n, chunk_lines):
    """Line k of so many that use one view holds it k - 1 times; no line carries those before it."""
    lines = spark.range(1, n + 1).select(
        F.lit(0).cast("long").alias("script_id"), F.col("id").cast("int").alias("src_line_no"), F.lit(n).alias("n_src_lines"),
        F.when(F.col("id") == 1, 'df_A.createOrReplaceTempView("V_ONE")').otherwise("FROM V_ONE x").alias("line"))
    rows = pm.program_table_map(lines, "20240101", chunk_lines=chunk_lines)
    wrong = rows.where((F.col("line_no") > 1) & (F.col("copies") != F.col("line_no") - 1))
    assert rows.agg(F.count("*"), F.sum("copies")).first() == (n, 1 + n * (n - 1) // 2)
    assert wrong.isEmpty()
    short = ['df_A.createOrReplaceTempView("V_ONE")'] + ["FROM V_ONE x"] * 300
    assert sum(sequential.program_map(short).values()) == 1 + 301 * 300 // 2
