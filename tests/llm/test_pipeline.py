"""The pipeline on the smallest table, and the front-coded merge."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from lineweave.llm import front_coding, op7_quality, op9_decontamination, queries
from lineweave.llm.shared import ship_package

from . import brute


def test_stages(spark, tiny):
    ship_package(spark)
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, bench = docs.columns, spark.read.parquet(f"{tiny}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, tiny)
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "quality_rules":
            assert {d for d, _ in after} <= {d for d, t in before if not brute.counts(t)[5]} and len(after) > 0.7 * len(before)
        if name == "line_dedup":
            gone = brute.removed_lines(before)
            assert sorted(after) == sorted((d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get((d, t), ()))) for d, t in before)
        if name == "ngram_join":
            assert sorted(d for d, _ in after) == sorted(d for d, n, c in brute.classes(before, 5, 80) if d == c or not n)
        if name == "decontamination":
            items = [op9_decontamination.tokens(r["text"]) for r in bench.collect()]
            bad = {d for d, t in before for i in items if len(i) >= op9_decontamination.MIN_MATCH and sum(
                n for _, _, n in op9_decontamination.tiles(i, op9_decontamination.tokens(t))) >= op9_decontamination.COVERAGE * len(i)}
            assert sorted(after) == sorted(x for x in before if x[0] not in bad) and bad
        if name != "pieces":
            assert docs.columns == columns
    assert docs.columns == [*columns, "ids", "decoded"]


def test_the_merge_of_front_coded_runs():
    r = random.Random(6)
    for runs, size in ((1, 5), (2, 4), (5, 6), (9, 3), (3, 40)):
        lists = [sorted(bytes(r.choices(b"ab", k=size)) for _ in range(r.randrange(0, 30))) for _ in range(runs)]
        made = [front_coding.Run(*front_coding.coded(np.frombuffer(b"".join(x), np.uint8).reshape(len(x), size)), size) for x in lists]
        got, before = [], None
        for run, i, share in front_coding.merged(made):
            text = lists[run][i]
            if before is not None:
                assert share == next((k for k in range(size) if text[k] != before[k]), size)
            got.append(text)
            before = text
        assert got == sorted(x for y in lists for x in y)


def test_registered_names():
    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.oracle_sql()) <= set(names)
    assert op7_quality.ORDER >= 3
