"""Every operator against its plain version, on a small table with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import base64
import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lineweave.llm import (
    dom, op1_url_filter, op2_line_dedup, op3_html_extraction, op4_pieces, op5_sentence_spans, op6_suffix_dedup, op7_quality, op8_ngram_join,
    op9_decontamination, op10_warc, words)
from lineweave.llm.shared import shared_path, ship_package

from . import brute


def _texts() -> list[str]:
    r = random.Random(7)
    syllables = ["an", "er", "th", "on", "ing", "re", "éa", "ou", "st"]
    word = lambda: "".join(r.choices(syllables, k=r.choice((1, 1, 2, 3))))
    sentence = lambda: " ".join(word() for _ in range(r.randint(4, 14))).capitalize() + r.choice(".!?")
    passage = " ".join(sentence() for _ in range(6))
    texts = []
    for n in range(40):
        lines = [" ".join(sentence() for _ in range(r.randint(1, 4))) for _ in range(r.randint(2, 7))]
        if n % 4 == 0:
            lines.insert(1, passage)
        texts.append("\n".join(lines))
    for base in (0, 3, 5):
        for _ in range(6):  # near copies
            ws = texts[base].split(" ")
            ws[r.randrange(len(ws))] = word()
            texts.append(" ".join(ws))
    texts += [texts[1], texts[1], texts[2] + " tail", "x", "", " \n\t ", "one two three", "One two THREE", "a " * 900, "aaaa" * 300, "é" * 260, "w\n" * 40 + passage]
    texts.append("\n".join(sentence() for _ in range(1500)))
    return texts


@pytest.fixture(scope="module")
def rows():
    made = list(enumerate(_texts()))
    return [*made, made[4], (900, None), (901, None), (None, made[6][1]), (None, None), (902, made[7][1])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    ship_package(spark)
    langs = ["en", "fr", None]
    # extra columns have names that operators use inside
    return spark.createDataFrame([(d, t, langs[i % 3] if t and i % 3 == 2 else "en", f"s{i}", len(t or ""), i, "k") for i, (d, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long, n long, key string").repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def _sorted(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def test_url_rules(spark):
    ship_package(spark)
    urls = ["http://a.net/x", "http://A.NET", "https://example.net/en/1?q", "https://x.example.net/en/", "https://example.net/de/", "x://example.com/de/#t",
            "http://notexample.com/de/", "http://q.org/fr/1", "http://q.org/FR/1", "no url", "", None, "http://", "http://net/?x", "http://a.net:80/", "a://b://c.net/"]
    rules = [*op1_url_filter.RULES, ("dup.net", "/", "allow"), ("dup.net", "/", "block"), (None, "/", "block"), ("long.net", "/" + "p" * 300, "allow")]
    table = spark.createDataFrame([(i, u, "old") for i, u in enumerate([*urls, "http://dup.net/", "http://long.net/" + "p" * 400] * 2)], "page_id long, url string, rule string")
    judged = op1_url_filter.UrlRules(spark.createDataFrame(rules, "host string, path string, verdict string")).judged(table)

    def plain(url):
        at = (url or "").find("://")
        rest = url[at + 3 :] if url and at >= 0 else ""
        host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
        path = rest[len(host) :]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        host = brute.lower(host)
        fit = [(len(h + p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        return host, path, best[1], best[2]
    got = judged.select("page_id", "url", "host", "path", "rule", "verdict").collect()
    assert len(got) == table.count()
    for r in got:
        assert tuple(r)[2:] == plain(r["url"]), r
    assert judged.where("false").count() == 0
    empty = op1_url_filter.UrlRules(spark.createDataFrame([], "host string, path string, verdict string")).judged(table)
    assert {r["verdict"] for r in empty.collect()} == {"allow"}


def test_colliding_digests_are_told_apart_by_their_strings(spark):
    from lineweave.llm import hash_arrays

    ship_package(spark)
    built = hash_arrays.build(spark.createDataFrame([(5, "a.net", "/", "block"), (5, "b.net", "/", "allow"), (9, "c", "/", "x")], "key long, host string, path string, verdict string"))
    mapped = built.open()
    at, found = mapped.first(mapped.keys[:1])
    assert found[0] and op1_url_filter._confirmed(mapped, int(at[0]), "b.net", "/") == ("b.net/", "allow")
    assert op1_url_filter._confirmed(mapped, int(at[0]), "d.net", "/") == (None, None)


def test_line_dedup(docs, rows, none):
    want = brute.removed_lines(rows)
    got = op2_line_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    expect = []
    for r in docs.collect():
        gone = want.get((r["doc_id"], r["text"] or ""), set())
        expect.append((r["doc_id"], r["n"], None if r["text"] is None else "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in gone)))
    assert _sorted(got.select("doc_id", "n", "text").collect()) == _sorted(expect)
    assert sum(map(len, want.values())) > 30
    assert op2_line_dedup.deduplicated(none).count() == 0


def test_lines_of_few_words_and_sets_of_all_sizes(spark):
    ship_package(spark)
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    lines = [" ".join(r.sample(vocabulary, r.choice((1, 2, 3, 4, 5, 6, 9, 14, 30)))) for _ in range(150)]
    for base in range(0, 150, 2):  # one word more, less, or another
        ws = lines[base].split()
        kind = r.randrange(3)
        lines.append(" ".join(ws[1:] if kind == 0 else [*ws, "extra"] if kind == 1 else ["Other", *ws[1:]]))
    r.shuffle(lines)
    rows = [(i, "\n".join(lines[5 * i : 5 * i + 5])) for i in range(len(lines) // 5)]
    got = op2_line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    want = {d: sorted(x) for (d, _), x in brute.removed_lines(rows).items()}
    assert {x["doc"]["id"]: x["removed"] for x in got.collect()} == want


def test_a_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Copies that differ from one base, which comes last, in five words of sixty: no two are similar, though they share most tokens.
    More of them than a token has heads; rows stand in the table twice."""
    ship_package(spark)
    r = random.Random(5)
    base, lines = [f"b{i}" for i in range(60)], []
    for i in range(150):
        own = r.sample(range(60), 3 if i % 10 == 9 else 5)
        lines.append(" ".join(f"x{i}_{k}" if k in own else w for k, w in enumerate(base)))
    rows = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(50)] + [(None, lines[0]), (60, " ".join(base))]
    counts, verified = [], op2_line_dedup._verified
    monkeypatch.setattr(op2_line_dedup, "_verified", lambda pairs, whole: counts.append((pairs.count(), pairs.distinct().count())) or verified(pairs, whole))
    got = op2_line_dedup.removed_lines(spark.createDataFrame(rows + rows[:20], "doc_id long, text string").repartition(4))
    want = {d: sorted(x) for (d, _), x in brute.removed_lines(rows).items()}
    assert {x["doc"]["id"] if x["doc"]["known"] else None: x["removed"] for x in got.collect()} == want
    assert sum(n for _, n in counts) < 2_500  # of 11,325
    assert sum(n for n, _ in counts) < 10_000  # a pair shares many tokens, but is met at few


def test_words_do_not_depend_on_blocks_and_memory_not_on_texts(monkeypatch):
    texts = ["Ab c\n\nd" * 50, None, "", " x", "y" * 300, "é\n" * 40, "\n z "] * 3
    whole = [x.tolist() for x in words.flat_words(pa.array(texts))]
    for block in (1, 7, 64):
        monkeypatch.setattr(words, "BLOCK", block)
        assert [x.tolist() for x in words.flat_words(pa.array(texts))] == whole
    monkeypatch.undo()
    long = pa.record_batch([pa.array(["some words and more " * 50_000] * 64)], ["text"])
    sizes = [b.num_rows for b in words.pieces([long], 1024)]
    assert sum(sizes) == 64 and max(sizes) == 4
    for batch in words.pieces([long.slice(0, 4)], 1024):
        words.flat_words(batch["text"])  # 4 MB
    assert max(map(len, words._powers)) <= 1 << 21


def test_html_extraction(spark):
    ship_package(spark)
    page = ("<html><head><title>T &amp; t</title><style>p{}</style></head><body><nav>Home &gt; {n}</nav><div class='left'>Menu {m}</div><div class=\"side-bar cookie\">c</div>"
            "<{box}><h1>Head &lt;{n}&gt;</h1><p>One\n  &eacute; <b>two</b>{n}<p>Three<br>four<script>var x='<p>no</p>'</script><ul><li>a<li>b {n}</ul>"
            "<section id=comments>bad</section><form>f</form></{box}><footer>&copy; x</footer></body></html>")
    made = [(i, f"http://h{i % 2}.net/{i}", page.replace("{n}", str(i)).replace("One", f"One{i}").replace("two", f"two{i}").replace("Three", f"Three{i}")
                                                    .replace("four", f"four{i}").replace("li>a", f"li>a{i}").replace("{m}", str(i % 2)).replace("{box}", "article" if i % 2 else "div class=x")) for i in range(12)]
    made += [(100, None, None), (101, "x", ""), (102, "http://one.net/", "<p>a<p>b <i>c</i>&nbsp;d &#x41; 3 < 4"), (None, None, "<p>null id"), made[0], (103, "y", "<div>" * 3000 + "deep"), (104, "z", "<p>cut <a href='x")]
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in op3_html_extraction.extracted(
        spark.createDataFrame([(*m, "v", 1) for m in made], "page_id long, url string, html string, host string, value int")).collect()}
    for i in range(12):
        # in pages without an article the recurring menu is template; in the other host it is outside the article
        assert got[(i, f"http://h{i % 2}.net/{i}")][0] == f"Head <{i}>\nOne{i} é two{i}{i}\nThree{i}\nfour{i}\na{i}\nb {i}", i
    assert got[(100, None)] == ("", 0) and got[(101, "x")] == ("", 0)
    assert got[(102, "http://one.net/")][0] == "a\nb c d A 3 < 4"
    assert got[(None, None)][0] == "null id" and got[(103, "y")] == ("deep", 4) and got[(104, "z")][0] == "cut"
    assert op3_html_extraction.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tree_matching_aligns_most_nodes():
    r = random.Random(3)

    def tree(depth, numbers):
        kids = [tree(depth - 1, numbers) for _ in range(r.randint(0, 3))] if depth else []
        label = r.choice("abc")
        return [label, hash((label, tuple(k[1] for k in kids))), next(numbers), 1 + sum(k[3] for k in kids), kids]

    def plain(a, b):
        if a[0] != b[0]:
            return 0
        table = [[0] * (len(b[4]) + 1) for _ in range(len(a[4]) + 1)]
        for i, x in enumerate(a[4]):
            for j, y in enumerate(b[4]):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + plain(x, y))
        return 1 + table[-1][-1]

    import itertools
    for _ in range(200):
        a, b = tree(4, itertools.count()), tree(4, itertools.count())
        assert len(dom.matched(a, b)) == plain(a, b)


def test_tree_matching_is_exact_for_long_lists_and_deep_trees(spark, monkeypatch):
    r = random.Random(4)

    def leaf(n, label):
        return ["x", n, n, 2, [[label, -n, -n, 1, []]]]

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            above, row = row, [0]
            for j, y in enumerate(b):
                row.append(max(above[j + 1], row[j], above[j] + 1 + (x == y)))
        return row[-1]

    a, b = ([r.choice("abc") for _ in range(300)] for _ in range(2))
    trees = [["body", k, 0, 1 + 2 * len(x), [leaf(n + 1000 * (k + 1), c) for n, c in enumerate(x)]] for k, x in enumerate((a, b))]
    found = sorted(dom.matched(*trees))
    assert len(found) == 1 + longest(a, b)
    monkeypatch.setattr(dom, "KEPT_CELLS", 0)
    assert sorted(dom.matched(*trees)) == found

    # a menu below 600 elements is template like one below 3
    for depth in (3, 600):
        pages = [(k, "http://a.org/", f"<body>{'<div>' * depth}<p>Menu A</p><p>text {k}</p>{'</div>' * depth}</body>") for k in range(4)]
        rows = op3_html_extraction.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
        assert {x.page_id: x.text for x in rows} == {k: f"text {k}" for k in range(4)}


def test_pieces(docs, none):
    library = op4_pieces.ChunkTable(op4_pieces.default_model()).library
    for r in op4_pieces.encoded(docs, op4_pieces.default_model()).collect():
        ids = library.encode(r["text"] or "")
        assert r["ids"] == ids and r["decoded"] == library.decode(ids)
    assert op4_pieces.encoded(none, op4_pieces.default_model(), digests=True).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  a ", "▁x ▁▁", "a\0b", "\n\n\t ", "ﬁ①　日本 😀​<s></s><0x41>", " " * 99 + "x" + " " * 70, "﻿\x85\xa0"])
def test_pieces_of_odd_texts(text):
    table = op4_pieces.table(op4_pieces.default_model())
    ids = table.library.encode(text)
    assert table.divisible and next(table.texts([text])) == (",".join(map(str, ids)), len(ids), table.library.decode(ids))


def test_sentence_spans(docs, rows, none):
    order = sorted({(d is not None, d or 0, t or "") for d, t in rows}, key=lambda x: x[:2])
    first, gone = {}, {}
    known = {(r["known"], r["id"], r["text"]): r["h"] for r in docs.select(F.coalesce("text", F.lit("")).alias("text"), op2_line_dedup.document_key().alias("k")).select("text", "k.*").collect()}
    for k, d, t in sorted(order, key=lambda x: (x[0], x[1], known[x])):
        for i, form in op5_sentence_spans.spans(t):
            if first.setdefault(form, (k, d, t, i)) != (k, d, t, i):
                gone.setdefault((k, d, t), set()).update(range(i, i + op5_sentence_spans.RUN))
    assert len(gone) > 10
    for r in op5_sentence_spans.deduplicated(docs).join(docs.select("n", F.col("text").alias("before")), "n").collect():
        own = gone.get((r["doc_id"] is not None, r["doc_id"] or 0, r["before"] or ""), set())
        assert r["text"] == (None if r["before"] is None else "".join(s for i, s in enumerate(op5_sentence_spans.sentences(r["before"])) if i not in own))
    assert op5_sentence_spans.covered(none).count() == 0
    assert "".join(op5_sentence_spans.sentences("A b.  \n\n . c!d? e")) == "A b.  \n\n . c!d? e"


def test_repeats_of_short_and_of_single_sentences_go(spark):
    """Plain expectations: what is left of each text is written out."""
    ship_package(spark)
    long = " ".join(f"word{i}" for i in range(60)) + "."
    short = " ".join(f"Ab{i} cd{i}!!" for i in range(9))
    texts = ["A!! B!! C!!", "A!! B!! C!!", f"Own start. {long} Own end.", f"Other start. {long} Other end.", f"First. {short} Last.", f"Before. {short} Behind.",
             f"{long[:-1]} and more.", "A!! B!! D!!", " \n a!! b!! c!!"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in op5_sentence_spans.deduplicated(table).collect()}
    assert got == {**dict(enumerate(texts)), 1: "", 3: "Other start. Other end.", 5: "Before. Behind.", 8: " \n"}


def test_every_sentence_of_a_long_repeat_is_in_a_span_inside_it():
    r = random.Random(11)
    for _ in range(300):
        text = " ".join(" ".join(f"w{r.randrange(10**9)}" for _ in range(r.choice((1, 2, 3, 5, 9, 14)))) + "." for _ in range(r.randint(1, 14)))
        cut = op5_sentence_spans.sentences(text)
        a, b = sorted(r.sample(range(len(cut) + 1), 2))
        if sum(len(s.split()) for s in cut[a:b]) >= op5_sentence_spans.MIN_WORDS:
            inside = [(i, n) for i, n, _ in op5_sentence_spans.grown(text) if a <= i and i + n <= b]
            assert {k for i, n in inside for k in range(i, i + n)} == set(range(a, b)), text


def test_suffix_dedup(docs, rows, none):
    got = op6_suffix_dedup.cut(docs, digests=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = [(d, *c) for (d, _), c in zip(rows, brute.cut([t for _, t in rows]))]
    assert _sorted(got) == _sorted(want)
    assert op6_suffix_dedup.cut(none).count() == 0


def test_suffix_dedup_over_blocks_runs_and_ranges(spark, monkeypatch):
    ship_package(spark)
    for name, value in (("BLOCK", 300), ("RUN_SUFFIXES", 500), ("RANGE_SUFFIXES", 700)):
        monkeypatch.setattr(op6_suffix_dedup, name, value)
    r = random.Random(5)
    base = "".join(r.choices("abc ", k=900))
    texts = [base[:400] + "X" + base[401:], base, base[100:700], "Y" + base[150:500] + "Z" + base[300:640], "ab" * 400, "ab" * 130, base[:150]]
    texts += ["".join(c if r.random() > 0.004 else "#" for c in base) for _ in range(12)]
    got = op6_suffix_dedup.cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), digests=True).orderBy("doc_id").collect()
    assert [tuple(g)[2:] for g in got] == brute.cut(texts)


def test_quality_counts(docs, rows, none):
    scored = op7_quality.scored(docs)
    judged = op7_quality.judged(scored).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert _sorted([tuple(r)[:7] for r in judged]) == _sorted([(d, *brute.counts(t)) for d, t in rows])
    assert all(not (r["base_failed"] and r["kept"]) for r in judged) and any(r["kept"] for r in judged)
    by_lang = {}
    for r in docs.collect():
        by_lang.setdefault(r["lang"] or "", []).append(r["text"] or "")
    models = {lang: brute.KneserNey(texts, op7_quality.ORDER) for lang, texts in by_lang.items()}
    for r in scored.collect():
        want = models[r["lang"] or ""].score(r["text"]) if r["n_words"] else None
        assert (r["score"] is None) == (want is None) and (want is None or abs(r["score"] - want) <= 1)
    assert op7_quality.judged(op7_quality.scored(none)).count() == 0


def test_perplexity_bands_reject_noise(spark):
    ship_package(spark)
    r = random.Random(1)
    clean = [" ".join(r.choice(["thing", "another", "where", "these", "under", "morning", "river", "stone"]) for _ in range(150)) for _ in range(80)]
    noise = [" ".join("".join(r.choices("qxzjkvw", k=7)) for _ in range(120)) for _ in range(3)]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(clean + noise)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x["doc_id"] for x in op7_quality.quality_stage(spark, table, "").collect()}
    assert kept == set(range(80))


def test_copies_of_one_text_do_not_set_the_band(spark):
    ship_package(spark)
    r = random.Random(8)
    vocabulary = ["".join(r.choices("aeinorstlmdu", k=r.randint(2, 9))) for _ in range(400)]
    clean = [" ".join(r.choices(vocabulary, k=r.randint(60, 160))) for _ in range(80)]
    table = spark.createDataFrame(list(enumerate([*clean, *[clean[0]] * 120])), "doc_id long, text string").withColumn("lang", F.lit("en"))
    assert {x["doc_id"] for x in op7_quality.quality_stage(spark, table, "").collect()} == set(range(200))


def test_ngram_join(docs, rows, none):
    got = op8_ngram_join.classified(docs, op8_ngram_join.Measure(4, 85)).select("doc.id", "n_shingles", "head.id").collect()
    assert _sorted(got) == _sorted(brute.classes(rows))
    assert op8_ngram_join.classified(none).count() == 0


def test_ngram_groups_find_what_heads_do_not(spark, monkeypatch):
    """Chains of near copies, with groups of two, so that links must come from the token-group matrix."""
    ship_package(spark)
    monkeypatch.setattr(op8_ngram_join, "GROUP", 2)
    r = random.Random(2)
    made = []
    for c in range(6):
        ws = [f"w{r.randrange(10**6)}" for _ in range(90)]
        for _ in range(12):
            made.append(" ".join(ws))
            for _ in range(2):
                ws[r.randrange(len(ws))] = f"w{r.randrange(10**6)}"
    table = list(enumerate(made))
    r.shuffle(table)
    got = op8_ngram_join.classified(spark.createDataFrame(table, "doc_id long, text string"), op8_ngram_join.Measure(4, 85)).select("doc.id", "n_shingles", "head.id").collect()
    assert _sorted(got) == _sorted(brute.classes(table))


def test_one_document_of_each_class_stays(spark, docs, rows):
    kept = op8_ngram_join.ngram_stage(spark, docs, "")
    assert kept.columns == docs.columns
    want = {(d, t) for (d, t), (_, n, c) in zip(rows, brute.classes(rows, 5, 80)) if n and d == c and d is not None}
    got = [(r["doc_id"], r["text"]) for r in kept.collect() if brute.WORD.search(r["text"] or "")]
    assert len(got) == len(set(got)) and set(got) == want
    assert kept.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")).count() == sum(not brute.shingles(t) for _, t in rows)


def _plain_tiles(item, doc, least):
    """Greedy string tiling as first published: all maximal matches of the greatest length, then mark."""
    a, b, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and a[i + n] and b[j + n]:
                    n += 1
                if n >= least:
                    best.append((-n, i, j))
        if not best:
            return out
        n, i, j = min(best)
        for k in range(-n):
            a[i + k] = b[j + k] = False
        out.append((i, j, -n))


def test_string_tiling():
    import numpy as np

    r = random.Random(4)
    for _ in range(150):
        item, doc = [[r.randrange(4) for _ in range(r.randint(0, 25))] for _ in range(2)]
        got = op9_decontamination.tiles(np.array(item, np.uint64), np.array(doc, np.uint64), 3)
        want = _plain_tiles(item, doc, 3)
        assert sorted(t[2] for t in got) == sorted(t[2] for t in want), (item, doc)
        assert all(item[i : i + n] == doc[j : j + n] for i, j, n in got)


def test_decontamination_finds_reordered_passages(spark, docs, none):
    bench = ["The quick brown fox jumps over the lazy dog. Then it sleeps under an old oak tree! Nobody knows why it does so every day.", "too short", None, "", "one two three four five"]
    items = spark.createDataFrame([*enumerate(bench), (0, bench[0])], "item_id long, text string")
    a, b, c = bench[0].split(". ")[0], "Then it sleeps under an old oak tree", "Nobody knows why it does so every day."
    texts = [f"x y z {bench[0]} more", f"{c} and {b.upper()}, {a}", f"only {a} here", "THE QUICK brown", "zero one two three four five six", None, ""]
    table = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, matches string")
    got = {(r["doc_id"], r["item_id"]) for r in op9_decontamination.matched(table, items).select("doc_id", F.inline("matches")).collect()}
    assert got == {(0, 0), (1, 0), (4, 4)}
    assert op9_decontamination.matched(none, items).count() == 0
    assert op9_decontamination.matched(table, items.limit(0)).where("size(matches) > 0").count() == 0


def test_warc(spark):
    ship_package(spark)
    html = [f"<p>{i}{'é text ' * i}</p>" for i in range(60)]
    made = [(i, f"http://a.net/{i}", h) for i, h in enumerate(html)] + [(i + 100, "http://b.net/\nx", html[i]) for i in range(30)]
    made += [(200, None, None), (201, "u", ""), (None, "n", html[3]), (None, "m", "only null"), made[5], (300, "long", "ab" * 500_000)]
    table = spark.createDataFrame([(*m, "x") for m in made], "page_id long, url string, html string, digest string").repartition(3)
    index = op10_warc.write_archives(table, shared_path(spark, "test-warc"))
    got = op10_warc.read_archives(index).collect()
    least = {}
    for p, _, h in made:
        if p is not None:
            least[h or ""] = min(p, least.get(h or "", p))
    want = []
    for p, u, h in made:
        data, first = (h or "").encode(), least.get(h or "")
        revisit = first is not None and p != first
        want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None, b"" if revisit else data))
    assert _sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in got) == _sorted(want)
    assert op10_warc.read_archives(op10_warc.write_archives(table.limit(0), shared_path(spark, "test-warc"))).count() == 0
    small = op10_warc.read_archives(op10_warc.write_archives(table, shared_path(spark, "test-warc"), min_bytes=50)).where("record_type = 'revisit'")
    assert small.agg(F.min("payload_bytes")).first()[0] >= 50


def test_an_archive_is_a_dictionary_frame_and_frames_of_single_records(spark):
    import struct

    import pyarrow.fs
    import zstandard

    ship_package(spark)
    table = spark.createDataFrame([(i, "http://a.net/", f"<p>{'common text ' * 9}{i}</p>") for i in range(40)], "page_id long, url string, html string").coalesce(1)
    index = op10_warc.write_archives(table, shared_path(spark, "test-warc")).orderBy("at").collect()
    fs, path = pyarrow.fs.FileSystem.from_uri(index[0]["archive"])
    data = fs.open_input_file(path).read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and index[0]["at"] == 8 + size
    assert [r["at"] + r["size"] for r in index] == [*[r["at"] for r in index[1:]], len(data)]
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    record = zstandard.ZstdDecompressor(dict_data=dictionary).decompress(data[index[-1]["at"] :])
    assert record.startswith(b"WARC/1.1\r\n") and op10_warc.parsed(record)["payload"].startswith(b"<p>common")
