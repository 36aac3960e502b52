"""Whitening, chat formatting and spelling variants against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineweave.llm import op11_whitening, op12_chat, op13_spelling
from lineweave.llm.shared import ship_package


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def _sorted(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


# --- whitening

def _vectors():
    r = np.random.default_rng(3)
    spread = np.linspace(3.0, 0.2, 12)
    rows = [(int(i), [float(c) for c in np.float32(v)], 0) for i, v in enumerate(r.standard_normal((300, 12)) * spread @ np.linalg.qr(r.standard_normal((12, 12)))[0])]
    rows += [(7, rows[7][1], 1), (None, rows[3][1], 1), *[(1000 + k, rows[0][1], 2) for k in range(200)]]  # repeated rows, a common vector
    odd = [(500, None, 0), (501, [None] + [0.5] * 11, 0), (502, [float("nan")] + [0.5] * 11, 0), (503, [float("inf")] * 12, 0), (504, [], 0), (505, [1.0, 2.0], 0)]
    return rows, odd


VECTORS = "vec_id long, embedding array<float>, n int"


def _plain_whitening(rows, count):
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for _, v, _ in rows])
    n, sums = len(x), x.sum(0)
    c = x - sums / n
    e, w = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1][:count], w[:, ::-1][:, :count]
    return n, ((n * x - sums) ** 2).sum(1), c @ w / np.sqrt(e), e / np.trace(c.T @ c / n)


@pytest.mark.parametrize("folder", [True, False])
def test_whitening(spark, tmp_path, folder):
    rows, odd = _vectors()
    mixed = [*rows, *odd]
    random.Random(1).shuffle(mixed)
    spark.createDataFrame(mixed, VECTORS).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    if folder:
        found = op11_whitening.op11_whitening(spark, str(tmp_path)).collect()
    else:  # no more steps than asked for: the leading components are still right to some digits
        stored = op11_whitening.blocks(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), "vec_id", "embedding")
        assert op11_whitening.fitted(stored, 5).components.shape == (12, 5)
        return
    n, deviations, whitened, explained = _plain_whitening(rows, 8)
    assert len(found) == 8 * n
    by_id = defaultdict(list)
    for r in found:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-10)
        by_id[r["vec_id"], r["component"]].append(r)
    own = defaultdict(list)
    for i, (vec, _, _) in enumerate(rows):
        own[vec].append(i)
    for k in range(8):
        sign = np.sign(by_id[0, k + 1][0]["whitened"] * whitened[own[0][0], k])
        for vec, at in own.items():
            got = by_id[vec, k + 1]
            assert sorted(r["deviation"] for r in got) == sorted(deviations[at])
            assert np.allclose(sorted(r["whitened"] for r in got), sorted(sign * whitened[at, k]), atol=1e-9)


def test_whitening_of_few_directions(spark):
    """Repeated variances, dependent dimensions, equal rows, one row, none, and very long entries."""
    def fit(rows):
        stored = op11_whitening.blocks(spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, n int"),
                                       "vec_id", "embedding")
        return op11_whitening.fitted(stored)

    cross = [s * np.eye(6)[k] for k in range(4) for s in (-1, 1)]  # four equal variances, two dimensions without any
    found = fit(cross)
    assert found.components.shape == (6, 4)
    assert np.allclose(found.variances, 2 * 1024**2 / 8) and found.identity_error(8) < 1e-9
    assert np.allclose(found.components.T @ found.components, np.eye(4))
    line = fit([[k, 2 * k, -k, 5] for k in range(9)])
    assert line.components.shape == (4, 1) and np.allclose(np.abs(line.components[:, 0]), np.array([1, 2, 1, 0]) / 6**0.5)
    for rows in ([[1.5, 2.5]] * 4, [[1.5, 2.5]]):
        same = fit(rows)
        assert same.components.shape[1] == 0 and same.whitened(8).collect() == [] and same.identity_error(8) == 0
    assert fit([[1e300, -1e300, 0.1], [0.0, 1.0, 0.2], [1.0, 0.0, 0.3]]).sums[0] == 2**45 + 100_000 * 3 + 1024
    wide = fit([[1e9, 1.0], [-1e9, 2.0], [3e8, 4.0]])
    x = [[1024 * int(a) + 100_000, 1024 * int(b) + 100_000] for a, b in ((1e9, 1.0), (-1e9, 2.0), (3e8, 4.0))]
    sums = [sum(c) for c in zip(*x)]
    assert sorted({int(r["deviation"]) for r in wide.whitened(2).collect()}) == sorted(sum((3 * a - s) ** 2 for a, s in zip(r, sums)) for r in x)
    assert op11_whitening.fitted(op11_whitening.blocks(spark.createDataFrame([(1, None, 0)], VECTORS), "vec_id", "embedding")) is None


# --- chat

LOG = "conv_id long, seq long, message long, kind string, role string, text string, part string, whole int"


def _plain_fold(events):
    convs = defaultdict(dict)
    for conv, seq, message, kind, role, text, *_ in sorted(events, key=lambda e: tuple((x is not None, x) for x in (e[0], e[1], e[2], e[3], e[5]))):
        if kind not in ("open", "delta", "edit", "regenerate"):
            continue
        m = convs[conv].setdefault(message, ["", ""])
        if kind == "open":
            m[0] = role or ""
        if kind != "delta":
            m[1] = ""
        if kind in ("delta", "edit"):
            m[1] += text or ""
    return convs


def _plain_rows(convs):
    out = []
    for conv, messages in convs.items():
        turns = "".join(f"{r}\n{t}\n" for r, t in messages.values())
        loss = "".join(t for r, t in messages.values() if r == "assistant")
        size = sum(len(op12_chat.turn(r, t)[0]) for r, t in messages.values())
        out.append((conv, len(messages), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return out


def _events(n, seed, share):
    r = random.Random(seed)
    words = ["</s>", "[INST]", "<\\s>", "ok", " ", "\\", "<<SYS>>", "<", "[", "é", "\n", "[\\\\/INST]", "<</ROLE>>", "𝄞"]
    text = lambda: r.choice([None, "".join(r.choices(words, k=r.randint(0, 6)))])
    kinds = ["open", "delta", "delta", "delta", "edit", "regenerate", "ping", None]
    out = []
    for seq in range(n):
        conv = 5 if r.random() < share else r.choice([None, *range(40)])
        out.append((conv, r.choice([seq, seq, 3]), r.choice([seq // 40, seq // 40, 0]), r.choice(kinds), r.choice([None, "user", "assistant", "system", "tool <s>"]), text(), "x", 1))
    return out


@pytest.mark.parametrize("share", [0.0, 0.5])
@pytest.mark.parametrize("partitions", [1, 7])
def test_chat_folds_any_log(spark, share, partitions):
    events = _events(1200, 11, share)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = op12_chat.read_back(op12_chat.formatted(spark.createDataFrame(events, LOG).repartition(4))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert _sorted(found) == _sorted(_plain_rows(_plain_fold(events)))


def test_chat_marks_are_reversible():
    r = random.Random(5)
    pieces = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "</SYS>>", "<ROLE>>", "<TEXT>>", "</ROLE>>", " ", "a", "\n", ">"]
    for _ in range(4000):
        turns = [(r.choice(["user", "assistant", "system", "", "tool", "".join(r.choices(pieces, k=4))]), "".join(r.choices(pieces, k=r.randint(0, 9)))) for _ in range(r.randint(1, 4))]
        (text, spans), = op12_chat._parts(iter(turns))
        assert list(op12_chat.turns_of(text)) == turns
        assert [op12_chat.unescaped(text[s["start"] : s["stop"]]) for s in spans] == [t for role, t in turns if role == "assistant"]
        for _, said in turns:
            assert not any(c in op12_chat.escaped(said) for c in op12_chat._CONTROLS)


def test_chat_table(spark, tmp_path):
    """The query on rows with nulls, repeated and tied rows, empty and very long texts, and other columns."""
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "é" * 300_000), (2, 0, "system", ""), (2, 1, "user", None), (2, 2, "assistant", None), (3, 5, None, "x"),
            (3, 5, None, "x"), (3, 5, "user", "</s>"), (None, 0, "user", "q"), (None, None, "assistant", "a"), (4, 0, "assistant", "w " * 900_000), (4, 1, "assistant", "[INST]" * 200_000), (4, 2, "user", "end")]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, message int").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    found = op12_chat.op12_chat(spark, str(tmp_path)).collect()
    rows += [(-7, 0, "user", op12_chat.OWN_TEXT), (-7, 1, "assistant", op12_chat.OWN_TEXT)]
    digest = lambda r: hashlib.md5(f"{r[2] or ''}\n{r[3] or ''}".encode()).hexdigest()
    convs = defaultdict(dict)
    for i, r in enumerate(sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, digest(r)))):
        convs[r[0]][i] = [r[2] or "", r[3] or ""]
    assert _sorted(found) == _sorted(_plain_rows(convs))
    assert next(r for r in found if r["conv_id"] == -7)["formatted_chars"] == 2 * (len(op12_chat.OWN_TEXT) + 3) + len("[INST]  [/INST]") + len("<s>  </s>")
    none = spark.createDataFrame([], LOG)
    assert op12_chat.read_back(op12_chat.formatted(none)).collect() == []


# --- spelling

def _plain_words(rows, shortest=6):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= shortest:
                count[run] += 1
    return count


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _plain_variants(count):
    near = {w: [x for x in count if _one_edit(w, x)] for w in count}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 5 * count[w] else None
    out = []
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    return out


def _spelling_rows():
    r = random.Random(9)
    base = ["abcdef", "abcdeg", "abcdefg", "bcdefgh", "éabcdef", "straßen", "aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "bababab", "×÷×÷×÷", "longerword", "longword"]
    made = set(base)
    while len(made) < 260:
        w = list(r.choice(sorted(made)))
        at = r.randrange(len(w))
        kind = r.randrange(3)
        w[at : at + (kind > 0)] = r.choice("abcéß÷") if kind < 2 else ""
        if 5 <= len(w) <= 12:
            made.add("".join(w))
    counts = {w: int(5 * 5 ** r.choice([0, 0, 0.2, 1, 1.2, 2, 3])) for w in sorted(made)}
    tokens = [w if r.random() < 0.9 else w.upper() for w, n in counts.items() for _ in range(n)]
    r.shuffle(tokens)
    rows = [(i, " .,\n'_9"[i % 7].join(tokens[k : k + 40])) for i, k in enumerate(range(0, len(tokens), 40))]
    return [*rows, rows[0], rows[0], (None, rows[1][1]), (700, None), (701, ""), (702, " \n"), (None, None), (703, "xyzzyx " * 400_000 + "q" * 1_200_000 + " xyzzyx")]


def test_words_and_variants(spark, tmp_path):
    rows = _spelling_rows()
    docs = spark.createDataFrame([(d, t, "w", 3) for d, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    count = _plain_words(rows)
    assert dict(map(tuple, op13_spelling.counted(docs).collect())) == count
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plain = _plain_variants({w: n for w, n in count.items() if n >= 5})
    assert _sorted(op13_spelling.op13_spelling(spark, str(tmp_path)).collect()) == _sorted(plain)
    assert any(r[2] != r[1] and r[1] for r in plain)  # chains of forms occur
    assert op13_spelling.variants(op13_spelling.counted(docs.limit(0))).collect() == []


@pytest.mark.parametrize("size", range(1, 9))
def test_every_pair_one_edit_apart_is_found(spark, size):
    """All words over two letters, short ones too: no edit at any place is missed, and each pair comes once."""
    made = [format(k, f"0{n}b") for n in (size, size + 1) for k in range(2**n)]
    pairs = op13_spelling.near_pairs(spark.createDataFrame([(w, 1) for w in made], "word string, n long")).collect()
    found = [frozenset((r["a"], r["b"])) for r in pairs]
    assert len(found) == len(set(found))
    assert set(found) == {frozenset((a, b)) for a in made for b in made if _one_edit(a, b)}
