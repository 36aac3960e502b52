"""Quality rules: plain counts of every text, and a modified Kneser-Ney model whose perplexity bands reject documents.

The model predicts the characters of a word (and its end) from the ORDER - 1 before, separately for each language. Its
n-grams are counted by Spark over all documents: tasks count the distinct words they see, spread them to n-grams, and the
sums, continuation counts, discounts and context weights are aggregates and joins. Entries lie in sorted hash arrays
(`hash_arrays`) that tasks map. N-grams of characters inside words saturate: the arrays grow with the alphabet and word
forms of the languages, not with the number of documents.

The score of a document is its mean negative log probability per character. A mean over n characters varies with
1 / sqrt(n), so the band of a language is its median score, less and plus BAND robust deviations of
(score - median) * sqrt(n) over sqrt(n). Both are medians over the distinct texts of the language, so that no group of copies sets the
band alone. They enter in whole thousandths or hundredths, so that medians come from exact,
mergeable histograms.

base_failed: under 10 words, or over 20 % of the words in repeated 5-word windows. kept: not base_failed, and the score in
the band. Null text counts as empty, null language as a language of its own; a text without words has no score and fails.
The model of the query and of the stage counts each text of a language once, as copies would make their own score low; all rows are
scored. Columns of the input named like those of the result are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineweave.llm import hash_arrays, sets, words
from lineweave.llm.shared import dropped, scratch, stored

ORDER = 4
#: Robust standard deviations either side of the median.
BAND = 5.0
#: Half width of a band, in nats per character, that every text is allowed besides.
LEAST_WIDTH = 0.02
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20
SYMBOLS = "#*$%&|<>"
#: Words that a task holds at once while it counts, and while it scores.
HELD_WORDS, HELD_COSTS = 200_000, 200_000

_START, _END = "\x02", "\x03"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


# --- counts of a text

def repeated_words(found: list[str], size: int = 5) -> int:
    """How many words lie in a window of `size` words that occurs twice or more. Windows are told apart by hash first; the
    few that share a hash are compared word by word."""
    if len(found) <= size:
        return 0
    hashes = words.window_hashes(np.fromiter(map(hash, found), np.int64, len(found)).view(np.uint64), size)
    order = np.sort(hashes)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    places = np.flatnonzero(np.isin(hashes, again)).tolist()
    seen = Counter(tuple(found[i : i + size]) for i in places)
    cover = np.zeros(len(found) + 1, np.int64)
    for i in places:
        if seen[tuple(found[i : i + size])] > 1:
            cover[i] += 1
            cover[i + size] -= 1
    return int((np.cumsum(cover) > 0).sum())


def base_counts(text: str, found: list[str]) -> tuple[int, int, int, int, int]:
    lines = [x for x in text.split("\n") if words.WORD.search(x)]
    return (len(found), sum(map(len, found)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(found))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words)


# --- n-grams as numbers

def _points(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The padded words as one row of code points; the places that the model predicts."""
    joined = "".join([_START * (ORDER - 1) + w + _END for w in many])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, many), np.int64, len(many)) + 1
    starts = np.cumsum(sizes + ORDER - 1) - sizes
    nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return points, np.repeat(starts, sizes) + nth


def _seed(lang: str) -> np.uint64:
    return words.window_hashes(np.frombuffer(("#" + lang).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), len(lang) + 1)[0]


def _longer(keys: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Keys of n-grams that have one more code point in front."""
    return words.mixed(keys * np.uint64(0x9E3779B97F4A7C15) + points + np.uint64(1))


# --- the model, counted by Spark

def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def spread() -> Iterator[pa.RecordBatch]:
        for lang, counted in held.items():
            forms = list(counted)
            for at in range(0, len(forms), 50_000):
                part = forms[at : at + 50_000]
                grams = Counter()
                for w in part:
                    c, padded = counted[w], _START * (ORDER - 1) + w + _END
                    for i in range(len(w) + 1):
                        grams[padded[i : i + ORDER]] += c
                yield pa.record_batch([[lang] * len(grams), list(grams), list(grams.values())], ["lang", "gram", "c"])
        held.clear()

    for batch in words.pieces(batches):
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            held.setdefault(lang, Counter()).update(words.WORD.findall(text))
        if sum(map(len, held.values())) > HELD_WORDS:
            yield from spread()
    yield from spread()


def _levels(grams: DataFrame) -> DataFrame:
    """(lang, size, gram, c): counts of the longest n-grams; of shorter ones the number of different characters before
    them, but their own count at the start of a word, before which nothing stands."""
    level = stored(grams.groupBy("lang", "gram").agg(F.sum("c").alias("c")), "grams")
    parts = [level.withColumn("size", F.lit(ORDER))]
    for size in range(ORDER - 1, 0, -1):
        shorter = level.groupBy("lang", F.substring("gram", 2, size).alias("gram")).agg(F.sum("c").alias("sum"), F.count("*").alias("n"))
        level = stored(shorter.select("lang", "gram", F.when(
            F.startswith("gram", F.lit(_START)), F.col("sum")).otherwise(F.col("n")).alias("c")), "grams")
        parts.append(level.withColumn("size", F.lit(size)))
    return reduce(DataFrame.unionByName, parts)


def _discounts(levels: DataFrame) -> DataFrame:
    """d1, d2, d3 of each language and size, from how many n-grams have the counts 1 to 4."""
    n = [F.sum(F.when(F.col("c") == i, 1.0).otherwise(0.0)).alias(f"n{i}") for i in range(1, 5)]
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))
    one = lambda i: F.greatest(F.lit(0.1), F.least(F.lit(i - 0.1), F.when(
        F.col(f"n{i}") > 0, i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(F.lit(0.5 * i)))).alias(f"d{i}")
    return levels.groupBy("lang", "size").agg(*n).select("lang", "size", one(1), one(2), one(3))


def _weights(levels: DataFrame) -> DataFrame:
    """(lang, gram, alpha, gamma): the discounted share of an n-gram in its context, and what its context leaves to shorter ones."""
    c, none = F.col("c"), F.lit(None).cast("double")
    cut = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
    known = levels.join(_discounts(levels), ["lang", "size"]).select(
        "lang", "gram", c, F.least(cut, c.cast("double")).alias("cut"), F.expr("substring(gram, 1, size - 1)").alias("context"))
    contexts = known.groupBy("lang", "context").agg(F.sum("c").alias("total"), (F.sum("cut") / F.sum("c")).alias("gamma"))
    alphas = known.join(contexts.drop("gamma"), ["lang", "context"]).select(
        "lang", "gram", ((c - F.col("cut")) / F.col("total")).alias("alpha"), none.alias("gamma"))
    gammas = contexts.select("lang", F.col("context").alias("gram"), none.alias("alpha"), "gamma")
    return alphas.unionByName(gammas).groupBy("lang", "gram").agg(
        F.coalesce(F.max("alpha"), F.lit(0.0)).alias("alpha"), F.coalesce(F.max("gamma"), F.lit(1.0)).alias("gamma"))


def _once(texts: DataFrame) -> DataFrame:
    """Every text of a language once. Only rows whose hash may be repeated (by a bitmap) are shuffled, after their task has dropped its copies."""
    keyed = texts.withColumn("h", F.xxhash64("lang", "text"))
    many = stored(keyed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "copied")
    repeated = sets.bitmap(many, "h", many.count())
    dropped(many)

    def part(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = sets.in_bitmap(repeated, batch["h"].to_numpy())
                yield batch.filter(pa.array(hit == wanted))
        return keyed.mapInArrow(run, "lang string, text string, h long")
    return part(False).unionByName(part(True).dropDuplicates(["lang", "h"])).drop("h")


def fit(docs: DataFrame, once: bool = False) -> hash_arrays.HashArrays:
    """The model of columns lang and text; once: copies of a text count as one."""
    texts = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    with scratch(docs.sparkSession):
        grams = (_once(texts) if once else texts).mapInArrow(_count_words, "lang string, gram string, c long")
        return hash_arrays.build(_weights(_levels(grams)).mapInArrow(_with_keys, "key long, alpha float, gamma float"))


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = batch["gram"].to_pylist()
        seeds = np.array([_seed_of(x) for x in batch["lang"].to_pylist()], np.uint64)
        sizes, keys = np.array(list(map(len, grams)), np.int64), np.zeros(len(grams), np.int64)
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            text = "".join([grams[i] for i in rows]).encode("utf-32-le", "surrogatepass")
            points = np.frombuffer(text, np.uint32).astype(np.uint64).reshape(len(rows), size)
            own = seeds[rows]
            for back in range(size - 1, -1, -1):
                own = _longer(own, points[:, back])
            keys[rows] = own.view(np.int64)
        yield pa.record_batch([pa.array(keys, pa.int64()), batch["alpha"].cast(pa.float32()), batch["gamma"].cast(pa.float32())], ["key", "alpha", "gamma"])


_seeds: dict[str, np.uint64] = {}


def _seed_of(lang: str) -> np.uint64:
    if lang not in _seeds:
        _seeds[lang] = _seed(lang)
    return _seeds[lang]


def word_costs(model: hash_arrays.Arrays, lang: str, many: list[str]) -> np.ndarray:
    """-log probability of each word with its end."""
    points, ends = _points(many)
    seed = _seed_of(lang)
    keys = np.full(len(points), seed, np.uint64)
    at, known = model.probe(keys[:1].view(np.int64))
    gamma = np.where(known, model.columns["gamma"][at], 1.0) if len(keys) else keys
    p = np.full(len(ends), 1e-6) * gamma
    for size in range(1, ORDER + 1):  # keys of all n-grams by their last place; those that cross words are not asked for
        keys[size - 1 :] = _longer(keys[size - 1 :], points[: len(points) - size + 1])
        at, known = model.probe(keys.view(np.int64))
        p += np.where(known, model.columns["alpha"][at], 0.0)[ends]
        if size < ORDER:
            p *= np.where(known, model.columns["gamma"][at], 1.0)[ends - 1]
    sizes = np.fromiter(map(len, many), np.int64, len(many)) + 1
    return -np.add.reduceat(np.log(p), np.cumsum(sizes) - sizes) if len(many) else np.zeros(0)


_costs: dict[str, dict[tuple[str, str], float]] = {}


def _score(model: hash_arrays.HashArrays):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = model.open()
        if model.name not in _costs:
            _costs.clear()
        cost = _costs.setdefault(model.name, {})
        for batch in words.pieces(batches, most=1 << 20):
            counts, scores = [], []
            found = [words.WORD.findall(t or "") for t in batch["text"].to_pylist()]
            langs = [x or "" for x in batch["lang"].to_pylist()]
            if sum(map(len, cost.values())) > HELD_COSTS:
                cost.clear()
            for lang in set(langs):
                own = cost.setdefault(lang, {})
                new = list({w for ws, x in zip(found, langs) if x == lang for w in ws} - own.keys())
                for at in range(0, len(new), 20_000):
                    own.update(zip(new[at : at + 20_000], word_costs(mapped, lang, new[at : at + 20_000]).tolist()))
            for text, ws, lang in zip(batch["text"].to_pylist(), found, langs):
                counts.append(base_counts(text or "", ws))
                chars = counts[-1][1] + len(ws)
                scores.append(round(1000 * sum(map(cost[lang].__getitem__, ws)) / chars) if ws else None)
            out = {n: batch[n] for n in batch.schema.names}
            for i, field in enumerate(BASE.split(", ")):
                out[field.split()[0]] = pa.array([c[i] for c in counts], pa.int64())
            yield pa.RecordBatch.from_pydict(out | {"score": pa.array(scores, pa.int64())})
    return run


# --- bands

def _median(rows: DataFrame, value: str) -> DataFrame:
    """Exact lower median of (lang, value, n) histograms."""
    w = Window.partitionBy("lang").orderBy(value)
    total = F.sum("n").over(Window.partitionBy("lang"))
    return (rows.withColumn("upto", F.sum("n").over(w)).withColumn("total", total).where(2 * F.col("upto") >= F.col("total"))
            .groupBy("lang").agg(F.min(value).alias("median"), F.max("total").alias("total")))


def bands(scored: DataFrame) -> DataFrame:
    """(lang, median, width): the centre of each language's band in thousandths, and its half width for a text of one
    character. Texts that the base rules reject don't count, copies of a text count once."""
    fine = scored.where(F.col("score").isNotNull() & ~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    text = F.col("_text") if "_text" in scored.columns else F.xxhash64("text")
    once = fine.select(F.coalesce("lang", F.lit("")).alias("lang"), text.alias("_text"), "score", "n_words", "word_chars").distinct()
    middle = _median(once.groupBy("lang", "score").agg(F.count("*").alias("n")), "score").select("lang", "median")
    away = once.join(middle, "lang").select(
        "lang", F.round(F.abs(F.col("score") - F.col("median")) * F.sqrt(_chars()) / 10).alias("away"))
    spread = _median(away.groupBy("lang", "away").agg(F.count("*").alias("n")), "away").select("lang", F.col("median").alias("mad"))
    return middle.join(spread, "lang").select(F.col("lang").alias("_lang"), "median", (BAND * 14.826 * F.col("mad")).alias("width"))


def _chars() -> Column:
    return F.col("word_chars") + F.col("n_words")


def judged(scored: DataFrame) -> DataFrame:
    """scored with base_failed and kept."""
    room = F.col("width") / F.sqrt(_chars()) + 1000 * LEAST_WIDTH
    both = scored.join(bands(scored), F.coalesce("lang", F.lit("")) == F.col("_lang"), "left").withColumn(
        "base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    inside = F.coalesce(F.abs(F.col("score") - F.col("median")) <= room, F.lit(True))
    return both.withColumn("kept", ~F.col("base_failed") & inside)


def scored(docs: DataFrame, once: bool = False) -> DataFrame:
    """docs (lang, text and any others) with the counts and the score, written once. once: as in fit."""
    names = {f.split()[0] for f in BASE.split(", ")} | {"score", "median", "width", "_lang", "_text", "base_failed", "kept"}
    docs = docs.drop(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return stored(docs.mapInArrow(_score(fit(docs, once)), f"{fields}, {BASE}, score long"), "scored")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    names = [f.split()[0] for f in BASE.split(", ")]
    rows = _without_text(docs)
    return judged(rows).select("doc_id", *names, "base_failed", "kept")


def _without_text(docs: DataFrame) -> DataFrame:
    return stored(docs.mapInArrow(_score(fit(docs, once=True)), f"doc_id long, lang string, text string, {BASE}, score long").withColumn("_text", F.xxhash64("text")).drop("text"), "scored")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with the columns they came with."""
    return judged(scored(docs, once=True)).where("kept").select(*docs.columns)
