"""Spelling variants: words one edit apart, found by a join of asymmetric q-chunks, and the usual form of each rare one.

Words are counted by every task and summed by Spark. Of two words the longer (of equally long ones the smaller) gives
chunks, the other positional grams. A word of length L gives its two disjoint halves: one edit leaves a half intact, and
the other word holds that half at the same place or, behind the edit, shifted by the difference of the lengths, which is
one at most; of its positional grams these are the only ones written. Half a word is shared by too many words to be a key
alone (a common ending would pair all words that have it), so the same argument is applied to the half that holds the
edit: it is cut into two disjoint chunks, of which one is intact. A key is thus a half and a chunk of the other half, so
at least two thirds of a word's letters, and joins words that differ within a quarter; it only proposes pairs,
Levenshtein's distance decides.

A word's form is its near word with the largest count (ties: the smallest in code-point order) if that is at least `factor` times
its own count. Forms grow by that factor at each step, so chains are short; roots are found by doubling.

Null texts have no words; a null doc_id is written as nothing in front of the colon of the misspelling rule. Texts are cut into
stretches of STRETCH characters between words, so a text of any length takes bounded memory. Repeated rows count again.
Empty tables give no rows. Columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm import words
from lineweave.llm.shared import dropped, scratch, stored

#: Shortest word in code points, least count of a word, least ratio of the counts of a form and its variant.
SHORTEST, LEAST, FACTOR = 6, 5, 5
#: One occurrence in so many is misspelt, to have variants to group.
MISSPELT = 199
#: Characters of a text that are split into words at a time, and words a task counts before it hands them on.
STRETCH, HELD = 1 << 20, 300_000

_LETTER = "[a-zÀ-ÿ]"
_RUN = re.compile(f"{_LETTER}+")


def _stretches(text: str) -> Iterator[str]:
    """The text with A-Z in lower case, cut between words."""
    text, at = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text) and (inside := _RUN.match(text, end)):
            end = inside.end()
        yield text[at:end]
        at = end


def counted(docs: DataFrame, shortest: int = SHORTEST, misspelt: int = MISSPELT) -> DataFrame:
    """(word, n) of all words of docs (doc_id, text) with at least `shortest` code points."""
    long_run = re.compile(f"{_LETTER}{{{shortest},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in words.pieces(batches):
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for part in _stretches(text.as_py() or ""):
                    for word, n in Counter(long_run.findall(part)).items():
                        h = zlib.crc32(word.encode(), seed)
                        if h % misspelt == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < shortest:
                                continue
                        total[word] += n
                    if len(total) >= HELD:
                        yield _counts(total)
                        total.clear()
        yield _counts(total)

    parts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _counts(total: Counter[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])


def _keys(word: Column, size: Column) -> Column:
    """The four keys of a word as one of `size` letters: its halves, each with a chunk of the other half."""
    half, rest = F.floor(size / 2), size - F.floor(size / 2)
    first = lambda n: F.left(word, n)
    last = lambda n: F.right(word, n)
    low, high = F.floor(half / 2), F.floor(rest / 2)
    parts = [(first(half), first(half + high)), (first(half), last(rest - high)), (last(rest), first(low)), (last(rest), last(size - low))]
    return F.array(*[F.xxhash64(size, F.lit(k), a, b) for k, (a, b) in enumerate(parts)])


def near_pairs(table: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) of every two words of table (word, n; words differ) that one edit makes equal, each pair once; a is the longer one."""
    size = F.length("word").cast("long")
    chunks = table.select(F.explode(_keys(F.col("word"), size)).alias("key"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    grams = table.select(F.explode(F.array(size, size + 1)).alias("size"), "word", "n").select(
        F.explode(_keys(F.col("word"), F.col("size"))).alias("key"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    found = chunks.join(grams, "key").where(
        ((F.length("a") > F.length("b")) | (F.col("a") < F.col("b"))) & (F.abs(F.length("a") - F.length("b")) <= 1)
        & (F.levenshtein("a", "b", 1) == 1))
    return found.select("a", "a_n", "b", "b_n").distinct()


def variants(table: DataFrame, factor: int = FACTOR) -> DataFrame:
    """Each word of table (word, n) with form, root, n, n_near and form_n."""
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                             F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("e")
    best = near_pairs(table).select(both).select("e.*").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    form = F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best.near"))
    found = stored(table.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"),
                                                           F.when(form.isNotNull(), -F.col("best.less")).alias("form_n")), "forms")
    steps = stored(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:  # each round doubles the steps that a root is away
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(steps)
        if new.where("moved").isEmpty():
            break
        steps = new.drop("moved")
    return found.join(new.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents, with one occurrence in MISSPELT misspelt."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):
        table = stored(counted(docs).where(F.col("n") >= LEAST), "words")
        return stored(variants(table), "variants", keep=True)
