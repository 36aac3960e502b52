"""Substring dedup by sliding sentence spans.

A text is cut after `.`, `!` or `?` with white space behind, and after line ends; parts without words belong to the sentence
before. A span grows until it is long enough: from every sentence on, and up to every sentence, the shortest run with MIN_WORDS words or
more is one, in lower case and with single blanks; a long sentence is one alone. So every sentence of a repeated passage of MIN_WORDS
words lies in a span inside the passage, whatever the length of its sentences. A text of fewer words is one span. The first
place of a span (by doc_id, then sentence number) stays; every sentence that another place of it covers is removed.

A first pass counts 64-bit hashes of all spans; a second pass keeps the spans whose hash is counted twice (by a bitmap, which
only lets too many through) under 128-bit keys, and these are joined with their first place. A span in a third of all documents
is summed before it is shuffled, and its rows meet one row per span.

Null and empty texts have no sentences. Documents are told apart by doc_id and text; repeated rows are one document and get the same
result; null ids come first. Columns of the input named like those of the result are not used.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm import sets, words
from lineweave.llm.op2_line_dedup import document_key
from lineweave.llm.shared import dropped, scratch, stored

#: Least number of sentences of a span, and the words at which it stops growing.
RUN, MIN_WORDS = 1, 12

_END = re.compile(r"[.!?]+[\x20\x09-\x0D]+|\n+")


def sentences(text: str | None) -> list[str]:
    """The text in parts, white space behind them included."""
    out, at = [], 0
    for m in [*_END.finditer(text or ""), None]:
        end = m.end() if m else len(text or "")
        if end > at:
            part = text[at:end]
            if out and not part.strip():
                out[-1] += part
            else:
                out.append(part)
            at = end
    return out


def grown(text: str | None) -> Iterator[tuple[int, int, bytes]]:
    """Number of the first sentence, number of sentences and normal form of every span."""
    forms = [" ".join(s.lower().split()) for s in sentences(text)]
    if forms and not forms[0]:  # blanks before the first word are no sentence of a span
        first, forms = 1, forms[1:]
    else:
        first = 0
    if not forms:
        return
    upto = [0, *accumulate(f.count(" ") + 1 for f in forms)]
    last = len(forms)
    if upto[last] < MIN_WORDS:
        found = {(0, last)}
    else:
        found, start, end = set(), 0, 0
        for i in range(last):  # shortest run from i on
            while end < last and (end - i < RUN or upto[end] - upto[i] < MIN_WORDS):
                end += 1
            if end - i < RUN or upto[end] - upto[i] < MIN_WORDS:
                break
            found.add((i, end))
        for end in range(RUN, last + 1):  # shortest run up to end
            while start + RUN < end and upto[end] - upto[start + 1] >= MIN_WORDS:
                start += 1
            if upto[end] - upto[start] >= MIN_WORDS:
                found.add((start, end))
    for i, end in sorted(found):
        yield first + i, end - i, "\n".join(forms[i:end]).encode("utf-8", "surrogatepass")


def spans(text: str | None) -> Iterator[tuple[int, bytes]]:
    """Every sentence of every span: its number, and the normal form of the span with the place of the sentence in it."""
    for i, n, form in grown(text):
        for k in range(n):
            yield i + k, b"%d\n" % k + form


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.pieces(batches, 1024):
        seen = Counter(xxhash.xxh3_64_intdigest(form) - (1 << 63) for t in batch["text"].to_pylist() if t for _, _, form in grown(t))
        if seen:
            yield pa.record_batch([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["h", "n"])


def _places(docs: DataFrame, repeated: np.ndarray) -> DataFrame:
    """doc, doc_id, n_sentences, and those spans whose hash may be in the bitmap."""
    kind = pa.list_(pa.struct([("key", pa.binary()), ("at", pa.int32()), ("size", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches):
            n, found = [], []
            for text in batch["text"].to_pylist():
                all_ = list(grown(text))
                hashes = np.array([xxhash.xxh3_64_intdigest(form) - (1 << 63) for _, _, form in all_], np.int64)
                hit = np.flatnonzero(sets.in_bitmap(repeated, hashes)) if len(all_) else []
                found.append([{"key": xxhash.xxh3_128_digest(all_[i][2]), "at": all_[i][0], "size": all_[i][1]} for i in hit])
                n.append(len(sentences(text)))
            yield pa.record_batch([batch["doc"], batch["doc_id"], pa.array(n, pa.int64()), pa.array(found, kind)], ["doc", "doc_id", "n_sentences", "spans"])

    doc = "struct<known: boolean, id: bigint, h: bigint>"
    return docs.select(document_key().alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, f"doc {doc}, doc_id long, n_sentences long, spans array<struct<key: binary, at: int, size: int>>")


def covered(docs: DataFrame) -> DataFrame:
    """doc, doc_id, n_sentences and removed, the numbers of the sentences to remove; one row per row of docs."""
    with scratch(docs.sparkSession):
        counts = stored(docs.select("text").mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "spans")
        repeated = sets.bitmap(counts, "h", counts.count())
        dropped(counts)
        places = stored(_places(docs, repeated), "places")
        held = places.select("doc", F.inline("spans")).distinct()
        firsts = held.groupBy("key").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        again = held.join(firsts, "key").where("struct(doc, at) <> first")
        gone = again.select("doc", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("i")).groupBy("doc").agg(
            F.sort_array(F.collect_set("i")).alias("removed"))
        whole = places.drop("spans").join(gone, "doc", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
        return stored(whole, "removed", keep=True)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the covered sentences; other columns stay as they are."""
    @F.pandas_udf("string")
    def kept(text, removed):
        return text.combine(removed, lambda t, r: t if r is None or not len(r) else "".join(
            s for i, s in enumerate(sentences(t)) if i not in set(r.tolist())))

    gone = covered(docs).select(F.col("doc").alias("_doc"), "removed").where("size(removed) > 0").dropDuplicates(["_doc"])
    rows = docs.withColumn("_doc", document_key()).join(gone, "_doc", "left")
    return rows.withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept("text", "removed"))).select(*docs.columns)


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its number of sentences, of removed sentences, and their numbers, joined by commas."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return covered(docs).select("doc_id", "n_sentences", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed_sentences"))
