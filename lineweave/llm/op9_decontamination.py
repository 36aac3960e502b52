"""Benchmark decontamination by greedy string tiling.

Texts are sequences of words in normal form: case-folded, without marks at their ends; words of marks only are dropped.
The runs of MIN_MATCH words of all benchmark items lie in a sorted hash array that tasks map, and the runs of each document
are looked up in it: an item is compared with a document only where the runs they share cover enough of the item, which
tiles can never exceed. The comparison is running Karp-Rabin greedy string tiling: for falling lengths s, windows of s words
that lie in no tile are found by rolling hash, checked word by word and extended; the longest are marked first. Tiles don't
overlap and need not be in order, so a passage whose sentences were moved is found too. A document is contaminated by an
item when tiles cover at least COVERAGE of the item's words.

No row is shuffled: a passage in a third of all documents, or an item of many copies, makes no hot key. Items of fewer than
MIN_MATCH words are no evidence and match nothing, as do null and empty texts. Equal rows of benchmark count once.
Columns of documents named `matches` are replaced. Repeated documents give repeated rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm import hash_arrays, words
from lineweave.llm.shared import stored

#: Words of the shortest tile, and the share of an item's words that tiles must cover.
MIN_MATCH, COVERAGE = 4, 0.6

MATCH = pa.struct([("item_id", pa.int64()), ("n_item_words", pa.int64()), ("n_covered", pa.int64()), ("n_tiles", pa.int64()), ("longest_tile", pa.int64())])


def _normal(word: str) -> str:
    form = word.casefold()
    if form.isalnum():
        return form
    keep = [i for i, c in enumerate(form) if c.isalnum()]
    return form[keep[0] : keep[-1] + 1] if keep else ""


_hashes = words.WordHashes(_normal)


def tokens(text: str | None) -> np.ndarray:
    found = _hashes.of(words.WORD.findall(text or ""))
    return found[found != 0]


# --- tiling

def _windows(items: np.ndarray, free: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows of `size` places that are all free."""
    if len(items) < size:
        return np.zeros(0, np.int64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(taken[size:] == taken[:-size])


def _matches(item: np.ndarray, doc: np.ndarray, in_item: np.ndarray, in_doc: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(length, place in item, place in document) of the longest free common runs of at least `size` words."""
    i_at, d_at = _windows(item, in_item, size), _windows(doc, in_doc, size)
    if not len(i_at) or not len(d_at):
        return []
    i_hash, d_hash = words.window_hashes(item, size)[i_at], words.window_hashes(doc, size)[d_at]
    order = np.argsort(i_hash, kind="stable")
    low, high = np.searchsorted(i_hash[order], d_hash, "left"), np.searchsorted(i_hash[order], d_hash, "right")
    found = []
    for k in np.flatnonzero(high > low):
        j = int(d_at[k])
        for i in i_at[order[low[k] : high[k]]].tolist():
            if i and j and in_item[i - 1] and in_doc[j - 1] and item[i - 1] == doc[j - 1]:
                continue  # part of the run that starts before it
            n = 0
            while i + n < len(item) and j + n < len(doc) and in_item[i + n] and in_doc[j + n] and item[i + n] == doc[j + n]:
                n += 1
            if n >= size:
                found.append((n, i, j))
    return found


def tiles(item: np.ndarray, doc: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in document, length), longest first."""
    in_item, in_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    out, size = [], max(least, len(item))
    while True:
        found = sorted(_matches(item, doc, in_item, in_doc, size), key=lambda m: (-m[0], m[1], m[2]))
        blocked = False
        longest = found[0][0] if found else 0
        for n, i, j in found:
            if n < longest and blocked:
                break  # a cut match may now be longer than this one: look again
            if in_item[i : i + n].all() and in_doc[j : j + n].all():
                in_item[i : i + n] = in_doc[j : j + n] = False
                out.append((i, j, n))
            else:
                blocked = True
        if blocked:
            continue
        if size == least:
            return out
        size = max(least, size // 2)


# --- the benchmark as arrays

class Benchmark:
    """Items (item_id, text) as a hash array of their runs and one of their words."""

    def __init__(self, items: DataFrame, least: int = MIN_MATCH):
        known = stored(items.select("item_id", "text").where("text is not null").distinct(), "benchmark")
        known = known.withColumn("item", F.monotonically_increasing_id())

        def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = ["" if i is None else str(i) for i in batch["item_id"].to_pylist()]
                yield pa.record_batch([batch["item"], pa.array(ids), pa.array([tokens(t).tobytes() for t in batch["text"].to_pylist()], pa.binary())],
                                      ["key", "item_id", "words"])

        def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist()):
                    runs = words.window_hashes(tokens(text), least).view(np.int64)
                    if len(runs):
                        yield pa.record_batch([pa.array(runs), pa.array(np.full(len(runs), item)), pa.array(np.arange(len(runs)))], ["key", "item", "at"])

        self.items = hash_arrays.build(known.mapInArrow(words_of, "key long, item_id string, words binary"))
        self.runs = hash_arrays.build(known.mapInArrow(runs_of, "key long, item long, at long"))
        self.least = least


def _matched(doc: np.ndarray, runs: hash_arrays.Arrays, items: hash_arrays.Arrays, least: int, coverage: float) -> list[dict]:
    shared = np.unique(words.window_hashes(doc, least).view(np.int64))
    at, found = runs.first(shared)
    places = defaultdict(set)
    for i in at[found].tolist():
        key = runs.keys[i]
        while i < len(runs.keys) and runs.keys[i] == key:
            places[int(runs.columns["item"][i])].update(range(int(runs.columns["at"][i]), int(runs.columns["at"][i]) + least))
            i += 1
    out = []
    for item, covered in sorted(places.items()):
        place = int(items.first(np.array([item]))[0][0])
        own = np.frombuffer(items.bytes_at("words", place), np.uint64)
        if len(covered) < coverage * len(own):
            continue
        found_tiles = tiles(own, doc, least)
        n = sum(t[2] for t in found_tiles)
        if n >= coverage * len(own):
            item_id = items.bytes_at("item_id", place).decode()
            out.append({"item_id": int(item_id) if item_id else None, "n_item_words": len(own), "n_covered": n,
                        "n_tiles": len(found_tiles), "longest_tile": max(t[2] for t in found_tiles)})
    return out


def matched(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """docs with `matches`: the items that contaminate each, with words covered and tiles."""
    known, docs = Benchmark(benchmark, least), docs.drop("matches")
    names = docs.columns
    runs_at, items_at = known.runs, known.items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, items = runs_at.open(), items_at.open()
        for batch in words.pieces(batches):
            found = [_matched(tokens(t), runs, items, least, coverage) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(found, pa.list_(MATCH))], [*names, "matches"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, fields + ", matches array<struct<item_id: bigint, n_item_words: bigint, n_covered: bigint, n_tiles: bigint, longest_tile: bigint>>")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that contaminates it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = matched(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.inline("matches"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    found = matched(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("matches") == 0).select(*docs.columns)
