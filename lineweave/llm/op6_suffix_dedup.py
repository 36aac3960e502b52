"""Substring dedup over bytes: a distributed merge sort of suffixes that keeps track of common prefixes.

Every byte that lies in a string of LENGTH bytes which also starts elsewhere (in any document) is removed. A suffix matters
by its first LENGTH bytes only, its window.

1. Anchors. In every window the least hash of its GRAM-byte strings is its anchor; equal windows have their anchors at the same
   place. Windows with one anchor are consecutive. Hashes that occur once in all texts rule out their windows.
2. Stretches. The windows of one anchor make a stretch of LENGTH to 2 * LENGTH - GRAM bytes. Equal stretches are counted
   by a 128-bit key before anything else: all windows of a stretch that occurs twice are repeated. This settles exact copies
   without sorting them, however many there are.
3. Suffixes. Only stretches that occur once, but whose anchor occurs in other stretches too, are open. Their windows, and those of
   the other stretches with these anchors, are sorted, but for windows whose hash occurs once among them: tasks sort runs, front-code them, cut them at common splitters and
   exchange the parts; each range is merged by a loser tree that never compares a known common prefix again. A window that
   shares all LENGTH bytes with its neighbour is repeated. Equal windows of a run are exchanged once.

Null texts count as empty. Texts shorter than LENGTH have no window. Every row is a document: repeated rows are copies of each other,
and null ids are documents as others. Long texts are read in blocks that overlap by a window. Columns of the input named
like those of the result are not used.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm import front_coding, sets, words
from lineweave.llm.op2_line_dedup import document_key
from lineweave.llm.shared import dropped, scratch, stored

LENGTH, GRAM = 200, 150
#: Windows of a text that are hashed at once; suffixes of a run and (about) of a range; strings from which splitters come, per range.
BLOCK, RUN_SUFFIXES, RANGE_SUFFIXES, SAMPLES = 1 << 18, 40_000, 80_000, 40

_SPREAD = LENGTH - GRAM + 1
_PLACE = np.uint64((1 << 20) - 1)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first window, last window) of each stretch of a block of bytes."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down = words.powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    grams = words.mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    # the place in the low bits makes the first of equal hashes the least
    order = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    full = -(-len(order) // _SPREAD) * _SPREAD
    table = np.full(full, ~np.uint64(0))
    table[: len(order)] = order
    table = table.reshape(-1, _SPREAD)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[:n], ahead[_SPREAD - 1 : _SPREAD - 1 + n]) & _PLACE).astype(np.int64)
    low = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    return grams[place[low]], low, np.append(low[1:], n) - 1


def stretches(text: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(offset, anchor hashes, first and last windows) of each block of a text."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(0, len(data) - LENGTH + 1), BLOCK):
        yield at, *anchors(data[at : at + BLOCK + LENGTH - 1])


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"].to_pylist()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.pieces(batches, 512):
        found = [h for text in _bytes(batch) for _, h, _, _ in stretches(text)]
        if found:
            hashes, n = np.unique(np.concatenate(found).view(np.int64), return_counts=True)
            yield pa.record_batch([pa.array(hashes), pa.array(n)], ["anchor", "n"])


STRETCH = "doc struct<known: boolean, id: bigint, h: bigint>, anchor long, key binary, low long, high long"


def _stretch_rows(docs: DataFrame, repeated: np.ndarray) -> DataFrame:
    """The stretches whose anchors may be in the bitmap, with a key of their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches):
            row, anchor, key, low, high = [], [], [], [], []
            for r, text in enumerate(_bytes(batch)):
                for at, h, lo, hi in stretches(text):
                    for i in np.flatnonzero(sets.in_bitmap(repeated, h.view(np.int64))).tolist():
                        a, b = at + int(lo[i]), at + int(hi[i])
                        row.append(r)
                        anchor.append(h[i])
                        key.append(xxhash.xxh3_128_digest(text[a : b + LENGTH]))
                        low.append(a)
                        high.append(b)
            if row:
                yield pa.record_batch([batch["doc"].take(pa.array(row)), pa.array(np.array(anchor, np.uint64).view(np.int64)), pa.array(key, pa.binary()),
                                       pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["doc", "anchor", "key", "low", "high"])
    return docs.select(document_key().alias("doc"), "text").mapInArrow(run, STRETCH)


def _stretch_bytes(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(key, bytes) of the stretches whose anchors may be in the bitmap, once each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches, 1024):
            found = {}
            for text in _bytes(batch):
                for at, h, lo, hi in stretches(text):
                    for i in np.flatnonzero(sets.in_bitmap(wanted, h.view(np.int64))).tolist():
                        own = text[at + int(lo[i]) : at + int(hi[i]) + LENGTH]
                        found[xxhash.xxh3_128_digest(own)] = own
            if found:
                yield pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["key", "data"])
    return docs.select("text").mapInArrow(run, "key binary, data binary").groupBy("key").agg(F.first("data").alias("data"))


# --- the sort

PART = "range int, common binary, rest binary, ids binary, places binary, many binary"


def _sorted_run(found: list[tuple[int, bytes, bool, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chosen windows of the stretches in order, with stretch, place, and whether the stretch occurs twice."""
    rows = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), LENGTH)[at] for _, data, _, at in found]
    sizes = list(map(len, rows))
    table = np.ascontiguousarray(np.concatenate(rows))
    order = np.argsort(table.view(f"S{LENGTH}").ravel(), kind="stable")
    ids = np.repeat(np.array([f[0] for f in found], np.int64), sizes)
    places = np.concatenate([f[3] for f in found])
    many = np.repeat(np.array([f[2] for f in found], bool), sizes)
    return table[order], ids[order], places[order].astype(np.int64), many[order]


def _window_hashes(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of the stretches one after the other, and the number of windows of each."""
    flat = np.frombuffer(b"".join(datas), np.uint8)
    sizes = np.fromiter(map(len, datas), np.int64, len(datas))
    n = sizes - LENGTH + 1
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(sizes) - sizes, n)
    up, down = words.powers(len(flat))
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return words.mixed((sums[at + LENGTH] - sums[at]) * down[at]).view(np.int64), n


def _count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.pieces(batches, 4096):
        hashes, n = np.unique(_window_hashes(batch["data"].to_pylist())[0], return_counts=True)
        yield pa.record_batch([pa.array(hashes), pa.array(n)], ["h", "n"])


def _runs(splitters: list[bytes], repeated: np.ndarray):
    """Sorts runs of those windows whose hash may be in the bitmap; equal windows of a run become one (`many`), and their places are given out at once (range -1)."""
    edges = np.array(splitters, f"S{LENGTH}")

    def one(found: list[tuple[int, bytes, bool, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        table, ids, places, many = _sorted_run(found)
        new = np.concatenate([[True], (table[1:] != table[:-1]).any(axis=1)])
        group = np.cumsum(new) - 1
        shared = (np.bincount(group) > 1)[group]
        group_many = np.zeros(group[-1] + 1, bool)
        np.logical_or.at(group_many, group, many | shared)
        told = shared | (group_many[group] & ~many)
        if told.any():
            yield _part(-1, np.zeros(0, np.uint16), b"", ids[told], places[told], many[told])
        table, ids, places = table[new], ids[new], places[new]
        at = np.searchsorted(edges, np.ascontiguousarray(table).view(f"S{LENGTH}").ravel(), "right")
        for r in np.unique(at).tolist():
            mine = at == r
            yield _part(r, *front_coding.coded(table[mine]), ids[mine], places[mine], group_many[mine])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in words.pieces(batches, 4096):
            datas = batch["data"].to_pylist()
            hashes, sizes = _window_hashes(datas)
            hit = sets.in_bitmap(repeated, hashes)
            for i, data, many, own in zip(batch["id"].to_pylist(), datas, batch["many"].to_pylist(), np.split(hit, np.cumsum(sizes)[:-1])):
                at = np.flatnonzero(own)
                if len(at):
                    found.append((i, data, many, at))
                    n += len(at)
                if n >= RUN_SUFFIXES:
                    yield from one(found)
                    found, n = [], 0
        if found:
            yield from one(found)
    return run


def _part(r: int, common: np.ndarray, rest: bytes, ids: np.ndarray, places: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r], pa.int32()), *(pa.array([x], pa.binary()) for x in (
        common.tobytes(), rest, ids.tobytes(), places.astype(np.uint16).tobytes(), many.tobytes()))], ["range", "common", "rest", "ids", "places", "many"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions hold whole ranges in order; the places of windows that have an equal one."""
    held, current = [], None

    def close() -> Iterator[pa.RecordBatch]:
        runs = [front_coding.Run(np.frombuffer(p["common"], np.uint16), p["rest"], LENGTH) for p in held]
        ids = [np.frombuffer(p["ids"], np.int64) for p in held]
        places = [np.frombuffer(p["places"], np.uint16) for p in held]
        many = [np.frombuffer(p["many"], bool) for p in held]
        out, group = [], []

        def settle() -> None:
            if len(group) > 1 or many[group[0][0]][group[0][1]]:
                out.extend(group)
        for r, i, share in front_coding.merged(runs):
            if share < LENGTH and group:
                settle()
                group = []
            group.append((r, i))
        if group:
            settle()
        if out:
            yield pa.record_batch([pa.array([int(ids[r][i]) for r, i in out], pa.int64()), pa.array([int(places[r][i]) for r, i in out], pa.int64())], ["id", "place"])

    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            if row["range"] != current:
                if held:
                    yield from close()
                held, current = [], row["range"]
            held.append(row)
    if held:
        yield from close()


def repeated_places(open_: DataFrame) -> DataFrame:
    """(id, place) of the windows that repeat among stretches open_ (id, data, many)."""
    twice = stored(open_.select("data").mapInArrow(_count_windows, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "windows-twice")
    total = twice.agg(F.count("*"), F.sum("n")).first()
    ranges = 1 + (total[1] or 0) // RANGE_SUFFIXES
    repeated = sets.bitmap(twice, "h", total[0])
    dropped(twice)
    count = max(1, open_.count())
    # splitters only balance the ranges: a sample of about SAMPLES strings for each
    sample = open_.sample(min(1.0, SAMPLES * ranges / count), seed=1).select(F.substring("data", 1, LENGTH).alias("s")).collect() if ranges > 1 else []
    sample = sorted(bytes(r["s"]) for r in sample)
    splitters = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []
    parts = stored(open_.mapInArrow(_runs(splitters, repeated), PART), "suffix-runs")
    merged = parts.where("range >= 0").repartition(min(ranges, 4000), "range").sortWithinPartitions("range").mapInArrow(_merge, "id long, place long")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, places in zip(batch["ids"].to_pylist(), batch["places"].to_pylist()):
                yield pa.record_batch([pa.array(np.frombuffer(ids, np.int64)), pa.array(np.frombuffer(places, np.uint16).astype(np.int64))], ["id", "place"])
    return merged.unionByName(parts.where("range < 0").select("ids", "places").mapInArrow(unpack, "id long, place long"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc, low, high): ranges of starts of repeated windows."""
    counts = stored(docs.select("text").mapInArrow(_count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "anchors")
    rows = stored(_stretch_rows(docs, sets.bitmap(counts, "anchor", counts.count())), "stretches")
    dropped(counts)
    kinds = stored(rows.groupBy("anchor", "key").agg(F.count("*").alias("n")), "kinds")
    settled = rows.join(kinds.where("n > 1").select("anchor", "key"), ["anchor", "key"], "left_semi")
    settled = stored(settled.groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("windows")).mapInArrow(
        _joined, "doc struct<known: boolean, id: bigint, h: bigint>, low long, high long"), "settled")
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("anchor")
    open_kinds = stored(kinds.join(mixed, "anchor").select("anchor", "key", (F.col("n") > 1).alias("many")), "open")
    single = open_kinds.where("not many").select("anchor", "key")
    rows_open = stored(rows.join(single, ["anchor", "key"], "left_semi").select("doc", "key", "low"), "open-rows")
    # what is settled needs no more of the many stretches: they go before the sort takes its room
    dropped(rows)
    dropped(kinds)

    wanted = sets.bitmap(open_kinds.select("anchor").distinct(), "anchor", open_kinds.count())
    data = _stretch_bytes(docs, wanted)
    open_ = stored(open_kinds.select("key", "many").groupBy("key").agg(F.max("many").alias("many")).join(data, "key").withColumn("id", F.monotonically_increasing_id()), "open-bytes")
    places = repeated_places(open_.select("id", "data", "many"))
    found = places.join(open_.where("not many").select("id", "key"), "id").select("key", "place")
    start = F.col("low") + F.col("place")
    sorted_ = rows_open.join(found, "key").select("doc", start.alias("low"), start.alias("high"))
    return settled.unionByName(sorted_)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of starts of each document, those that touch as one."""
    for batch in batches:
        row, low, high = [], [], []
        for r, windows in enumerate(batch["windows"].to_pylist()):
            for a, b in sorted((w["low"], w["high"]) for w in windows):
                if row and row[-1] == r and a <= high[-1] + 1:
                    high[-1] = max(high[-1], b)
                else:
                    row.append(r)
                    low.append(a)
                    high.append(b)
        if row:
            yield pa.record_batch([batch["doc"].take(pa.array(row)), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["doc", "low", "high"])


def spans(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes under the windows whose starts lie in the ranges."""
    out: list[list[int]] = []
    for low, high in sorted(windows):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high + LENGTH)
        else:
            out.append([low, high + LENGTH])
    return [(a, b) for a, b in out]


def windows_of(docs: DataFrame) -> DataFrame:
    """(doc, windows): the ranges of repeated windows of each document that has any; a document has no more than its bytes."""
    with scratch(docs.sparkSession):
        return stored(repeated_windows(docs).groupBy("doc").agg(F.collect_set(F.struct("low", "high")).alias("windows")), "windows", keep=True)


def cut(docs: DataFrame, digests: bool = False) -> DataFrame:
    """docs with removed_spans and kept_bytes; with `digests`, n_bytes, n_removed, n_spans and kept_sha256 instead."""
    new = (["n_bytes", "n_removed", "n_spans", "kept_sha256"] if digests else ["removed_spans", "kept_bytes"])
    docs = docs.drop(*new)
    names = docs.columns
    rows = words.packed(docs.withColumn("_doc", document_key()), "text").join(windows_of(docs).withColumnRenamed("doc", "_doc"), "_doc", "left").drop("_doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches):
            out = defaultdict(list)
            batch = words.unpacked(batch, "text")
            for text, windows in zip(_bytes(batch), batch["windows"].to_pylist()):
                gone = spans([(w["low"], w["high"]) for w in windows or []])
                edges = [0, *(x for span in gone for x in span), len(text)]
                kept = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])
                values = ((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()) if digests
                          else ([{"low": a, "high": b} for a, b in gone], kept))
                for n, v in zip(new, values):
                    out[n].append(v)
            kinds = ([pa.int64(), pa.int64(), pa.int64(), pa.string()] if digests
                     else [pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])), pa.binary()])
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), *(pa.array(out[n], k) for n, k in zip(new, kinds))], [*names, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    kinds = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digests else "removed_spans array<struct<low: bigint, high: bigint>>, kept_bytes binary"
    return rows.mapInArrow(run, f"{fields}, {kinds}")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document, and a digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cut(docs, digests=True).drop("text")
