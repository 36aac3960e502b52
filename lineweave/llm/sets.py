"""Helpers of the set-similarity operators: rarity of hashed tokens, and bitmaps of keys that tasks test rows against.

Both are of a fixed size that the caller can name, whatever the input is; neither decides a result. The rarity of a token
fixes the order in which a set lists its tokens, and any fixed order gives the same pairs. A bitmap only keeps rows out of a
shuffle that a join would drop."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.llm import words
from lineweave.llm.shared import dropped, stored

#: Bits of a token's hash that name its cell, and cells of a block of the sketch.
CELL_BITS, BLOCK = 22, 1 << 14
#: Tokens that a task collects before it adds them to its cells.
HELD_CELLS = 1 << 20


def rarity(docs: DataFrame, hashes: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """Level of each of 2 ** CELL_BITS cells: 0 for rare tokens, more the more often the cell's tokens occur.

    Every task counts all tokens of its texts by cell; blocks of cells are summed over the tasks. The driver receives the
    sums, which have one size whatever the input is. A cell is rare up to what chance puts into it when tokens are
    dealt evenly (the mean and four standard deviations)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, found, held, any_ = np.zeros(1 << CELL_BITS, np.int64), [], 0, False
        for batch in words.pieces(batches):
            found.append((hashes(batch["text"]) >> np.uint64(64 - CELL_BITS)).astype(np.uint32))
            held += len(found[-1])
            if held >= HELD_CELLS:
                cells += np.bincount(np.concatenate(found), minlength=1 << CELL_BITS)
                any_, found, held = True, [], 0
        if held:
            cells += np.bincount(np.concatenate(found), minlength=1 << CELL_BITS)
        if any_ or held:
            cells = cells.astype(np.uint32)
            for b in range(0, 1 << CELL_BITS, BLOCK):
                yield pa.record_batch([pa.array([b // BLOCK], pa.int32()), pa.array([cells[b : b + BLOCK].tobytes()], pa.binary())], ["block", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, cells in zip(batch["block"].to_pylist(), batch["cells"]):
                own = np.frombuffer(cells.as_buffer(), np.uint32)
                sums[b] = sums[b] + own if b in sums else own.astype(np.int64)
        for b, own in sums.items():
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["block", "cells"])

    parts = docs.select("text").mapInArrow(count, "block int, cells binary")
    # one partition holds few blocks of fixed size
    sums = parts.repartition((1 << CELL_BITS) // BLOCK // 8, "block").mapInArrow(add, "block int, cells binary").toArrow()
    cells = np.zeros(1 << CELL_BITS, np.int64)
    for b, own in zip(sums["block"].to_pylist(), sums["cells"].to_pylist()):
        cells[b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(own, np.int64)
    mean = cells.mean()
    levels = np.ceil(np.log2(np.maximum(cells, 1))).astype(np.uint8)
    levels[cells <= mean + 4 * np.sqrt(mean) + 4] = 0
    return levels


def ranked(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Hashes as numbers that sort from rare to frequent: the level of the cell, then 56 bits of the hash."""
    cells = (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)
    return (levels[cells].astype(np.uint64) << np.uint64(56)) | (words.mixed(hashes) >> np.uint64(8))


def bitmap(keys: DataFrame, key: str, count: int, most_bits: int = 26) -> np.ndarray:
    """Bits of the keys (bigint); about 16 for each of `count` keys, 2 ** most_bits at most. Bits are set by an aggregation of 64 at
    a time, so the driver receives the map, not the keys."""
    bits = max(10, min(most_bits, int(16 * max(1, count)).bit_length()))
    at = F.pmod(F.col(key), F.lit(1 << bits))
    parts = keys.select((at / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))").alias("bit"))
    out = np.zeros(1 << (bits - 6), np.int64)
    found = parts.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out[found["word"].to_numpy()] = found["bit"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the map."""
    at = keys.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def number(key: str) -> Column:
    """The first 8 bytes of a binary key as the bigint whose bytes, lowest first, they are."""
    hexed = F.hex(key)
    swapped = F.concat(*[F.substring(hexed, 1 + 2 * i, 2) for i in range(7, -1, -1)])
    high = F.conv(F.substring(swapped, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(swapped, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge table (a, b): root is the smallest node it is linked with.

    Each round joins every node with the smallest neighbour and lets it take over that neighbour's root, so chains
    shrink by half or more; rounds are written to the shared folder."""
    links = stored(edges.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
                   .select("e.*").distinct(), "links")
    roots = stored(links.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "roots")
    while True:
        # the smallest root among neighbours; then the root of that root
        near = links.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        hop = roots.select(F.col("node").alias("low"), F.col("root").alias("next"))
        new = stored(step.join(hop, "low", "left").select("node", F.col("root").alias("old"), F.least("low", F.coalesce("next", "low")).alias("root")), "roots")
        dropped(roots)
        if new.where("old <> root").isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")
