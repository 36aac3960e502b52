"""Words, their hashes, and windows of words, as the text operators use them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

#: White space is the blank and U+0009 to U+000D only.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The letters A to Z, for lower-casing only these.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of each 64-bit number over all others."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(items: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of `size` consecutive numbers, order counts."""
    n = len(items) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = mixed(items[:n] + np.uint64(size))
    for k in range(1, size):
        out = mixed(out * _M1 + items[k : k + n])
    return out


_FACTOR = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of an odd number modulo 2 ** 64, and of its inverse."""
    if len(_powers[0]) < n:
        for i, f in enumerate((_FACTOR, pow(_FACTOR, -1, 1 << 64))):
            x = np.full(1 << max(20, (n - 1).bit_length()), f, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += 32


#: Bytes of text that are hashed at once; a longer word is one block.
BLOCK = 1 << 17


def _blocks(word: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of about BLOCK bytes, none of which ends inside a word."""
    at, n = 0, len(word)
    while at < n:
        end = at + BLOCK
        while end < n:  # up to the next place where no word goes on
            free = np.flatnonzero(~word[end : end + 4096] | first[end : min(n, end + 4096)])
            if len(free):
                end += int(free[0])
                break
            end += 4096
        yield at, min(end, n)
        at = end


def flat_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts of a column one after the other: the hash of each word (A-Z in lower case), its row, and its line.

    Works on the bytes of the column, a block at a time: a word's hash is a difference of sums of powers, so no word becomes an object."""
    wide = pa.types.is_large_string(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[ends] = True  # a text begins here, or the last ends
    hashes, places = [], []
    for a, b in _blocks(word, first):
        own = word[a:b]
        starts = np.flatnonzero(own & (np.concatenate([[True], ~own[:-1]]) | first[a:b]))
        stops = np.flatnonzero(own & (np.concatenate([~own[1:], [True]]) | first[a + 1 : b + 1])) + 1
        up, down = powers(b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_LOWER[data[a:b]] * up, out=sums[1:])
        hashes.append(mixed((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64)))
        places.append(starts + a)
    starts, breaks = np.concatenate(places), np.flatnonzero(data == 10)
    rows = np.searchsorted(ends, starts, "right") - 1
    return np.concatenate(hashes), rows, np.searchsorted(breaks, starts) - np.searchsorted(breaks, ends[rows])


def distinct_in_groups(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of each group in order; groups are numbers under 2 ** 24 in rising order."""
    order = np.argsort(values)
    own = groups[order]
    # a stable sort of 16-bit numbers is a radix sort
    order = order[np.argsort(own.astype(np.uint16) if len(groups) and groups[-1] < 1 << 16 else own, kind="stable")]
    values, groups = values[order], groups[order]
    new = np.concatenate([[True], (values[1:] != values[:-1]) | (groups[1:] != groups[:-1])]) if len(values) else np.zeros(0, bool)
    return values[new], groups[new]


class WordHashes(dict):
    """word -> 64-bit hash of its normal form; 0 for words without one. Forgets all when full: memory stays bounded."""

    def __init__(self, normal: Callable[[str], str] = str, most: int = 400_000):
        super().__init__()
        self.normal, self.most = normal, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        form = self.normal(word)
        self[word] = found = (xxhash.xxh3_64_intdigest(form.encode("utf-8", "surrogatepass")) or 1) if form else 0
        return found

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of the texts and binaries of each row."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        kind = column.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
            ends = np.frombuffer(column.buffers()[1] or b"\0" * 8, np.int64 if wide else np.int32)
            size += np.diff(ends[column.offset : column.offset + len(column) + 1])
    return size


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches cut into short ones of at most `rows` rows and, but for single rows, `most` bytes of text, so that few long texts are in
    memory at once."""
    for batch in batches:
        ends = np.cumsum(_row_bytes(batch)) if batch.num_rows else np.zeros(0, np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, "right"))))
            yield batch.slice(at, stop - at)
            at = stop


def packed(rows: DataFrame, column: str) -> DataFrame:
    """rows with a text column as Zstandard frames, for a shuffle that has to carry it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches):
            data = [None if t is None else compressor.compress(t.encode("utf-8", "surrogatepass")) for t in batch[column].to_pylist()]
            yield batch.set_column(batch.schema.get_field_index(column), column, pa.array(data, pa.binary()))

    fields = ", ".join(f"`{f.name}` {'binary' if f.name == column else f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, fields)


def unpacked(batch: pa.RecordBatch, column: str) -> pa.RecordBatch:
    """The batch with the text of `packed`."""
    decompressor = zstandard.ZstdDecompressor()
    texts = [None if d is None else decompressor.decompress(d).decode("utf-8", "surrogatepass") for d in batch[column].to_pylist()]
    return batch.set_column(batch.schema.get_field_index(column), column, pa.array(texts, pa.string()))
