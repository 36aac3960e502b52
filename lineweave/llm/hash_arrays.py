"""Sorted arrays of 64-bit keys with value columns, memory-mapped by the tasks that probe them.

Spark sorts the rows by key over the whole cluster and writes them as Parquet to the shared folder; each executor fetches
the files once (`SparkContext.addFile`) and unpacks them to flat arrays in its own working folder. Tasks map these arrays:
the pages are shared by all workers of a machine and are not held in their heaps, so the size is bounded by disk.
"""

from __future__ import annotations

import os
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.shared import dropped, shared_path, stored

#: Rows of one sorted file.
FILE_ROWS = 4_000_000


class Arrays:
    """The mapped columns: numbers as arrays, text and bytes as an array of ends and the bytes."""

    def __init__(self, folder: str, columns: list[str]):
        self.columns = {}
        for c in columns:
            self.columns[c] = _mapped(f"{folder}/{c}.npy")
            if os.path.exists(f"{folder}/{c}.bytes.npy"):
                self.columns[c] = (self.columns[c], _mapped(f"{folder}/{c}.bytes.npy"))
        self.keys = self.columns["key"]
        self._starts = None

    def first(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key the place of its first row, and whether there is one."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == keys

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `first`, by way of an index on the leading bits; for keys that are even hashes and occur once."""
        if not len(self.keys):
            return self.first(keys)
        if self._starts is None:
            self._bits = max(1, int(len(self.keys)).bit_length() - 1)
            edges = (np.arange(1 << self._bits, dtype=np.int64) - (1 << (self._bits - 1))) << (64 - self._bits)
            self._starts = np.searchsorted(self.keys, edges).astype(np.int32 if len(self.keys) < 1 << 31 else np.int64)
        at = np.minimum(self._starts[(keys >> (64 - self._bits)) + (1 << (self._bits - 1))].astype(np.int64), len(self.keys) - 1)
        behind = np.flatnonzero(self.keys[at] < keys)
        while len(behind):
            behind = behind[at[behind] < len(self.keys) - 1]
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < keys[behind]]
        return at, self.keys[at] == keys

    def bytes_at(self, column: str, i: int) -> bytes:
        ends, data = self.columns[column]
        return data[ends[i - 1] if i else 0 : ends[i]].tobytes()


def _mapped(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r") if os.path.getsize(path) > 128 else np.load(path)


class HashArrays:
    """Handle that tasks carry; `open()` gives the mapped arrays."""

    def __init__(self, files: list[str], columns: list[str]):
        self.files, self.columns, self.name = files, columns, f"arrays-{uuid.uuid4().hex}"

    def open(self) -> Arrays:
        return _open(tuple(self.files), tuple(self.columns), self.name)


def build(rows: DataFrame) -> HashArrays:
    """rows: `key` (bigint, any number of rows per key) and value columns (bigint, float, double, string or binary, without nulls)."""
    spark = rows.sparkSession
    rows, path = stored(rows, "rows"), shared_path(spark, "arrays")
    n = 1 + rows.count() // FILE_ROWS
    rows.repartitionByRange(n, "key").sortWithinPartitions("key").write.parquet(path)
    dropped(rows)
    names = []
    for f in sorted(spark.read.schema(rows.schema).parquet(path).inputFiles()):
        spark.sparkContext.addFile(f)
        names.append(f.rsplit("/", 1)[1])
    return HashArrays(names, rows.columns)


@lru_cache(maxsize=4)
def _open(files: tuple[str, ...], columns: tuple[str, ...], name: str) -> Arrays:
    folder = os.path.join(SparkFiles.getRootDirectory(), name)
    if not os.path.isdir(folder):
        own = f"{folder}.{uuid.uuid4().hex}"
        os.makedirs(own)
        _unpack([SparkFiles.get(f) for f in files], columns, own)
        try:
            os.rename(own, folder)
        except OSError:  # another worker of this executor was first; both copies are equal
            folder = own
    return Arrays(folder, list(columns))


def _unpack(paths: list[str], columns: tuple[str, ...], folder: str) -> None:
    """One flat file per column. Files hold ranges of keys; they are put in order by their first key."""
    read = [pq.ParquetFile(p) for p in paths]
    first = lambda f: next(f.iter_batches(1, columns=["key"]))["key"][0].as_py()
    read = sorted((f for f in read if f.metadata.num_rows), key=first)
    rows = sum(f.metadata.num_rows for f in read)
    for c in columns:
        kind = read[0].schema_arrow.field(c).type if read else pa.int64()
        text = pa.types.is_string(kind) or pa.types.is_binary(kind)
        out = _array(f"{folder}/{c}.npy", kind.to_pandas_dtype() if pa.types.is_floating(kind) else np.int64, rows)
        at = size = 0
        for f in read:
            for batch in f.iter_batches(1 << 16, columns=[c]):
                col = batch[c]
                out[at : at + len(col)] = size + np.cumsum(_lengths(col)) if text else col.to_numpy(zero_copy_only=False)
                size = int(out[at + len(col) - 1]) if text and len(col) else size
                at += len(col)
        if text:
            data, at = _array(f"{folder}/{c}.bytes.npy", np.uint8, size), 0
            for f in read:
                for batch in f.iter_batches(1 << 16, columns=[c]):
                    piece = np.frombuffer(b"".join(x.encode() if isinstance(x, str) else x for x in batch[c].to_pylist()), np.uint8)
                    data[at : at + len(piece)] = piece
                    at += len(piece)


def _lengths(col: pa.Array) -> np.ndarray:
    return np.array([len(x.encode() if isinstance(x, str) else x) for x in col.to_pylist()], np.int64)


def _array(path: str, kind: type, rows: int) -> np.ndarray:
    if not rows:
        np.save(path, np.zeros(0, kind))
        return np.zeros(0, kind)
    return np.lib.format.open_memmap(path, "w+", kind, (rows,))


def text_key(*columns) -> F.Column:
    """xxHash64 of the columns as a bigint."""
    return F.xxhash64(*columns)
