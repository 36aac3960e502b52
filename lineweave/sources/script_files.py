"""Script files of any name and size (S1-S3): listed in tasks, read in byte ranges.

`script_scan` is a data source whose partitions are folders: the driver lists the upper folders only, tasks walk what lies below. Names
that start with `_` or `.` and empty files count like all others. Paths are those that pyarrow's file systems know (local, hdfs, s3, gs).

`script_lines` cuts every file into ranges. A first pass counts the line ends of a range, tests whether the lines that lie in it whole
are UTF-8, and hands on the bytes before its first and behind its last line end; these pieces of lines that cross a border are
put together by line number. A file is UTF-8 if all its lines are, else latin-1. A second pass decodes the whole lines. No
task holds more than a range or one line, and of the text only lines that cross a border are shuffled.

An empty file is one empty line. A root without scripts gives no rows.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lineweave import fixed_values as fv
from lineweave.operators.scan import cut_lineage
from lineweave.sources.files import relative_path

# the steps below travel to the workers as they are, which need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LINE_END = re.compile(b"\r\n|\r|\n")


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


# --- S1

class _Folders(InputPartition):
    def __init__(self, folders: list[str], deep: bool):
        self.folders, self.deep = folders, deep


class _ScriptReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.extensions = options["path"].rstrip("/"), options["extensions"].split(",")
        self.least = int(options["folders"])

    def _listed(self, fs: pafs.FileSystem, folder: str) -> tuple[list, list]:
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return ([x for x in found if x.type == pafs.FileType.File and x.base_name.rsplit(".", 1)[-1] in self.extensions and "." in x.base_name],
                [x.path for x in found if x.type == pafs.FileType.Directory])

    def partitions(self) -> list[InputPartition]:
        """Folders level by level until there are enough to share out; those above are read for their own files."""
        fs, root = _opened(self.root)
        above, below = [], [root]
        while below and len(below) < self.least:
            deeper = [d for folder in below for d in self._listed(fs, folder)[1]]
            above, below = above + below, deeper
        share = lambda folders, deep: [_Folders(folders[k :: self.least], deep) for k in range(min(len(folders), self.least))]
        return [*share(above, False), *share(sorted(below), True)] or [_Folders([], False)]

    def read(self, partition: _Folders) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(self.root)
        waiting = list(partition.folders)
        while waiting:
            files, folders = self._listed(fs, waiting.pop())
            waiting += folders if partition.deep else []
            if files:
                yield pa.record_batch([pa.array([self.root + f.path[len(root.rstrip("/")) :] for f in files]), pa.array([f.size for f in files], pa.int64())], ["path", "length"])


class ScriptSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lineweave_scripts"

    def schema(self) -> str:
        return "path string, length long"

    def reader(self, schema) -> DataSourceReader:
        return _ScriptReader(self.options)


def script_scan(spark: SparkSession, root: str, extensions: list[str] = fv.SCRIPT_EXTENSIONS, folders: int = 64) -> DataFrame:
    """(path, length) of every script below `root`; extensions are case-sensitive (S1). At least `folders` folders, if there are
    so many, are shared out to tasks."""
    spark.dataSource.register(ScriptSource)
    return (spark.read.format("lineweave_scripts").option("extensions", ",".join(extensions)).option("folders", folders).load(root))


def write_scripts(texts: DataFrame, root: str) -> None:
    """Writes (name, content) as files below `root`, each by the task that holds it; a repeated task writes the same again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _opened(root)
        for batch in batches:
            for name, content in zip(batch["name"].to_pylist(), batch["content"]):
                fs.create_dir(f"{top}/{name}".rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{top}/{name}", compression=None) as f:
                    f.write(content.as_buffer())
            yield batch.select(["name"])

    texts.select("name", "content").mapInArrow(run, "name string").count()


# --- S2, S3

def _spread(rows: DataFrame, size: Column, bytes_a_task: int) -> DataFrame:
    """Rows that name files, dealt to as many tasks as their bytes need. The number is explicit: the rows are small, what they name is not."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism + total // bytes_a_task)


def script_contents(scan: DataFrame, bytes_a_task: int = fv.RANGE_BYTES) -> DataFrame:
    """(path, length, content) of scripts that fit in a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch["path"].to_pylist()):
                fs, at = _opened(path)
                with fs.open_input_file(at) as f:
                    yield pa.record_batch([*batch.slice(i, 1).columns, pa.array([f.read()], pa.binary())], ["path", "length", "content"])

    scan = _spread(scan.select("path", "length"), F.col("length"), bytes_a_task)
    return scan.mapInArrow(run, "path string, length long, content binary")


def _range(path: str, start: int, stop: int) -> bytes:
    """The bytes of a range. A line feed is left out if the carriage return that it belongs to ends the range before."""
    fs, at = _opened(path)
    with fs.open_input_file(at) as f:
        before = f.read_at(1, start - 1) if start else b""
        data = f.read_at(stop - start, start)
    return data[1:] if before == b"\r" and data[:1] == b"\n" else data


def _inside(data: bytes, alone: bool) -> tuple[bytes, bytes | None, bytes | None]:
    """What lies between the first and the last line end, and what lies before and behind; all is inside if the range is the file.
    Behind is None where the range has no line end."""
    first = _LINE_END.search(data)
    if alone or not first:
        return (data, None, None) if alone else (b"", data, None)
    last = max(data.rfind(b"\n"), data.rfind(b"\r"))
    return data[first.end() : last + 1], data[: first.start()], data[last + 1 :]


def _batched(rows: Iterator[tuple[int, list[tuple]]], types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of the rows of many ranges: (bytes, rows) of each, up to some 16,384 rows or 8 MB before a batch is full."""
    held, size = [], 0
    for n, more in rows:
        held += more
        size += n
        if len(held) >= 1 << 14 or size >= 8 << 20:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types.values())], list(types))
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types.values())], list(types))


_MEASURED = {"path": pa.string(), "length": pa.int64(), "start": pa.int64(), "stop": pa.int64(), "ends": pa.int64(), "valid": pa.bool_(),
             "head": pa.binary(), "tail": pa.binary()}
_LINES = {"path": pa.string(), "src_line_no": pa.int64(), "n_src_lines": pa.int64(), "line": pa.string()}


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[int, list[tuple]]]:
        for batch in batches:
            for path, length, start, stop in zip(*(batch[c].to_pylist() for c in ("path", "length", "start", "stop"))):
                data = _range(path, start, stop)
                ends = data.count(b"\n") + data.count(b"\r") - data.count(b"\r\n")
                inside, head, tail = _inside(data, stop - start == length)
                try:
                    valid = inside.decode() is not None
                except UnicodeDecodeError:
                    valid = False
                yield len(head or b"") + len(tail or b""), [(path, length, start, stop, ends, valid, head, tail)]

    return _batched(rows(), _MEASURED)


def _whole_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[int, list[tuple]]]:
        for batch in batches:
            for path, length, start, stop, before, n, utf8 in zip(*(batch[c].to_pylist() for c in ("path", "length", "start", "stop", "before", "n", "utf8"))):
                alone = stop - start == length
                inside, head, _ = _inside(_range(path, start, stop), alone)
                lines = _LINE_END.split(inside)
                if not alone:
                    lines, before = lines[:-1], before + 1  # behind the last line end lies nothing; the head is the first line
                for k in range(0, len(lines), 1 << 14):
                    part = [x.decode("utf-8" if utf8 else "latin-1") for x in lines[k : k + (1 << 14)]]
                    yield sum(map(len, part)), [(path, before + k + i, n, x) for i, x in enumerate(part, 1)]

    return _batched(rows(), _LINES)


def script_lines(scan: DataFrame, root: str, range_bytes: int = fv.RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(script_id, src_line_no, n_src_lines, line) of every script, and (script_id, n_src_lines) of the scripts; the id is the relative path."""
    step = F.lit(range_bytes).cast("long")
    ranges = scan.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), step)).alias("start"))
    ranges = ranges.withColumn("stop", F.least("length", F.col("start") + step))
    size = F.col("stop") - F.col("start")
    # short ranges make no more tasks: what a task reads has a size of its own
    bytes_a_task = max(range_bytes, fv.RANGE_BYTES)
    found = _spread(ranges, size, bytes_a_task).mapInArrow(
        _measured, "path string, length long, start long, stop long, ends long, valid boolean, head binary, tail binary")
    found = cut_lineage(found, 1)
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("before", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))

    pieces = found.where(F.col("head").isNotNull()).select("path", "start", F.explode(F.array(
        F.struct((F.col("before") + 1).alias("src_line_no"), F.col("head").alias("piece")),
        F.struct((F.col("before") + F.col("ends") + 1).alias("src_line_no"), F.col("tail").alias("piece")))).alias("p")).select("path", "start", "p.*")
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("start", "piece"))), F.lit(b""), lambda acc, x: F.concat(acc, x["piece"]))
    crossing = cut_lineage(pieces.where(F.col("piece").isNotNull()).groupBy("path", "src_line_no").agg(joined.alias("bytes")), 1)
    votes = found.select("path", "ends", "valid").unionByName(
        crossing.select("path", F.lit(0).cast("long").alias("ends"), F.is_valid_utf8(F.col("bytes").cast("string")).alias("valid")))
    scripts = cut_lineage(votes.groupBy("path").agg((F.sum("ends") + 1).alias("n"), F.min("valid").alias("utf8")), 1)

    reads = found.select("path", "length", "start", "stop", "before").join(scripts, "path")
    whole = _spread(reads, size, bytes_a_task).mapInArrow(_whole_lines, "path string, src_line_no long, n_src_lines long, line string")
    text = F.when(F.col("utf8"), F.decode("bytes", "UTF-8")).otherwise(F.decode("bytes", "ISO-8859-1"))
    crossed = crossing.join(scripts, "path").select("path", "src_line_no", F.col("n").alias("n_src_lines"), text.alias("line"))
    script_id = relative_path(F.col("path"), root).alias("script_id")
    return (whole.unionByName(crossed).select(script_id, "src_line_no", "n_src_lines", "line"), scripts.select(script_id, F.col("n").alias("n_src_lines")))
