"""WARC archives whose records are single Zstandard frames compressed with a dictionary from the archive's own records.

Each task writes one archive: a skippable frame that holds the dictionary, then one frame per record, so that a record can
be read by its offset alone. The dictionary is trained on the first records of the archive, up to SAMPLE_BYTES of them
(a documented bound; all records are written). Archives get a name of their own for each attempt, and readers take the names
from the written index, so a lost or repeated task leaves no record twice.

Of records with equal payloads of at least `min_bytes` bytes those with the smallest page_id are responses, all others
revisits of it without a payload; smaller ones are all responses. Rows that share the smallest page_id are all
responses. Null html is an empty payload, null urls an empty target. A null page_id counts as larger than all others; rows
with null page_id only among equal payloads are all responses. Equal payloads are found by an aggregation of their SHA-1, and
their rows are spread by a salt before they meet it, so a payload that a third of the pages share is no hot key.

The folder of the archives is a URI that pyarrow's file systems know (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm.shared import shared_path, stored

#: Magic number of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: Bytes of the first records that a dictionary is trained on, and its size.
SAMPLE_BYTES, DICTIONARY_BYTES = 2_000_000, 32_768
LEVEL = 3
SALTS = 16
DATE = "1970-01-01T00:00:00Z"

INDEX = "archive string, at long, size long"


def _record(page_id: int | None, url: str, html: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n").encode()
    block = http if revisit else http + html
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained where there are samples enough, else the samples themselves."""
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL, k=200, d=8)
        except zstandard.ZstdError:
            pass  # too little common content to train on
    return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _archive(folder: str, records: Iterator[tuple[bytes, int]]) -> Iterator[tuple[str, int, int, int]]:
    """Writes the records (and what the caller knows them by) to a new archive; yields name, offset and size of each."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r[0])
        if size >= SAMPLE_BYTES:
            break
    if not held:
        return
    dictionary = _dictionary([r for r, _ in held])
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
    frame = struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed
    name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
    fs, path = pyarrow.fs.FileSystem.from_uri(name)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
    with fs.open_output_stream(path, compression=None) as out:
        out.write(frame)
        at = len(frame)
        for part in (held, records):
            for record, known in part:
                data = compressor.compress(record)
                out.write(data)
                yield name, at, len(data), known
                at += len(data)


def read_dictionary(stream) -> zstandard.ZstdCompressionDict:
    """The dictionary in the leading frame of an archive."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    return zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(stream.read(size)))


def parsed(record: bytes) -> dict:
    """Headers and payload of a record."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields | {"payload": payload, "payload_bytes": length}


def classified(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html (not null), digest (hex) and first_id: the page_id of the response, null for records that no other equals."""
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha1("html"))
    firsts = (pages.where(F.octet_length("html") >= min_bytes).groupBy("digest")
              .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n"))
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    return pages.withColumn("salt", salt).join(firsts, ["digest", "salt"], "left").drop("salt")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes one record per row of pages (page_id, url, html; other columns are not used); the index (archive, at, size) as a stored table."""
    pages.sparkSession._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(
        pages.sparkSession._jsc.hadoopConfiguration()).mkdirs(pages.sparkSession._jvm.org.apache.hadoop.fs.Path(folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple[bytes, int]]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    for r in batch.slice(at, 64).to_pylist():
                        revisit = r["first_id"] is not None and r["page_id"] != r["first_id"]
                        digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                        yield _record(r["page_id"], r["url"], r["html"].encode("utf-8", "surrogatepass"), digest, r["first_id"], revisit), 0

        rows = []
        for name, at, size, _ in _archive(folder, records()):
            rows.append((name, at, size))
            if len(rows) == 10_000:
                yield _index(rows)
                rows = []
        if rows:
            yield _index(rows)

    return stored(classified(pages, min_bytes).mapInArrow(run, INDEX), "warc-index")


def _index(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2))], ["archive", "at", "size"])


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of an index: page_id, url, record_type, refers_to, payload_bytes, payload_digest, and payload (empty for
    revisits). The digest of a response is computed from its payload, that of a revisit is the one stored."""
    fields = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream, unpack = None, None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["archive"] != name:
                    name = r["archive"]
                    fs, path = pyarrow.fs.FileSystem.from_uri(name)
                    stream = fs.open_input_file(path)
                    unpack = zstandard.ZstdDecompressor(dict_data=read_dictionary(stream))
                stream.seek(r["at"])
                rows.append(_row(parsed(unpack.decompress(stream.read(r["size"]))), payloads))
                if len(rows) == 256:
                    yield pa.RecordBatch.from_pylist(rows, _schema(payloads))
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _schema(payloads))

    return index.mapInArrow(run, fields + ", payload binary" * payloads)


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _row(record: dict, payloads: bool) -> dict:
    kind, payload = record["WARC-Type"], record["payload"]
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {"page_id": _page(record["WARC-Record-ID"]), "url": record.get("WARC-Target-URI", ""), "record_type": kind,
            "refers_to": _page(record.get("WARC-Refers-To")), "payload_bytes": record["payload_bytes"],
            "payload_digest": own if kind == "response" else record["WARC-Payload-Digest"].removeprefix("sha1:")} | ({"payload": payload} if payloads else {})


def _schema(payloads: bool) -> pa.Schema:
    return pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                      ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), *([("payload", pa.binary())] if payloads else [])])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = write_archives(pages, shared_path(spark, "warc"))
    return read_archives(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
