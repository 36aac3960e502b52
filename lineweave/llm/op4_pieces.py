"""SentencePiece encoding and decoding with a table of distinct chunks.

In models whose pieces hold the white-space mark at their beginning only, no merge crosses from a character to a mark that
follows it. A text is then a sequence of chunks (marks and the characters up to the next mark), and its ids are those of its
chunks one after the other. Each task keeps a table chunk -> ids, has the library segment every chunk once, a batch of new ones
at a time, and joins the ids back by position. The table is bounded: when full it starts anew. The premise is checked
against all pieces of the model; models that break it, and texts where it cannot hold, are encoded whole by the library.

A table per task, not one over the cluster: see README for the figures. Null text counts as empty and has no ids. Columns of
the input named like those of the result are replaced. Repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from lineweave.llm import words

MARK = "▁"
#: Chunks held by a task.
HELD_CHUNKS = 300_000
_CHUNK = re.compile(" +[^ ]*")


class ChunkTable(dict):
    """chunk, blanks for marks -> (its ids as text, their number, its decoded form)."""

    def __init__(self, model: str):
        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        own = [p for i, p in enumerate(pieces) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        plain = all(self.library.normalize(x) == MARK + x.replace(" ", MARK) for x in ("a  b ", "ﬁ①é", " \n\t.", "A 　b"))
        self.divisible = plain and MARK in pieces and not any(re.search(f"[^{MARK}]{MARK}", p) for p in own)
        self.lone_mark = str(self.library.piece_to_id(MARK))

    def learn(self, chunks: set[str]) -> None:
        new = list(chunks - self.keys())
        if len(self) + len(new) > HELD_CHUNKS:
            self.clear()
            new = list(chunks)
        # the library puts one mark before a text: it stands for the first blank
        for chunk, ids in zip(new, self.library.encode([c[1:] for c in new], num_threads=1)):
            decoded = " " + self.library.decode(ids) if ids else chunk
            self[chunk] = (",".join(map(str, ids)) or self.lone_mark, len(ids) or 1, chunk if decoded == chunk else decoded)

    def whole(self, text: str) -> tuple[str, int, str]:
        ids = self.library.encode(text)
        return ",".join(map(str, ids)), len(ids), self.library.decode(ids)

    def texts(self, many: list[str]) -> Iterator[tuple[str, int, str]]:
        """Ids as text, their number and the decoded text of each."""
        cut = [_CHUNK.findall(" " + t.replace(MARK, " ")) if t and self.divisible and "\0" not in t else [] for t in many]
        self.learn({c for chunks in cut for c in chunks})
        for text, chunks in zip(many, cut):
            if chunks:
                found = [self[c] for c in chunks]
                yield ",".join([f[0] for f in found]), sum([f[1] for f in found]), "".join([f[2] for f in found])[1:]
            else:
                yield self.whole(text)


_tables: dict[str, ChunkTable] = {}


def table(path: str) -> ChunkTable:
    if path not in _tables:
        _tables.clear()
        _tables[path] = ChunkTable(path)
    return _tables[path]


def encoded(docs: DataFrame, model: str, text: str = "text", digests: bool = False) -> DataFrame:
    """docs with ids (array of int) and decoded (string); with `digests`, n_tokens, ids_sha256 and decoded_sha256 instead.

    model: path of the model file at the driver, which sends it to all workers."""
    docs.sparkSession.sparkContext.addFile(model)
    name = model.rsplit("/", 1)[1]
    new = ({"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} if digests
           else {"ids": pa.list_(pa.int32()), "decoded": pa.string()})
    docs = docs.drop(*new)
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = table(SparkFiles.get(name))
        for batch in words.pieces(batches):
            rows = list(chunks.texts([t or "" for t in batch[text].to_pylist()]))
            if digests:
                columns = [[n for _, n, _ in rows], [_sha(ids) for ids, _, _ in rows], [_sha(d) for _, _, d in rows]]
            else:
                columns = [[[int(i) for i in ids.split(",") if i] for ids, _, _ in rows], [d for _, _, d in rows]]
            yield pa.RecordBatch.from_arrays(
                [*(batch[n] for n in kept), *(pa.array(c, kind) for c, kind in zip(columns, new.values()))], [*kept, *new])

    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, {kinds}")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(docs, default_model(), digests=True).drop("text")


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids and decoded text; the last stage, so it may add columns."""
    return encoded(docs, default_model())
