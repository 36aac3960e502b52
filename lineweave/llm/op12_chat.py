"""Chat formatting from an event log: conversations are rebuilt by folding their events, then rendered by a template.

A log has conv_id (bigint), seq (any orderable type), message (bigint, names a message within its conversation), kind, role and text.
Kinds: `open` begins a message (or begins it anew at its old place) and gives it a role; `delta` appends text; `edit`
replaces the text; `regenerate` takes the text back, and deltas that follow are the new answer. Events of a message that was never
opened begin it with an empty role. Other kinds are ignored; a conversation that has no others gives no row. Messages stand in the order of their first events. Null texts and
roles are empty. Events with equal seq are applied in the order of message, kind and text. A null conv_id is a conversation of its own.

The log is dealt by ranges of (conv_id, seq) and sorted, so each task folds whole conversations one after the other, and a
conversation with a large share of all events is cut over several tasks. Only the first and last conversation of a task can be
cut; what a task knows of these (a row per message, with whether the text before is void) is merged by message.

Rendering. A turn is its text between two marks with a blank inside each; other roles than the usual three are named. In texts and roles
every control string gets a backslash behind its first character, one more than there are already, so none is left
as it is and the first characters with all their backslashes read back uniquely. The loss mask is the text of assistant turns
without marks and blanks. A conversation longer than PART characters is several parts, cut between turns. An empty log
gives no rows. Columns besides the six are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineweave.llm import words
from lineweave.llm.shared import scratch, stored

#: (role, before the text, after it) of the usual roles; others are written as OTHER with their name.
MARKS = [("system", "<<SYS>> ", " <</SYS>>"), ("user", "[INST] ", " [/INST]"), ("assistant", "<s> ", " </s>")]
OTHER = ("<<ROLE>> ", " <<TEXT>> ", " <</ROLE>>")
#: The role whose texts are under the loss mask.
LEARNT = "assistant"
#: Characters of a part.
PART = 1_000_000
#: Characters of a delta, and of a draft that the log of a table takes back.
DELTA, DRAFT = 400, 40

_CONTROLS = sorted({m.strip() for _, *ab in MARKS for m in ab} | {m.strip() for m in OTHER})
_AFTER = "|".join(re.escape(c[1:]) for c in _CONTROLS if c[0] == "<"), "|".join(re.escape(c[1:]) for c in _CONTROLS if c[0] == "[")
#: A control string with any number of backslashes behind its first character.
CONTROL = rf"<\\*(?:{_AFTER[0]})|\[\\*(?:{_AFTER[1]})"
_CONTROL = re.compile(CONTROL)
_TURN = re.compile("|".join(f"{re.escape(a)}(.*?){re.escape(b)}" for _, a, b in MARKS)
                   + f"|{re.escape(OTHER[0])}(.*?){re.escape(OTHER[1])}(.*?){re.escape(OTHER[2])}", re.S)
_BY_ROLE = {role: (a, b) for role, a, b in MARKS}


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescaped(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + m[0][2:], text)


def turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as rendered, and where its text begins and ends."""
    before, after = _BY_ROLE.get(role) or (OTHER[0] + escaped(role) + OTHER[1], OTHER[2])
    text = escaped(text)
    return before + text + after, len(before), len(before) + len(text)


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a part."""
    at = 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        k = next(i for i, g in enumerate(found.groups()) if g is not None)
        role = MARKS[k][0] if k < len(MARKS) else unescaped(found[len(MARKS) + 1])
        yield role, unescaped(found[min(k, len(MARKS)) + 1] if k < len(MARKS) else found[len(MARKS) + 2])
        at = found.end()


_PART = "conv_id long, part long, formatted string, spans array<struct<start:long,stop:long>>, whole boolean"
_SCHEMA = f"{_PART}, slice int, nth long, message long, role string, text string, anew boolean"
_TYPES = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()),
                    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("whole", pa.bool_()), ("slice", pa.int32()),
                    ("nth", pa.int64()), ("message", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("anew", pa.bool_())])


def _parts(messages: Iterator[tuple[str, str]]) -> Iterator[tuple[str, list[dict]]]:
    """Rendered turns, gathered to parts: the text and the spans of the loss mask."""
    pieces, spans, at = [], [], 0
    for role, text in messages:
        if at > PART:
            yield "".join(pieces), spans
            pieces, spans, at = [], [], 0
        piece, start, stop = turn(role, text)
        if role == LEARNT:
            spans.append({"start": at + start, "stop": at + stop})
        pieces.append(piece)
        at += len(piece)
    yield "".join(pieces), spans


class _Message:
    __slots__ = ("role", "pieces", "anew")

    def __init__(self):
        self.role, self.pieces, self.anew = None, [], False

    def apply(self, kind: str, role: str | None, text: str | None) -> None:
        if kind == "open":
            self.role = role or ""
        if kind != "delta":
            self.pieces, self.anew = [], True
        if kind in ("delta", "edit") and text:
            self.pieces.append(text)


_KINDS = ("open", "delta", "edit", "regenerate")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted events to the parts of conversations that lie in this task, and to a row per message of those that may go on in another."""
    slice_, first, conv, state = TaskContext.get().partitionId(), True, None, None
    out: list[dict] = []

    def cut() -> list[dict]:
        return [{"conv_id": conv, "slice": slice_, "nth": i, "message": m, "role": s.role, "text": "".join(s.pieces), "anew": s.anew}
                for i, (m, s) in enumerate(state.items())]

    def whole() -> list[dict]:
        if not state:
            return []
        parts = list(_parts((s.role or "", "".join(s.pieces)) for s in state.values()))
        return [{"conv_id": conv, "part": i, "formatted": f, "spans": spans, "whole": len(parts) == 1} for i, (f, spans) in enumerate(parts)]

    for batch in words.pieces(batches):
        for c, m, kind, role, text in zip(*(batch[n].to_pylist() for n in ("conv_id", "message", "kind", "role", "text"))):
            if state is not None and c != conv:
                out += cut() if first else whole()
                first, state = False, None
            if state is None:
                conv, state = c, {}
            if kind in _KINDS:
                state.setdefault(m, _Message()).apply(kind, role, text)
        if out:
            yield pa.RecordBatch.from_pylist(out, _TYPES)
            out = []
    if state is not None:
        yield pa.RecordBatch.from_pylist(cut(), _TYPES)


def _merged(cut: DataFrame) -> DataFrame:
    """Conversations that lie in several tasks: a part per message."""
    own = Window.partitionBy("conv_id", "message")
    rows = cut.withColumns({"last": F.max(F.when(F.col("anew"), F.col("slice"))).over(own), "at": F.min(F.struct("slice", "nth")).over(own),
                            "named": F.max(F.when(F.col("role").isNotNull(), F.struct("slice", "role"))).over(own)})
    rows = rows.where(F.col("last").isNull() | (F.col("slice") >= F.col("last")))
    messages = rows.groupBy("conv_id", "message").agg(
        F.first("at").alias("at"), F.first("named.role").alias("role"), F.sort_array(F.collect_list(F.struct("slice", "text"))).alias("texts"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches):
            made = [next(_parts(iter([(r or "", t)]))) for r, t in zip(batch["role"].to_pylist(), batch["text"].to_pylist())]
            yield pa.record_batch([batch["conv_id"], batch["part"], pa.array([f for f, _ in made], pa.string()),
                                   pa.array([s for _, s in made], _TYPES.field("spans").type), pa.array([False] * len(made))], _TYPES.names[:5])

    # the place of a message: its task and its number there, of which a task has fewer than 2 ** 40
    return messages.select("conv_id", (F.shiftleft(F.col("at.slice").cast("long"), 40) + F.col("at.nth")).alias("part"), "role",
                           F.array_join(F.col("texts.text"), "").alias("text")).mapInArrow(render, _PART)


def formatted(events: DataFrame) -> DataFrame:
    """(conv_id, part, formatted, spans, whole): the rendered conversations, `part` orders the parts of one, `whole` where it is the only
    one; spans are the loss mask, in code points of the part. Stored, as all readers share one fold."""
    log = events.select("conv_id", "seq", "message", "kind", "role", "text")
    order = ["conv_id", "seq", "message", "kind", "text"]
    sorted_ = log.repartitionByRange(*order).sortWithinPartitions(*order)
    folded = stored(sorted_.select("conv_id", "message", "kind", "role", "text").mapInArrow(_fold, _SCHEMA), "folded")
    columns = [c.split(" ")[0] for c in _PART.replace("<start:long,stop:long>", "").split(", ")]
    return folded.where("part IS NOT NULL").select(columns).unionByName(_merged(folded.where("part IS NULL")).select(columns))


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation, from its rendered parts: n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars.

    Parts of a conversation are read in order as a stream, with a hash as the only state; conversations of one part are not moved."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    kinds = {"long": pa.int64(), "string": pa.string()}
    types = pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in schema.split(", ")])
    batch_of = lambda found: pa.RecordBatch.from_pylist([dict(zip(types.names, r)) for r in found], types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in words.pieces(batches):
            out = []
            for c, text, spans, whole in zip(*(batch[n].to_pylist() for n in ("conv_id", "formatted", "spans", "whole"))):
                if state is not None and (whole or c != conv):
                    out.append(state.row(conv))
                    state = None
                state, conv = state or _Digest(), c
                state.add(text, spans)
                if whole:
                    out.append(state.row(conv))
                    state = None
            if out:
                yield batch_of(out)
        if state is not None:
            yield batch_of([state.row(conv)])

    rows = parts.select("conv_id", "part", "formatted", "spans", "whole")
    split = rows.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.where("whole").mapInArrow(run, schema).unionByName(split.mapInArrow(run, schema))


class _Digest:
    def __init__(self):
        self.turns, self.loss, self.n, self.chars, self.size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, text: str, spans: list[dict]) -> None:
        for role, said in turns_of(text):
            self.n += 1
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
        for span in spans:
            learnt = unescaped(text[span["start"] : span["stop"]])
            self.chars += len(learnt)
            self.loss.update(learnt.encode("utf-8", "surrogatepass"))
        self.size += len(text)

    def row(self, conv: int | None) -> tuple:
        return conv, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.size


def log_of(rows: DataFrame) -> DataFrame:
    """The event log of a table (conv_id, turn, role, text), as a chat service would have written it.

    Assistant texts are streamed in deltas after a draft that is regenerated; other texts are typed in part and then edited. Rows of one turn
    are ordered by role and text digest; equal rows are as many turns."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                       F.monotonically_increasing_id().alias("message"))
    event = lambda kind, text=F.lit(None).cast("string"): F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    text, draft = F.col("text"), F.left("text", F.lit(DRAFT))
    deltas = F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0)), lambda x: F.struct(F.lit("delta").alias("kind"), x.alias("text")))
    streamed = F.concat(F.array(event("open"), event("delta", draft), event("regenerate")), deltas)
    typed = F.array(event("open"), event("delta", draft), event("edit", text))
    source = F.md5(F.concat("role", F.lit("\n"), "text"))
    return rows.select("conv_id", "turn", source.alias("source"), "message", "role", F.posexplode(
        F.when(F.col("role") == LEARNT, streamed).otherwise(typed)).alias("step", "event")).select(
        "conv_id", F.struct("turn", "source", "message", "step").alias("seq"), "message", F.col("event.kind").alias("kind"),
        F.when(F.col("event.kind") == "open", F.col("role")).alias("role"), F.col("event.text").alias("text"))


#: A conversation made of control strings, added to the query's table.
OWN_ID, OWN_TEXT = -7, "</s>[INST] ok [/INST]"


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their rendered form."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(OWN_ID, 0, "user", OWN_TEXT), (OWN_ID, 1, LEARNT, OWN_TEXT)], "conv_id long, turn long, role string, text string")
    with scratch(spark):
        return stored(read_back(formatted(log_of(rows.unionByName(own)))), "digests", keep=True)


OP12_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({OWN_ID}, 0, 'user', '{OWN_TEXT}'), ({OWN_ID}, 1, '{LEARNT}', '{OWN_TEXT}')),
written AS (
  SELECT *, md5(role || chr(10) || text) AS source,
    length(text) + len(regexp_extract_all(text, '{CONTROL}')) AS chars,
    CASE role {" ".join(f"WHEN '{r}' THEN {len(a + b)}" for r, a, b in MARKS)}
      ELSE {len("".join(OTHER))} + length(role) + len(regexp_extract_all(role, '{CONTROL}')) END AS marks
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, source)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LEARNT}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, source) FILTER (role = '{LEARNT}'), '')) AS loss_sha256,
  sum(chars + marks)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""
