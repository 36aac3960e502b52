"""DataFrame names and the SQL call that follows each, over the lines of scripts of any length (Q5).

A line that starts with `df_` is looked for, then a later line with `spark.sql(`, then the first line from there with `)`;
after it the search starts anew. The search is an automaton of three states. Each chunk of a script is reduced to the end state
for each start state, the chunks of a script (one row each) give the state and name each starts with, and a second pass over the
chunks marks the lines. Lines come to both passes sorted, many scripts to a task, and are walked in one stream: no group of
lines is gathered, and a short script costs no more than its lines. What a task holds is one row per chunk of a script.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave import fixed_values as fv
from lineweave.functions.text import strip

# the steps below travel to the workers as they are, which need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# states of the search; a script whose last call never closes has no pairs, its first chunk is OPEN and the others VOID
NAME, CALL, END, OPEN, VOID = range(5)
# what a line holds
DF, SQL, STOP = 4, 2, 1
ROWS = 1 << 14


def _next(state: int, mark: int) -> int:
    if state == NAME:
        return CALL if mark & DF else NAME
    if state == END or (state == CALL and mark & SQL):
        return NAME if mark & STOP else END
    return state


NEXT = [[_next(state, mark) for mark in range(8)] for state in range(5)]


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[c].to_pylist() for c in columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.record_batch(list(map(pa.array, zip(*held), schema.types)), schema=schema)
            held = []
    if held:
        yield pa.record_batch(list(map(pa.array, zip(*held), schema.types)), schema=schema)


def _chunk_ends(rows: Iterator[tuple]) -> Iterator[tuple]:
    """State and line of the last name after each chunk, for each state it may start with."""
    at_chunk, ends = None, []
    for script, chunk, line_no, mark in rows:
        if (script, chunk) != at_chunk:
            if at_chunk:
                yield (*at_chunk, *[x for end in ends for x in end])
            at_chunk, ends = (script, chunk), [(NAME, -1), (CALL, -1), (END, -1)]
        if mark:
            ends = [(NEXT[state][mark], line_no if state == NAME and mark & DF else at) for state, at in ends]
    if at_chunk:
        yield (*at_chunk, *[x for end in ends for x in end])


def _script_starts(chunks: list[tuple]) -> Iterator[tuple]:
    """What each chunk of a script starts with, and the name whose call never closes (-1: none)."""
    state, at, starts = NAME, -1, []
    for script, chunk, *ends in chunks:
        starts.append((script, chunk, state, at))
        state, last = ends[2 * state], ends[2 * state + 1]
        at = last if last >= 0 else at
    if state == END:
        yield from ((script, chunk, VOID if k else OPEN, -1, -1) for k, (script, chunk, _, _) in enumerate(starts))
    else:
        yield from ((*start, -1 if state == NAME else at) for start in starts)


def _chunk_starts(rows: Iterator[tuple]) -> Iterator[tuple]:
    chunks = []
    for row in rows:
        if chunks and chunks[-1][0] != row[0]:
            yield from _script_starts(chunks)
            chunks = []
        chunks.append(row)
    if chunks:
        yield from _script_starts(chunks)


def _pair_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """df_at, src_line_no and role of the lines of pairs: the name, the call, the others. What a chunk starts with is its first row."""
    state, at, lost = VOID, -1, -1
    for batch in batches:
        rows, names, roles = [], [], []
        for k, (line_no, mark, start, start_at, start_lost) in enumerate(_rows([batch], "src_line_no", "mark", "state", "at", "lost")):
            if start is not None:
                state, at, lost = start, start_at, start_lost
                if state == OPEN:
                    rows.append(k)
                    names.append(None)
                    roles.append("open")
                continue
            if state in (OPEN, VOID) or (state == NAME and not mark & DF):
                continue
            if state == NAME:
                at, role = line_no, "name"
            else:
                role = "call" if state == CALL and mark & SQL else "text"
            state = NEXT[state][mark]
            # what follows a name whose call never closes, up to the rest of the script, is left out before any text is gathered
            if at != lost:
                rows.append(k)
                names.append(at)
                roles.append(role)
        picked = pa.array(rows, pa.int64())
        yield pa.record_batch([batch["script_id"].take(picked), pa.array(names, pa.int64()), batch["src_line_no"].take(picked), pa.array(roles, pa.string()),
                               batch["line"].take(picked)], ["script_id", "df_at", "src_line_no", "role", "line"])


def df_sql_pairs(lines: DataFrame, chunk_lines: int = fv.CHUNK_LINES) -> DataFrame:
    """(script_id, status, df_name, sql_text) of lines (script_id, src_line_no, line): one row per name, the last of equal names,
    or one row of status `unterminated` for a script whose last call never closes."""
    line, kind = F.col("line"), lines.schema["script_id"].dataType.simpleString()

    def steps(walk, columns: list[str], names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = next(batches, None)
            if first is not None:
                schema = pa.schema([("script_id", first.schema.field("script_id").type), *[(n, pa.int64()) for n in names]])
                yield from _batches(walk(_rows(itertools.chain([first], batches), *columns)), schema)
        return run

    def holds(test, weight: int):
        return F.when(test, weight).otherwise(0)

    place = ["script_id", "chunk", "src_line_no"]
    mark = holds(F.startswith(strip(line), F.lit("df_")), DF) + holds(line.contains("spark.sql("), SQL) + holds(line.contains(")"), STOP)
    marked = lines.where(F.col("src_line_no").isNotNull()).select(
        "script_id", F.floor((F.col("src_line_no") - 1) / chunk_lines).alias("chunk"), F.col("src_line_no").cast("long").alias("src_line_no"),
        mark.alias("mark"), "line")
    end_names = [f"{x}{k}" for k in range(3) for x in "sa"]
    ends = marked.select(*place, "mark").repartition("script_id", "chunk").sortWithinPartitions(*place).mapInArrow(
        steps(_chunk_ends, [*place, "mark"], ["chunk", *end_names]), f"script_id {kind}, chunk long, {', '.join(f'{n} long' for n in end_names)}")
    starts = ends.repartition("script_id").sortWithinPartitions("script_id", "chunk").mapInArrow(
        steps(_chunk_starts, ["script_id", "chunk", *end_names], ["chunk", "state", "at", "lost"]), f"script_id {kind}, chunk long, state long, at long, lost long")
    # the row that says what a chunk starts with has no line number: it comes first
    walked = marked.unionByName(starts, allowMissingColumns=True).repartition("script_id", "chunk").sortWithinPartitions(*place)
    pieces = walked.mapInArrow(_pair_lines, f"script_id {kind}, df_at long, src_line_no long, role string, line string")
    pieces = pieces.where(F.col("script_id").isNotNull() | (F.col("role") == "open"))
    text = F.when(F.col("role") == "call", F.substring(line, F.instr(line, "spark.sql("), F.length(line))).when(F.col("role") == "text", line)
    body = F.sort_array(F.collect_list(F.when(text.isNotNull(), F.struct("src_line_no", text.alias("line")))))
    pairs = (pieces.groupBy("script_id", "df_at")
             .agg(F.max(F.when(F.col("role") == "name", strip(F.substring_index(line, "=", 1)))).alias("df_name"), body.alias("body"))
             .withColumn("sql_text", F.when(F.col("df_at").isNotNull(), strip(F.array_join("body.line", "\n")))))
    # a script that has no pairs is one row without a name
    last = pairs.groupBy("script_id", "df_name").agg(F.max_by("sql_text", "df_at").alias("sql_text"), F.max("df_at").alias("df_at"))
    status = F.when(F.col("df_at").isNull(), "unterminated").otherwise("ok")
    return last.select("script_id", status.alias("status"), "df_name", "sql_text")
