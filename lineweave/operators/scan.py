"""Running state over the lines of a script, safe for scripts of any length.

The lines of one script are ordered by `pos`. Two primitives cover every stateful operator:

* `running`         the last event, or the sum, over all earlier lines of the script;
* `counted`         how often each name was added since the last reset line, as rows.

A short script (levels = 0) is one window partition. A long script is cut into chunks of bounded
length: each chunk is reduced to one summary row, the same primitive over the summaries, with one
level less, gives the state each chunk starts from, and that state is joined back on the chunk. With
enough levels no task holds more than one chunk of lines or FAN_OUT summaries of a script, even when
one script makes up most of the archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_KEYS = ["script_id", "chunk"]
# summaries of one chunk of the next level
FAN_OUT = 16384
_START, _HERE = Window.unboundedPreceding, Window.currentRow


def levels_for(longest: int, chunk_lines: int) -> int:
    """How often a script of `longest` lines has to be summed up until one window can hold the rest."""
    levels, reach = 0, chunk_lines
    while reach < longest:
        levels, reach = levels + 1, reach * FAN_OUT
    return levels


def cut_lineage(df: DataFrame, levels: int) -> DataFrame:
    """Write a long-script step to the cluster's checkpoint folder, if it names one: each carry reads
    its input twice, so a plan of many carries would otherwise repeat the early ones."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not (levels and folder):
        return df
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()


def _keys(by: list[str], levels: int) -> list[str]:
    return [*by, "chunk"] if levels else by


def next_level(summary: DataFrame) -> DataFrame:
    """Summary rows as the lines of the next level."""
    return summary.withColumn("pos", F.col("chunk")).withColumn("chunk", F.floor(F.col("chunk") / FAN_OUT))


def _as_carry(rows: DataFrame, by: list[str], names: dict[str, str]) -> DataFrame:
    return rows.select(*by, F.col("pos").alias("chunk"), *[F.col(c).alias(f"carry_{n}") for n, c in names.items()])


def running(df: DataFrame, levels: int, last: dict[str, Column] | None = None,
            total: dict[str, Column] | None = None, by: list[str] = CHUNK_KEYS[:1]) -> DataFrame:
    """Add each event column `name` and `prev_name`, its state before the line.

    `last`: the last non-null event on earlier lines, null if none. `total`: the sum over earlier
    lines, 0 if none.
    """
    last, total = last or {}, total or {}
    keys = _keys(by, levels)
    df = df.withColumns({**last, **total})
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(_START, -1)
    prev = {f"prev_{n}": F.last(n, ignorenulls=True).over(w) for n in last}
    prev |= {f"prev_{n}": F.coalesce(F.sum(n).over(w), F.lit(0)) for n in total}
    if not levels:
        return df.withColumns(prev)

    summary = df.groupBy(*keys).agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("pos"))).alias(n) for n in last],
        *[F.sum(n).alias(n) for n in total])
    before = running(next_level(summary), levels - 1, {n: F.col(n) for n in last}, {n: F.col(n) for n in total}, by)
    carry = _as_carry(before, by, {n: f"prev_{n}" for n in [*last, *total]})
    return (df.withColumns(prev).join(carry, keys)
            .withColumns({f"prev_{n}": F.coalesce(f"prev_{n}", f"carry_{n}") for n in last}
                         | {f"prev_{n}": F.col(f"prev_{n}") + F.col(f"carry_{n}") for n in total})
            .drop(*[f"carry_{n}" for n in [*last, *total]]))


def counted(lines: DataFrame, levels: int, entries: str, dropped: Column) -> DataFrame:
    """One row per line and name it holds: the columns of `lines` but for `resets` and `entries`, and `name`, `copies`.

    `resets` (boolean) starts a line anew. `entries` is an array of (name, shown, added), each name once: `added` copies go on to
    the following lines up to the next reset; where `shown` is not null it is what the line itself holds, else that is what has been
    added so far, this line included. `dropped`, over a line's columns and `name`, takes a name with all its copies away at
    a line whose `shown` is null.

    No line holds an array of what came before: a name is one row per line from where it is added, its count a running sum.
    The work is that of sorting the rows that come out.
    """
    keys = _keys(CHUNK_KEYS[:1], levels)
    order = Window.partitionBy(*keys).orderBy("pos").rowsBetween(_START, _HERE)
    kept = [c for c in lines.columns if c not in (*keys, "resets", entries)]
    entry = lines.schema[entries].dataType.elementType
    lines = lines.withColumns({"ord": F.count("*").over(order), "seg": F.sum(F.col("resets").cast("bigint")).over(order)})
    rows = lines.select(*keys, "seg", "ord", F.struct(*kept).alias("whole"),
                        F.explode(F.concat(F.array(F.lit(None).cast(entry)), entries)).alias("e"))
    # a line's own columns stand in the row without a name only, so that names do not repeat its text
    rows = rows.select(*keys, "seg", "ord", F.when(F.col("e").isNull(), F.col("whole")).alias("whole"), "e.*")
    if not levels:
        return _resolved(_placed(rows, keys, dropped)).select(*keys, "whole.*", "name", "copies")

    rows = cut_lineage(rows, levels)
    chunks, live = _live_names(rows, levels)
    placed = cut_lineage(_placed(rows.unionByName(live, allowMissingColumns=True), keys, dropped), levels)
    carry = _carried_counts(placed, chunks, live, levels).withColumn("seg", F.lit(0).cast("bigint"))
    placed = placed.join(carry, [*keys, "seg", "name"], "left")
    return _resolved(placed, F.coalesce("carry", F.lit(0))).select(*keys, "whole.*", "name", "copies")


def _placed(rows: DataFrame, keys: list[str], dropped: Column) -> DataFrame:
    """A row per line and name from where the name is added to the end of the segment: `total`, what the segment has added so far, and
    `lost`, the total at the last line that dropped the name."""
    named = Window.partitionBy(*keys, "seg", "name").orderBy("ord")
    # sorted by name within the segment, so this window needs no sort of its own
    last = F.max("ord").over(Window.partitionBy(*keys, "seg"))
    rows = rows.withColumn("next", F.lead("ord").over(named)).withColumn("last", last)
    goes_on = F.col("name").isNotNull() & ((F.col("added") > 0) | (F.col("ord") == 0))
    # line 0 is what a chunk starts with
    start, end = F.greatest("ord", F.lit(1)), F.when(goes_on, F.coalesce(F.col("next") - 1, "last")).otherwise(F.col("ord"))
    rows = rows.select(*keys, "seg", "name", "whole", F.explode(F.when(start <= end, F.sequence(start, end))).alias("at"),
                       "ord", "shown", "added")
    own = F.col("at") == F.col("ord")
    rows = rows.withColumns({"shown": F.when(own, F.col("shown")), "added": F.when(own, F.col("added")).otherwise(F.lit(0)),
                             "whole": F.first("whole", ignorenulls=True).over(Window.partitionBy(*keys, "at"))}).where(F.col("name").isNotNull())
    lines = [F.col(f"whole.{f.name}").alias(f.name) for f in rows.schema["whole"].dataType.fields]
    rows = rows.select(*keys, "seg", "name", "at", "shown", "added", "whole", *lines).withColumn("drops", F.col("shown").isNull() & dropped)
    so_far = Window.partitionBy(*keys, "seg", "name").orderBy("at").rowsBetween(_START, _HERE)
    rows = rows.select(*keys, "seg", "name", "at", "shown", "whole", "drops", F.sum("added").over(so_far).alias("total"))
    return rows.withColumn("lost", F.max(F.when(F.col("drops"), F.col("total"))).over(so_far)).drop("drops")


def _resolved(placed: DataFrame, carry: Column | None = None) -> DataFrame:
    added = F.when(F.col("lost").isNull(), F.col("total") if carry is None else F.col("total") + carry).otherwise(F.col("total") - F.col("lost"))
    return placed.withColumn("copies", F.coalesce("shown", added).cast("bigint")).where(F.col("copies") > 0)


def _live_names(rows: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """Every chunk with the number of resetting chunks before it (`run_in`) and up to it (`run_out`); and a row at line 0 for every
    name that may reach a chunk from earlier ones."""
    chunks = rows.groupBy(*CHUNK_KEYS).agg((F.max("seg") > 0).cast("bigint").alias("run"), F.max("seg").alias("seg"))
    chunks = running(next_level(chunks), levels - 1, total={"run": F.col("run")})
    chunks = cut_lineage(chunks.select("script_id", F.col("pos").alias("chunk"), "seg", F.col("prev_run").alias("run_in"),
                                       (F.col("prev_run") + F.col("run")).alias("run_out")), levels)
    # `seg` of a chunk is its last segment, the one that goes on into the next chunk
    first = (rows.where(F.col("added") > 0).join(chunks, [*CHUNK_KEYS, "seg"])
             .groupBy("script_id", F.col("run_out").alias("run_in"), "name").agg(F.min("chunk").alias("first")))
    until = chunks.groupBy("script_id", "run_in").agg(F.max("chunk").alias("until"))
    live = (first.join(until, ["script_id", "run_in"]).where(F.col("first") < F.col("until"))
            .select("script_id", F.explode(F.sequence(F.col("first") + 1, "until")).alias("chunk"), "name"))
    zero = F.lit(0).cast("bigint")
    return chunks, live.withColumns({"seg": zero, "ord": zero, "added": zero})


def _carried_counts(placed: DataFrame, chunks: DataFrame, live: DataFrame, levels: int) -> DataFrame:
    """(script_id, chunk, name, carry): the copies a chunk starts with."""
    by = ["script_id", "run", "name"]
    ends = placed.groupBy(*CHUNK_KEYS, "seg", "name").agg(F.max("total").alias("total"), F.max("lost").alias("lost"))
    gives = ends.join(chunks, [*CHUNK_KEYS, "seg"]).select(
        *CHUNK_KEYS, F.col("run_out").alias("run"), "name", (F.col("total") - F.coalesce("lost", F.lit(0))).alias("gives"),
        F.col("lost").isNotNull().alias("ends"), F.lit(False).alias("asks"))
    asks = live.join(chunks.select(*CHUNK_KEYS, "run_in"), CHUNK_KEYS).select(
        *CHUNK_KEYS, F.col("run_in").alias("run"), "name", F.lit(0).cast("bigint").alias("gives"), F.lit(False).alias("ends"), F.lit(True).alias("asks"))
    steps = next_level(gives.unionByName(asks).groupBy(*by, "chunk").agg(
        F.sum("gives").alias("gives"), F.max("ends").alias("ends"), F.max("asks").alias("asks")))
    steps = running(steps, levels - 1, total={"gives": F.col("gives")}, by=by)
    steps = running(steps, levels - 1, last={"base": F.when(F.col("ends"), F.col("prev_gives"))}, by=by)
    return steps.where("asks").select("script_id", F.col("pos").alias("chunk"), "name",
                                      (F.col("prev_gives") - F.coalesce("prev_base", F.lit(0))).alias("carry"))
