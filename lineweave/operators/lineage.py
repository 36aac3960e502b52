"""Statement lineage over assembled lines: (script_id, pos, line_no, line) in, one column set out per step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave import fixed_values as fv
from lineweave.functions import names as nm
from lineweave.functions.text import computed_once, holds_any, starts_with_any
from lineweave.operators.lookup import names_within
from lineweave.operators.scan import CHUNK_KEYS, counted, cut_lineage, running

USE = "struct<name:string,copies:bigint>"


def _numbered(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), n.cast("string"))


def opens_block(line: Column) -> Column:
    return starts_with_any(line, ["df_"]) & holds_any(line, fv.OPENING_TOKENS)


def block_owner(lines: DataFrame, levels: int) -> DataFrame:
    """Add `owner`, the DataFrame variable whose block a line stands in."""
    line, n = F.col("line"), F.col("line_no")
    opens, starts, closes = opens_block(line), line.contains("spark.sql("), line.contains('""")')

    lines = running(lines, levels, last={"sql": F.when(closes, False).when(starts, True)})
    was_sql = F.coalesce("prev_sql", F.lit(False))
    lines = lines.withColumns({"in_sql": starts | was_sql, "run_start": F.when(starts & ~was_sql, n)})
    ends = closes & F.col("in_sql")

    lines = running(lines, levels, last={
        "owned": F.when(ends, False).when(opens, True),
        "var": F.when(opens, nm.df_variable(line)),
        "open_no": F.when(opens, n),
        "named": F.when(line.contains("createOrReplaceTempView"), True).when(opens, False),
        "end_no": F.when(ends, n),
        "run_no": F.col("run_start"),
    })
    run_no = F.coalesce("run_no", "prev_run_no")
    run_label = (F.when(run_no == 1, "None")
                 .when(F.col("prev_end_no") == run_no - 1, _numbered("None_", run_no))
                 .otherwise(_numbered("None_", run_no - 1)))
    owner = (F.when(ends, "#")
             .when(opens, F.col("var"))
             .when(F.col("prev_owned") & F.col("prev_named"), _numbered("None_", F.col("prev_open_no")))
             .when(F.col("prev_owned"), F.col("prev_var"))
             .when(F.col("in_sql"), run_label)
             .otherwise(_numbered("None_", n)))
    state = ["sql", "owned", "var", "open_no", "named", "end_no", "run_no"]
    return lines.withColumn("owner", owner).drop("in_sql", "run_start", *state, *[f"prev_{s}" for s in state])


def nameless_opener(line: Column) -> Column:
    return opens_block(line) & (nm.df_variable(line) == "")


def classify(lines: DataFrame, keep_bad: bool = False) -> DataFrame:
    """Keep statements; add `upper`, `kind`, the names `found` and the view a line declares (X2, X3). Narrow.

    `keep_bad` keeps lines of no kind that end their script, for `drop_after_bad_line`."""
    line = F.col("line")
    lines = lines.withColumn("upper", F.upper(line))
    wanted = F.col("kind").isNotNull()
    return (computed_once(lines, "kind", nm.stmt_type(line, F.col("upper"))).where(wanted | nameless_opener(line) if keep_bad else wanted)
            .withColumns({"found": nm.table_refs(line, F.col("kind")), "view": nm.view_name(line)}))


def temp_view_use(stmts: DataFrame, levels: int) -> DataFrame:
    """Add `uses`: each view declared so far whose name the line holds, with its number of
    declarations; such a line becomes TEMP_VIEW_USE and keeps its first kind as `own_kind` (X5)."""
    stmts = _uses_long(stmts, levels) if levels else _uses_short(stmts)
    uses = F.when(F.col("kind") == "TEMP_VIEW", F.array().cast(f"array<{USE}>")).otherwise(F.col("uses"))
    return (stmts.withColumns({"uses": uses, "own_kind": F.col("kind")})
            .withColumn("kind", F.when(F.size("uses") > 0, "TEMP_VIEW_USE").otherwise(F.col("kind"))))


def _uses_short(stmts: DataFrame) -> DataFrame:
    so_far = Window.partitionBy("script_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = F.filter("views", lambda v: F.contains("upper", v))
    return (stmts.withColumn("views", F.collect_list("view").over(so_far))
            .withColumn("views", hits)
            .withColumn("uses", F.transform(
                F.array_distinct("views"),
                lambda v: F.struct(v.alias("name"), F.size(F.filter("views", lambda x: x == v)).cast("bigint").alias("copies"))))
            .drop("views"))


def _uses_long(stmts: DataFrame, levels: int) -> DataFrame:
    """The views that each line holds are found by a join; how often each was declared up to the line is a running sum per view over
    the lines that declare or hold it."""
    place = [*CHUNK_KEYS, "pos"]
    declared = stmts.where(F.col("view").isNotNull()).select(*place, F.col("view").alias("name"))
    names = declared.select("script_id", "name").distinct()
    lines = stmts.where("kind <> 'TEMP_VIEW'").select(*place, F.col("upper").alias("text"))
    held = names_within(lines, names.where("name <> ''"), place)
    # the empty name is held by every line
    held = held.unionByName(lines.drop("text").join(names.where("name = ''"), "script_id"))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    events = (declared.select("*", one.alias("n"), zero.alias("held")).unionByName(held.select(*declared.columns, zero.alias("n"), one.alias("held")))
              .groupBy(*place, "name").agg(F.sum("n").alias("n"), F.max("held").alias("held")))
    events = running(cut_lineage(events, levels), levels, total={"n": F.col("n")}, by=["script_id", "name"])
    copies = F.col("prev_n") + F.col("n")
    uses = (events.where((F.col("held") == 1) & (copies > 0)).groupBy(*place)
            .agg(F.collect_list(F.struct("name", copies.cast("bigint").alias("copies"))).alias("uses")))
    return stmts.join(uses, place, "left").withColumn("uses", F.coalesce("uses", F.array().cast(f"array<{USE}>")))


def drop_after_bad_line(stmts: DataFrame, levels: int) -> DataFrame:
    """A statement without the part its name is taken from ends its script."""
    stmts = running(stmts, levels, last={"bad": F.when(is_bad(), True)})
    return stmts.where(F.col("bad").isNull() & F.col("prev_bad").isNull()).drop("bad", "prev_bad")


def is_bad() -> Column:
    line = F.col("line")
    return F.coalesce(nm.lacks_name(line, F.col("found"), F.col("kind")), F.lit(False)) | nameless_opener(line)


def carried_refs(stmts: DataFrame, levels: int, schemas: list[str] = fv.KNOWN_SCHEMAS,
                 rejected: list[str] = fv.REJECTED_SCHEMA_PREFIXES) -> DataFrame:
    """One row per statement and name, with `name` and `copies`: the statement's own names, or, when it has none, those
    of the statement before, plus every view use since (X6-X8)."""
    line, upper, kind = F.col("line"), F.col("upper"), F.col("kind")
    resets = (F.col("own_kind").isin(*nm.PATH_TYPES, "WRITE_MODE", "ETC") | (F.size("found") > 0)
              | kind.isin(nm.PAREN_TYPES))
    unfiltered = kind.isin(nm.UNFILTERED_TYPES)

    def known(name: Column) -> Column:
        return nm.known_table(name, schemas, rejected)

    def entry(name: Column, shown: Column, added: Column) -> Column:
        return F.struct(name.alias("name"), shown.cast("bigint").alias("shown"), added.cast("bigint").alias("added"))

    stmts = stmts.withColumns({
        "resets": resets, "unfiltered": unfiltered,
        "own": F.when(resets, nm.chosen_names(line, F.col("found"), kind)).otherwise(F.array().cast("array<string>")),
        "uses": F.filter(
            F.zip_with(nm.normal_names(F.transform("uses.name", lambda n: F.concat(F.lit("TEMPVIEW."), n))), "uses.copies",
                       lambda n, copies: F.struct(n.alias("name"), copies.alias("copies"))),
            lambda u: known(u["name"]) & ~nm.masked_by_line(u["name"], line, upper)),
    })
    # names that the schema test refuses go no further than an unfiltered statement
    own = F.transform("own", lambda n: entry(n, F.lit(1), F.when(known(n) & (F.col("unfiltered") | ~nm.masked_by_line(n, line, upper)), 1).otherwise(0)))
    own = F.filter(own, lambda e: (e.added > 0) | F.col("unfiltered"))
    used = F.transform("uses", lambda u: entry(u["name"], F.when(F.col("resets"), u.copies), u.copies))
    stmts = stmts.withColumn("entries", F.concat(own, used))
    total = lambda n, f: F.aggregate(F.filter("entries", lambda e: e["name"] == n), F.lit(0).cast("bigint"), lambda acc, e: acc + e[f])
    stmts = stmts.withColumn("entries", F.when(F.size("entries") < 2, F.col("entries")).otherwise(F.transform(
        F.array_distinct("entries.name"), lambda n: entry(n, F.when(F.col("resets"), total(n, "shown")), total(n, "added")))))
    needed = [c for c in stmts.columns if c not in ("found", "view", "own_kind", "own", "uses", "unfiltered")]
    return counted(stmts.select(needed), levels, "entries", nm.masked_by_line(F.col("name"), line, upper)).drop("upper")


def name_rows(named: DataFrame) -> DataFrame:
    """One row per statement and name as it is shown, with its number of copies and its X9 flag."""
    shown = named.withColumn("name", nm.shown_name(F.col("name"), F.col("kind"))).withColumnRenamed("name", "table_name")
    return (shown.groupBy([c for c in shown.columns if c != "copies"]).agg(F.sum("copies").alias("copies"))
            .withColumn("in_line", nm.in_line(F.col("table_name"), F.col("line"))))
