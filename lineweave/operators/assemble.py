"""Line assembly: continued lines, save_dir values, line numbers (L1-L3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.functions.text import strip
from lineweave.operators.scan import running


def join_continuations(lines: DataFrame, levels: int) -> DataFrame:
    """A line ending in a backslash joins the next; the joined line stands at its last piece (L1).

    Lines are numbered by the ends before them, and each number is one aggregate: the pieces of a line meet once, however many there
    are and however many chunks they span."""
    line = F.col("line")
    goes_on = line.endswith("\\")
    piece = F.concat(strip(F.substring(line, F.lit(1), F.length(line) - 1)), F.when(line.contains("="), " ").otherwise(""))
    lines = running(lines, levels, total={"ends": F.when(goes_on, 0).otherwise(1).cast("bigint")})
    place = ["pos", "chunk", "line"] if levels else ["pos", "line"]
    joined = lines.groupBy("script_id", "prev_ends").agg(
        F.max(F.when(F.col("ends") == 1, F.struct(*place))).alias("last"),
        F.collect_list(F.when(F.col("ends") == 0, F.struct("pos", piece.alias("piece")))).alias("pieces"))
    joined = joined.where(F.col("last").isNotNull()).withColumn(
        "head", F.when(F.size("pieces") > 0, F.array_join(F.array_sort("pieces").piece, "")).otherwise(""))
    whole = F.when(F.col("head") != "", F.concat("head", strip(F.col("last.line")))).otherwise(F.col("last.line"))
    return joined.select("script_id", *[f"last.{c}" for c in place[:-1]], whole.alias("line"))


def fill_save_dir(lines: DataFrame, levels: int) -> DataFrame:
    """Write statements take the current `save_dir` value; lines that set it go; lines are numbered (L2, L3)."""
    line = F.col("line")
    sets = line.contains("save_dir") & line.contains("=")
    value = F.concat(F.lit("save_dir-"), strip(F.split_part(line, F.lit("="), F.lit(2))))
    writes = line.startswith("df_") & line.contains(".write")
    lines = running(lines, levels, last={"dir": F.when(sets, value)},
                    total={"kept": F.when(sets, 0).otherwise(1).cast("bigint")})
    return (lines.where("kept = 1")
            .withColumn("line", F.when(writes, F.replace(line, F.lit("save_dir"), F.coalesce("prev_dir", F.lit(""))))
                        .otherwise(line))
            .withColumn("line_no", F.col("prev_kept") + 1)
            .drop("dir", "prev_dir", "kept", "prev_kept"))
