"""A script corpus derived from the `orders` table: one customer is one script, one order one block.

Only the template texts are ours; how many scripts, blocks and lines there are follows the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# `~` separates lines. <a>, <b>, <c> are numbers from the keys, <bs> a backslash, <sq> a quote.
HEADER = (
    'DB_SWG = DwCfg.SWG_P~DB_ACT = MartCfg.ACT_T~DB_TMP = "TMP"~DB_STG = "STG"~DB_BAD = "ZZZ"~DB_BCM = "BCM"'
)
BLOCKS = [
    '# load step~import os~df_T<a> = spark.sql(f"""~SELECT A.ID, B.NM  -- note~  FROM {DB_SWG}.TB_<a> A /* x */'
    '~  LEFT OUTER JOIN {DB_ACT}.TB_<b> B ON A.ID = B.ID~""")',
    'df_T<a>.createOrReplaceTempView("V_T<c>")',
    'df_Q<a> = spark.sql("""~SELECT X.ID FROM V_T<c> X~""")',
    'spark.sql(f"""~INSERT OVERWRITE TABLE {MartCfg.DB_TMP}.TB_<b>~SELECT S.* FROM {MartCfg.DB_ACT}.TB_<a> S~""")',
    'df_P<a> = spark.read.parquet(f"{DB_STG}/TB_<b>")',
    'save_dir = f"/TMP/TB_<a>"~df_P<a>.write.mode("overwrite") <bs>~.parquet(save_dir + "/p")',
    'spark.sql(f"DROP TABLE IF EXISTS {DB_TMP}.TB_<a>")~spark.sql(f"""~CREATE TABLE {DB_TMP}.TB_<a>'
    '~LOCATION <sq>/w/<b><sq>~""")',
    'df_U<a> = df_P<a>.union(df_Q<b>)~print("done")',
    'SELECT 1~FROM NODOT~  JOIN {DB_BAD}.TB_<a> Z',
    'try:~    spark.sql(f"ALTER TABLE {DB_BCM}.TB_<b> ADD COLUMN X")~-- end~spark.stop()',
]
HEADER_LINES = HEADER.count("~") + 1
# One order in 97 has this block instead: a write without a path, which ends its script.
BAD_BLOCK = 'df_W<a>.write.mode("overwrite").parquet(target_<a>)~SELECT 1 FROM {DB_SWG}.TB_<b> Y'
BLOCKS.append(BAD_BLOCK)

# Statements of the orders with blocks of the last kind, which hold none: nested and listed references.
SHAPES = [
    "SELECT 1 FROM SWG.A<a> x WHERE x.p IS DISTINCT FROM y.q AND x.r IS NOT DISTINCT FROM z.s",
    "SELECT EXTRACT(YEAR FROM CAST(COALESCE(a, NVL(b, TRIM(c))) AS DATE)) FROM act.t<a>",
    "SELECT 1 FROM ONLY tmp.t<a>",
    "SELECT 1 FROM (SELECT 1 FROM swg.a<a>) q, TMP.After<b>",
    "SELECT 1 FROM swg.t<a> TABLESAMPLE (10 PERCENT) x, tmp.t<b>",
    "SELECT 1 FROM swg.f<a>(g(h(1))) f, tmp.z<b>",
    "SELECT 1 FROM swg.a<a> JOIN (tmp.b<b> JOIN act.c<a> ON 1 = 1) ON 2 = 2 JOIN stg.d<b> USING (id), gone.t",
    "MERGE INTO swg.t<a> t USING tmp.u<b> u ON t.i = u.i WHEN MATCHED THEN UPDATE SET v = 1",
    "DELETE FROM swg.t<a> USING tmp.u<b> WHERE 1 = 1",
    "WITH q AS (SELECT 1 FROM swg.a<a>, (SELECT 2 FROM tmp.b<b>) z, stg.c<a>) SELECT 1 FROM q, LATERAL (SELECT 1 FROM act.e<b>) l, bcm.f<a>",
    "SELECT 1 FROM ((SELECT 1 FROM swg.a<a>) UNION (SELECT 2 FROM tmp.b<b>)) q WHERE x IN (SELECT (SELECT max(i) FROM act.h<a>) FROM stg.i<b>)",
]

# Orders of one script are numbered in key ranges of 2^18 keys, so that no range is unbounded.
KEY_RANGE_BITS = 18


def _kind(order_key: Column) -> Column:
    return F.when(order_key % 97 == 5, 10).otherwise(order_key % 10)


def _block_text(order_key: Column, cust_key: Column) -> Column:
    kind = _kind(order_key)
    text = reduce(lambda acc, k: acc.when(kind == k, BLOCKS[k]), range(1, len(BLOCKS)), F.when(kind == 0, BLOCKS[0]))
    marks = {
        "<a>": (order_key % 97).cast("string"), "<b>": (order_key % 89).cast("string"),
        "<c>": (cust_key % 7).cast("string"), "<bs>": F.lit("\\"), "<sq>": F.lit("'"),
    }
    return reduce(lambda acc, m: F.replace(acc, F.lit(m), marks[m]), marks, text)


def _block_lines(order_key: Column) -> Column:
    per_kind = [b.count("~") + 1 for b in BLOCKS]
    kind = _kind(order_key)
    n = reduce(lambda acc, k: acc.when(kind == k, per_kind[k]), range(1, len(BLOCKS)), F.when(kind == 0, per_kind[0]))
    return n.cast("bigint")


def script_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(script_id, n_src_lines), from the keys alone."""
    return orders_of(spark, sf_dir).groupBy("script_id").agg(
        (F.sum(_block_lines(F.col("blk"))) + HEADER_LINES).alias("n_src_lines"))


def orders_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").alias("script_id"), F.col("o_orderkey").alias("blk"))


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """script_lines: (script_id, blk, p, src_line_no, n_src_lines, line).

    Line numbers are a prefix sum in two steps, within a key range and over the ranges of a script,
    so one customer owning a large share of all orders is still numbered by many tasks.
    """
    orders = orders_of(spark, sf_dir).withColumns({
        "rng": F.shiftright("blk", KEY_RANGE_BITS), "n": _block_lines(F.col("blk"))})

    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    in_range = orders.withColumn(
        "lead_lines", F.coalesce(F.sum("n").over(
            before.partitionBy("script_id", "rng").orderBy("blk")), F.lit(0)))
    ranges = (orders.groupBy("script_id", "rng").agg(F.sum("n").alias("n"))
              .select("script_id", "rng",
                      F.coalesce(F.sum("n").over(before.partitionBy("script_id").orderBy("rng")), F.lit(0)).alias("base"),
                      (F.sum("n").over(Window.partitionBy("script_id")) + HEADER_LINES).alias("n_src_lines")))

    first = F.col("start") == 0
    text = F.concat(F.when(first, HEADER + "~").otherwise(""), _block_text(F.col("blk"), F.col("script_id")))
    return (in_range.join(ranges, ["script_id", "rng"])
            .withColumn("start", F.col("base") + F.col("lead_lines"))
            .select("script_id", "blk", "start", "n_src_lines",
                    F.posexplode(F.split(text, "~")).alias("i", "line"))
            .select("script_id",
                    F.when(first & (F.col("i") < HEADER_LINES), F.lit(-1)).otherwise(F.col("blk")).alias("blk"),
                    F.when(first & (F.col("i") >= HEADER_LINES), F.col("i") - HEADER_LINES).otherwise(F.col("i")).alias("p"),
                    (F.col("start") + F.when(first, 0).otherwise(HEADER_LINES) + F.col("i") + 1).alias("src_line_no"),
                    "n_src_lines", "line"))


def corpus_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """statements: (script_id, stmt_no, sql), the bodies of the triple-quoted blocks, `${…}` marks, and SHAPES for
    the orders of the last kind. The keys, a few bytes each, are dealt out before they become text: a small table is one split."""
    body = F.regexp_extract(_block_text(F.col("blk"), F.col("script_id")), r'"""~(.*)~"""', 1)
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (F.floor(F.col("blk") / 10) % len(SHAPES) + 1).cast("int"))
    for mark, n in (("<a>", 97), ("<b>", 89)):
        shape = F.replace(shape, F.lit(mark), (F.col("blk") % n).cast("string"))
    # a given number, as Spark would merge partitions by the size of the keys
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (orders_of(spark, sf_dir).repartition(tasks, "blk")
            .select("script_id", F.col("blk").alias("stmt_no"),
                    F.when(F.col("blk") % 10 == 9, shape).otherwise(
                        F.replace(F.replace(body, F.lit("~"), F.lit("\n")), F.lit("{"), F.lit("${"))).alias("sql"))
            .where(F.col("sql") != ""))
