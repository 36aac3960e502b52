"""Which names of a script occur in a text, by an equi-join: for long scripts, whose names have no bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# places of a text that are looked at together: what a row holds has a bound, however long the text
_PLACES = 4096
# a script's texts are dealt to so many keys when they meet the index of its names, so that one long script is no hot key
_SALTS = 256


def names_within(texts: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name): every name of `names` (script_id, name; not empty) that is part of a text of `texts` (keys, text), once for each.
    `script_id` is one of the keys.

    Names are indexed by their length and a hash of their first characters. Of a text only the parts that have the length and such a
    beginning of some name are written, piece by piece, and joined with the names.
    """
    head = F.pmod(F.hash(F.substring("name", 1, 3)), F.lit(256))
    sizes = names.groupBy("script_id", F.length("name").alias("size")).agg(F.collect_set(head).alias("heads"))
    scripts = sizes.groupBy("script_id").agg(F.collect_list(F.struct("size", "heads")).alias("sizes"))
    scripts = scripts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salt = F.pmod(F.xxhash64(*keys), F.lit(_SALTS)).cast("int")
    parts = texts.withColumn("salt", salt).join(scripts, ["script_id", "salt"])
    parts = parts.select(*keys, "text", F.explode("sizes").alias("s")).select(*keys, "text", "s.*")
    parts = parts.where(F.length("text") >= F.col("size"))
    first = F.sequence(F.lit(1), F.length("text") - F.col("size") + 1, F.lit(_PLACES))
    parts = parts.select(*keys, "size", "heads", F.explode(F.transform(
        first, lambda at: F.substring("text", at, F.col("size") + _PLACES - 1))).alias("text"))
    places = F.sequence(F.lit(1), F.length("text") - F.col("size") + 1)
    parts = parts.select(*keys, "heads", F.explode_outer(F.array_distinct(F.transform(
        places, lambda at: F.substring("text", at, F.col("size"))))).alias("name"))
    parts = parts.where(F.array_contains("heads", head)).select(*keys, "name").distinct()
    return parts.join(names, ["script_id", "name"]).select(*keys, "name")
