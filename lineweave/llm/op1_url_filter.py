"""URL filter: a list of rules as a sorted array of 64-bit digests that tasks map and probe by vectorised binary search.

A rule is (host, path, verdict). It fits its host and all subdomains of it, for urls whose path starts with the rule's path;
of the rules that fit, the one with the longest text (host and path) wins, then the one with the longer host. Every rule is
one digest. For a url the candidates are the host endings and path beginnings of the sizes that occur among the rules, so
their number is bounded by the list and not by the url. A digest that is found is confirmed against the stored full string.

Null urls and urls without `://` have an empty host and path and fit no rule. Rules with a null host or path are left out;
of equal rules with different verdicts block wins. An empty list gives every url the default verdict. Repeated rows give
repeated rows. Columns of the input named like those of the result are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm import hash_arrays

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"://([^/?#]*)([^?#]*)"

#: (host, path, verdict) of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _labels(host: Column) -> Column:
    return F.split(host, r"\.", -1)


class UrlRules:
    """The digest array of a list and the sizes (labels of the host, characters of the path) that its rules have."""

    def __init__(self, rules: DataFrame):
        rules = (rules.where("host is not null and path is not null").groupBy("host", "path")
                 .agg(F.max("verdict").alias("verdict")).select(F.concat("host", "path").alias("rule"), "host", "path", "verdict"))
        sizes = rules.select(F.size(_labels(F.col("host"))).alias("labels"), F.length("path").alias("chars"),
                             F.length("rule").alias("size")).distinct()
        # bounded by the host labels times path lengths that urls can have, not by the number of rules
        self.sizes = sorted({(r["labels"], r["chars"]) for r in sizes.collect()})
        self.arrays = hash_arrays.build(rules.select(
            hash_arrays.text_key("host", "path").alias("key"), "host", "path", F.coalesce("verdict", F.lit("")).alias("verdict")))

    def judged(self, urls: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
        """urls with host, path, rule (null where none fits) and verdict."""
        host, path, labels = F.col("host"), F.col("path"), _labels(F.col("host"))
        here = urls.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
        candidates = [
            F.when((F.size(labels) >= n) & (F.length(path) >= chars), F.struct(
                (F.length(F.array_join(F.slice(labels, -n, n), ".")) + chars).alias("size"),
                F.array_join(F.slice(labels, -n, n), ".").alias("host"), F.substring(path, 1, chars).alias("path")))
            for n, chars in self.sizes]
        if not candidates:
            return here.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
        found = F.sort_array(F.array_compact(F.array(*candidates)), asc=False)
        keys = F.transform(found, lambda x: hash_arrays.text_key(x["host"], x["path"]))
        hit = _probe(self.arrays)(keys, found["host"], found["path"])
        return (here.withColumn("_hit", hit)
                .withColumns({"rule": F.col("_hit.rule"), "verdict": F.coalesce("_hit.verdict", F.lit(default))}).drop("_hit"))


def _probe(arrays: hash_arrays.HashArrays) -> Column:
    @F.pandas_udf("rule string, verdict string")
    def probe(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        mapped = arrays.open()
        for keys, hosts, paths in parts:
            sizes = keys.map(len).to_numpy(np.int64)
            flat = np.concatenate([np.asarray(k, np.int64) for k in keys]) if sizes.sum() else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(keys)), sizes)
            nth = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at, found = mapped.first(flat)
            rule, verdict = [None] * len(keys), [None] * len(keys)
            for i in np.flatnonzero(found):  # candidates stand longest first
                r = row[i]
                if rule[r] is None:
                    rule[r], verdict[r] = _confirmed(mapped, int(at[i]), hosts.iloc[r][nth[i]], paths.iloc[r][nth[i]])
            yield pd.DataFrame({"rule": rule, "verdict": verdict}, dtype=object)
    return probe


def _confirmed(mapped: hash_arrays.Arrays, at: int, host: str, path: str) -> tuple[str | None, str | None]:
    """The rule among those with the same digest whose stored strings are these."""
    key = mapped.keys[at]
    while at < len(mapped.keys) and mapped.keys[at] == key:
        if mapped.bytes_at("host", at) == host.encode() and mapped.bytes_at("path", at) == path.encode():
            return host + path, mapped.bytes_at("verdict", at).decode()
        at += 1
    return None, None


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by RULES; urls without a rule are allowed."""
    rules = UrlRules(spark.createDataFrame(RULES, "host string, path string, verdict string"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return rules.judged(pages).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT p.page_id, p.host, p.path, max_by(rhost || rpath, length(rhost || rpath)) AS rule,
    max_by(rverdict, length(rhost || rpath)) AS verdict
  FROM (SELECT row_number() OVER () AS n, * FROM parts) p
  LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY p.n, p.page_id, p.host, p.path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best
"""
