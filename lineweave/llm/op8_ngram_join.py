"""N-gram Jaccard join with a token-group matrix.

A document is the set of its runs of `size` words (A-Z in lower case); one with fewer words is one run of them all, one without
words is empty and linked with nothing. Two documents are linked when their sets have a Jaccard similarity of `percent` or more
(Measure: 5 words and 80 % unless given otherwise).
Every document gets its class: the smallest doc_id that it reaches by links.

1. Equal sets are one node. Sets list their runs by rarity, counted over all texts; similar sets share one of the first
   n - ceil(t n) + 1 runs (the prefix). Runs in one prefix only go no further.
2. Each node is compared with one head. The head of a run is the holder that lacks fewest of its own prefix runs elsewhere: of
   copies with random edits the one closest to the original. Nodes that were tested are then compared in rounds with one member, dealt
   by a hash of the round, of the largest class that holds most of their prefix runs. A round makes no more tests than there are
   nodes; rounds end when fewer than one test in SUCCESS finds a link. They only lighten step 4, which finds all links between classes.
3. The partition: nodes go to their class, single ones to the head with which they share most prefix runs, and the nodes of each are cut
   into groups of about GROUP members. The token-group matrix holds which prefix runs occur in which group; each group that is asked
   for keeps its members' whole sets and their union.
   Nodes that share too few prefix runs with nodes of other classes, all taken together, are left out of both.
4. A node asks the groups with which it shares prefix runs, whose sizes can match and which hold a later class. Prefix runs in common
   bound the overlap first, the union of the group then; only groups whose bounds reach t are opened, and their
   members of later classes compared one by one. Links within a class need no search: they can't change the classes.

Every link between different classes is found, whatever the size of groups. Null texts count as empty; rows with null doc_id
take part and take the smallest known id of their class. Repeated rows get the same result. Columns of the input named like
those of the result are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm import sets, words
from lineweave.llm.shared import dropped, scratch, stored

#: Members of a group; tests of a round of which one must find a link for another round; rows of which one must go for another.
GROUP, SUCCESS, LEFT_OUT = 32, 20, 4


@dataclass(frozen=True)
class Measure:
    """Words of a run, and the similarity in percent from which on documents are linked."""

    size: int = 5
    percent: int = 80

    def prefix(self, n):
        """Runs of a set of n, of which two similar sets share one."""
        return n - -(-self.percent * n // 100) + 1

    def prefix_column(self, n: Column) -> Column:
        return n - F.ceil(n * self.percent / 100) + 1

    def alike(self, x: Column, y: Column) -> Column:
        return (100 * x >= self.percent * y) & (100 * y >= self.percent * x)

    def similar(self, x: str | Column, y: str | Column) -> Column:
        shared = F.size(F.array_intersect(x, y))
        return 100 * shared >= self.percent * (F.size(x) + F.size(y) - shared)

    def enough(self, m: Column, n: Column, least: Column, most: Column) -> Column:
        """Whether sets of n runs and of least to most runs that share m runs of their prefixes can be similar. Of two prefixes one
        ends first in the order of runs; all its other runs are missing in the other set."""
        behind = F.greatest(n - self.prefix_column(n), most - self.prefix_column(most))
        return (100 + self.percent) * (m + behind) >= self.percent * (n + F.greatest(least, F.ceil(n * self.percent / 100)))


def runs(column: pa.Array, run_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of all texts of a column, and their rows."""
    found, rows, _ = words.flat_words(column)
    n = np.bincount(rows, minlength=len(column))
    at = np.flatnonzero(rows[run_size - 1 :] == rows[: len(rows) - run_size + 1]) if len(rows) >= run_size else np.zeros(0, np.int64)
    hashes, where = words.window_hashes(found, run_size)[at], rows[at]
    for size in range(1, run_size):  # texts of fewer words are one run
        short = np.flatnonzero(n == size)
        if len(short):
            starts = np.searchsorted(rows, short)
            hashes = np.concatenate([hashes, words.window_hashes(found, size)[starts]])
            where = np.concatenate([where, short])
    return hashes, where


def _sets(column: pa.Array, levels: np.ndarray, run_size: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The ordered sets of a column one after the other, their starts (the last is the end), and their keys."""
    hashes, rows = runs(column, run_size)
    values, rows = words.distinct_in_groups(sets.ranked(hashes, levels), rows)
    starts = np.searchsorted(rows, np.arange(len(column) + 1))
    data = memoryview(values.tobytes())
    return values, starts, [xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def document(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identity and place of a document, null ids last."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))


ROWS = "doc struct<none: boolean, id: bigint, h: bigint>, key binary, n long, prefix array<bigint>"


def sets_of(docs: DataFrame, levels: np.ndarray, measure: Measure) -> DataFrame:
    """doc, key of the set, its size, and its prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches):
            values, starts, keys = _sets(batch["text"], levels, measure.size)
            n = np.diff(starts)
            size = np.where(n > 0, measure.prefix(n), 0)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[:-1], size)
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values[at].view(np.int64)))
            yield pa.record_batch([batch["doc"], pa.array(keys, pa.binary()), pa.array(n, pa.int64()), prefix], ["doc", "key", "n", "prefix"])
    return docs.select(document().alias("doc"), "text").mapInArrow(run, ROWS)


def _whole_sets(docs: DataFrame, levels: np.ndarray, measure: Measure, keys: DataFrame) -> DataFrame:
    """(key, runs) of the sets of the keys, and of some others: keys are told apart by a bitmap."""
    wanted = sets.bitmap(keys.select(sets.number("key").alias("k")), "k", keys.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches):
            values, starts, found = _sets(batch["text"], levels, measure.size)
            numbers = np.frombuffer(b"".join([k[:8] for k in found]), np.int64)
            hit = np.flatnonzero(sets.in_bitmap(wanted, numbers) & (np.diff(starts) > 0))
            once = {found[i]: i for i in hit.tolist()}
            if once:
                runs_ = [values[starts[i] : starts[i + 1]].view(np.int64) for i in once.values()]
                yield pa.record_batch([pa.array(list(once), pa.binary()), pa.array(runs_, pa.list_(pa.int64()))], ["key", "runs"])
    return docs.select("text").mapInArrow(run, "key binary, runs array<bigint>").groupBy("key").agg(F.first("runs").alias("runs"))


def _prefix_rows(nodes: DataFrame, shared: np.ndarray) -> DataFrame:
    """One row per prefix run that may be in another prefix: token, key, n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch["prefix"]
            flat, sizes = prefix.flatten().to_numpy(), np.diff(prefix.offsets.to_numpy())
            rows = np.repeat(np.arange(len(sizes)), sizes)
            hit = np.flatnonzero(sets.in_bitmap(shared, flat))
            at = pa.array(rows[hit])
            yield pa.record_batch([pa.array(flat[hit]), batch["key"].take(at), batch["n"].take(at)], ["token", "key", "n"])
    return nodes.select("key", "n", "prefix").mapInArrow(run, "token bigint, key binary, n bigint")


def _pairs(pairs: DataFrame, whole: DataFrame, measure: Measure) -> DataFrame:
    """Pairs (a, b) of keys whose sets are similar."""
    of = lambda key, runs: whole.select(F.col("key").alias(key), F.col("runs").alias(runs))
    return pairs.join(of("a", "ra"), "a").join(of("b", "rb"), "b").where(measure.similar("ra", "rb"))


def _open(rows: DataFrame, measure: Measure, label: str) -> DataFrame:
    """rows (token, key, n, root) of nodes that can still have a link to another class, with m, their number: enough of a node's runs occur in
    prefixes of others, of sizes that can match. Repeated, as nodes that go leave runs to one class only, until a round takes less than one
    row in LEFT_OUT. A node's runs are gathered as in its prefix, of which they are a part."""
    n, low, high = F.col("n"), F.ceil(F.col("n") * measure.percent / 100), F.floor(F.col("n") * 100 / measure.percent)
    rows = stored(rows, label)
    while True:
        tokens = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
        shared = rows.select("token", "key", "n", "root").join(tokens.where("lo < hi").select("token", "least", "most"), "token")
        nodes = shared.where((F.col("least") <= high) & (F.col("most") >= low)).groupBy("key", "n", "root").agg(
            F.collect_list("token").alias("tokens"), F.min(F.greatest("least", low)).alias("least"), F.max(F.least("most", high)).alias("most"))
        alive = nodes.where(measure.enough(F.size("tokens"), n, F.col("least"), F.col("most")))
        kept = stored(alive.select(F.explode("tokens").alias("token"), "key", "n", "root", F.size("tokens").alias("m")), label)
        before, after = rows.count(), kept.count()
        dropped(rows)
        rows = kept
        if (before - after) * LEFT_OUT <= before:
            return rows


def _tests(rows: DataFrame, heads: DataFrame, measure: Measure) -> DataFrame:
    """(a, b): for each node the head of another class with which it shares most runs. rows: token, key, n, root; heads: token, head (key, n, root).

    A node that shares m prefix runs with its head can share no more than m and all behind the prefix; heads of other runs may be other
    copies, so a third of the runs needed is enough to try. What is not tried is left to the groups."""
    head = F.col("head")
    shared = (rows.join(heads, "token").where((F.col("root") != head["root"]) & measure.alike(F.col("n"), head["n"]))
              .groupBy("key", "n", "head").agg(F.count("*").alias("m")).where(measure.enough(3 * F.col("m"), F.col("n"), head["n"], head["n"])))
    return shared.groupBy(F.col("key").alias("a")).agg(F.min_by("head.key", F.struct(-F.col("m"), "head.key")).alias("b"))


def _stars(held: DataFrame, docs: DataFrame, levels: np.ndarray, measure: Measure) -> tuple[DataFrame, DataFrame]:
    """The first tests (a, b), and the classes (node, root) that the tests of all rounds make."""
    rows = held.withColumn("lacks", measure.prefix_column(F.col("n")) - F.col("m"))
    heads = rows.groupBy("token").agg(F.min(F.struct("lacks", "key", "n", "root")).alias("head")).select(
        "token", F.struct("head.key", "head.n", "head.root").alias("head"))
    first = tests = stored(_tests(rows, heads, measure), "tests")
    keys = stored(first.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "tested")
    whole = stored(_whole_sets(docs, levels, measure, keys), "whole-sets")
    tested = stored(held.select("token", "key", "n").join(keys, "key"), "tested")
    found, links_, round_ = None, None, 0
    while True:
        new = stored(_pairs(tests, whole, measure).select("a", "b"), "star")
        links_ = new if links_ is None else links_.unionByName(new)
        if found is None or not new.isEmpty():
            found = sets.components(links_)
        if new.count() * SUCCESS < max(1, tests.count()):
            break
        round_ += 1
        rows = stored(tested.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "tested")
        classes = rows.groupBy("token", "root").agg(F.count("*").alias("c"), F.min_by(F.struct("key", "n", "root"), F.xxhash64("key", F.lit(round_))).alias("head"))
        heads = classes.groupBy("token").agg(F.max_by("head", F.struct("c", "root")).alias("head"))
        tests = stored(_tests(rows, heads, measure), "tests")
        dropped(rows)
    dropped(whole)
    return first, found


def links(nodes: DataFrame, docs: DataFrame, levels: np.ndarray, measure: Measure) -> DataFrame:
    """(a, b): links of keys, enough of them to hold every class together."""
    counts = stored(nodes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"), "tokens")
    held = _open(_prefix_rows(nodes, sets.bitmap(counts, "token", counts.count())).withColumn("root", F.col("key")), measure, "held")
    dropped(counts)
    tests, roots = _stars(held, docs, levels, measure)

    classed = roots.select(F.col("node").alias("key"), "root")
    pivots = tests.select(F.col("a").alias("key"), F.col("b").alias("pivot"))
    held = _open(held.select("token", "key", "n").join(classed, "key", "left").withColumn("root", F.coalesce("root", "key")), measure, "open")
    members = (held.select("key", "n", "root").distinct().join(pivots, "key", "left")
               .select("key", "n", "root", F.when(F.col("root") != F.col("key"), F.col("root")).otherwise(F.coalesce("pivot", "key")).alias("pivot")))
    parts = members.groupBy("pivot").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    members = stored(members.join(parts, "pivot").select(
        "key", "n", "root", F.struct("pivot", F.pmod(F.xxhash64("key"), F.col("parts")).alias("part")).alias("group")), "members")
    rows = held.select("token", "key").join(members, "key")
    matrix = rows.groupBy("token", "group").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("root").alias("last"))
    asks = (rows.select("token", "key", "root", "n").join(matrix, "token").where(F.col("root") < F.col("last"))
            .where((100 * F.col("most") >= measure.percent * F.col("n")) & (100 * F.col("n") >= measure.percent * F.col("least")))
            .groupBy("key", "root", "n", "group").agg(F.count("*").alias("m"), F.min("least").alias("least"), F.max("most").alias("most"))
            .where(measure.enough(F.col("m"), F.col("n"), F.col("least"), F.col("most"))))
    asks = stored(asks.select("key", "root", "n", "group"), "asks")
    asked = members.join(asks.select("group").distinct(), "group")
    whole = stored(_whole_sets(docs, levels, measure, asked.select("key").union(asks.select("key")).distinct()), "whole-sets")

    # one row per group: its members and their union; at most GROUP and a few more sets, as the parts of a pivot are even
    groups = asked.join(whole, "key").groupBy("group").agg(
        F.collect_list(F.struct("key", "root", "runs")).alias("members"), F.array_distinct(F.flatten(F.collect_list("runs"))).alias("union"), F.min("n").alias("least"))
    own = asks.join(whole, "key").select(F.col("key").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("runs").alias("asked"), "group")
    bound = 100 * F.size(F.array_intersect("asked", "union")) >= measure.percent * F.greatest(F.col("na"), F.col("least"))
    linked = F.filter("members", lambda x: (x["root"] > F.col("ra")) & measure.similar(F.col("asked"), x["runs"]))
    more = (own.join(groups, "group").where(bound).select("a", F.explode(F.transform(linked, lambda x: x["key"])).alias("b")))
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)


def classified(docs: DataFrame, measure: Measure = Measure()) -> DataFrame:
    """doc (identity), n_shingles, and head: the document that stands for the class, the smallest id of it."""
    with scratch(docs.sparkSession):
        levels = sets.rarity(docs, lambda column: runs(column, measure.size)[0])
        rows = stored(sets_of(docs, levels, measure), "sets")
        nodes = stored(rows.where("n > 0").groupBy("key").agg(
            F.min("doc").alias("first"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "nodes")
        roots = sets.components(links(nodes, docs, levels, measure)).withColumnRenamed("node", "key")
        joined = nodes.select("key", "first").join(roots, "key")
        heads = joined.groupBy("root").agg(F.min("first").alias("class"))
        classes = joined.join(heads, "root").select("key", "class")
        heads = nodes.select("key", "first").join(classes, "key", "left").select("key", F.coalesce("class", "first").alias("head"))
        return stored(rows.select("doc", "key", "n").join(heads, "key", "left").select(
            "doc", F.col("n").alias("n_shingles"), F.coalesce("head", "doc").alias("head")), "classes", keep=True)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set and its class, by runs of four words and 85 %."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classified(docs, Measure(4, 85)).select(F.col("doc.id").alias("doc_id"), "n_shingles", F.col("head.id").alias("component_id"))


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that with the smallest doc_id. Documents without words all stay."""
    keep = classified(docs.select("doc_id", "text")).where("n_shingles = 0 or doc = head").select("doc", "n_shingles").distinct()
    rows = docs.withColumn("_doc", document())
    kept = rows.join(keep.withColumnRenamed("doc", "_doc"), "_doc")
    once = kept.where("n_shingles > 0").dropDuplicates(["_doc"])
    return once.unionByName(kept.where("n_shingles = 0")).select(*docs.columns)
