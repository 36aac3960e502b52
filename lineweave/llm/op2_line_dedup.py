"""Line dedup by exact set-similarity join.

A line is the set of its words (A-Z in lower case). A line with a word is removed when an earlier line, by doc_id and line
number, has a Jaccard similarity of PERCENT or more; whether that line is removed itself makes no difference, so the result
does not depend on any order of work. Lines without words stay.

Lines of equal sets are settled first, by a key of the set, whatever their size; only the first line of a set goes on. Distinct sets that may be similar to others are numbered in the
order of their first lines; from there on a set is one number. Sets list their words by rarity, counted over
all texts. Prefix filter: let a set of n words have a words that a similar one has not, and that one b others; a + 0.8 b <= n / 5. Of
their first 2 (a + b) + 3 shared words, in order, some three in a row have none of the a + b other words between them, so they are
neighbours in both sets, among the first 3 a + 2 b + 3 <= 3 n / 5 + 3 words. Such runs of three are the tokens of the join: two unrelated
lines often share a rare word, and in large tables two in a row, but hardly three. Sets too small for runs of three, and sets
that may be similar to those, have runs of two among the first 2 a + b + 2 <= 2 n / 5 + 2 words. Sets of up to three words are similar to equal
sets only and have no tokens. Runs that occur once go no further. Candidates must have sizes within t (length filter), enough words after the
shared place (positional filter), and signatures near each other: every word flips one bit of 128, so signatures differ in no more
bits than sets differ in words. Words themselves are read from the texts again, for the sets of the pairs that are left.

Each set is first compared with the earliest holder of each of its tokens, which decides almost all lines of a group of near copies; only
sets that this does not decide meet the next HEADS - 1 holders, which is linear in the rows too, and then all others. Pairs are verified on
the whole sets.

Null and empty texts have no lines to remove. Documents are told apart by doc_id and text; repeated rows are one
document and get the same result; null ids come first. Columns of the input named like those of the result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineweave.llm import sets, words
from lineweave.llm.shared import dropped, scratch, stored

#: Similarity in percent; the prefixes below are for 80 %. Sets of fewer than LEAST words have no similar set but equal ones; sets of
#: LONG words and more have runs of three as tokens.
PERCENT, LEAST, LONG = 80, 4, 12


def _line_sets(column: pa.Array, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines with words: row, line, start of the set, and (one after the other) the sets; the last start is the end."""
    hashes, rows, lines = words.flat_words(column)
    if not len(hashes):
        return rows, lines, np.zeros(1, np.int64), hashes
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (lines[1:] != lines[:-1])])
    group, heads = np.cumsum(new) - 1, np.flatnonzero(new)
    values, group = words.distinct_in_groups(sets.ranked(hashes, levels), group)
    return rows[heads], lines[heads], np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(heads)))]), values


def _tokens(starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs in the prefixes, with set (rising) and place."""
    n = np.diff(starts)
    found = []
    for size, judged, prefix in ((2, (n >= LEAST) & (PERCENT * n <= 100 * (LONG - 1)), 2 * n // 5 + 2), (3, n >= LONG, 3 * n // 5 + 3)):
        count = np.where(judged, np.minimum(n, prefix) - size + 1, 0)
        group = np.repeat(np.arange(len(n)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        found.append((words.window_hashes(values, size)[starts[:-1][group] + place].view(np.int64), group, place))
    token, group, place = map(np.concatenate, zip(*found))
    order = np.argsort(group, kind="stable")
    return token[order], group[order], place[order]


def document_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identity and place of a document: its id, null first, and a hash of the text."""
    return F.struct(F.col(doc_id).isNotNull().alias("known"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("id"),
                    F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))


def _keys(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """128-bit keys of the sets, as two columns of 64."""
    data = memoryview(values.tobytes())
    found = [xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


LINES = "doc struct<known: boolean, id: bigint, h: bigint>, line int, k1 long, k2 long"


def _lines_of(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """One row per line with words: doc, line, key of its set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches, 1024):
            rows, lines, starts, values = _line_sets(batch["text"], levels)
            if len(starts) > 1:
                keys = _keys(starts, values)
                yield pa.record_batch([batch["doc"].take(pa.array(rows)), pa.array(lines, pa.int32()), pa.array(keys[:, 0]), pa.array(keys[:, 1])],
                                      ["doc", "line", "k1", "k2"])
    return docs.select(document_key().alias("doc"), "text").mapInArrow(run, LINES)


def _place_numbers(doc: pa.StructArray, line: np.ndarray) -> np.ndarray:
    """A 64-bit hash of document and line."""
    h, i = (doc.field(f).to_numpy(zero_copy_only=False).view(np.uint64) for f in ("h", "id"))
    return words.mixed(words.mixed(h + words.mixed(i)) + line.astype(np.uint64)).view(np.int64)


def _having(rows: DataFrame, bits: np.ndarray, kinds: str, key: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows whose key may be in the bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sets.in_bitmap(bits, key(batch))))
    return rows.mapInArrow(run, kinds)


@dataclass(frozen=True)
class Firsts:
    """Tells the first line of each set from its copies: a bitmap of the keys of sets with several places, and one of the first places
    of all sets that the former takes for such. Some copies pass as well; no first line fails.

    copied: (k1, k2, doc, line) of all lines of such sets; first: their first places, with `several` true where there is another."""

    repeated: np.ndarray
    places: np.ndarray
    copied: DataFrame
    first: DataFrame

    @staticmethod
    def of(lines: DataFrame) -> Firsts:
        many = stored(lines.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1"), "copied")
        repeated = sets.bitmap(many, "k1", many.count())
        dropped(many)
        copied = _having(lines, repeated, LINES, lambda batch: batch["k1"].to_numpy())
        place = F.struct("doc", "line")
        first = stored(copied.groupBy("k1", "k2").agg(F.min(place).alias("first"), (F.min(place) != F.max(place)).alias("several")), "places")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([pa.array(_place_numbers(batch["doc"], batch["line"].to_numpy()))], ["k"])
        return Firsts(repeated, sets.bitmap(first.select("first.doc", "first.line").mapInArrow(run, "k long"), "k", first.count()), copied, first)

    def later(self) -> DataFrame:
        """(doc, line) of the lines that are not the first of their set."""
        return (self.copied.join(self.first.where("several"), ["k1", "k2"]).where(F.struct("doc", "line") != F.col("first"))
                .select("doc", "line"))

    def judge(self) -> Judge:
        return Judge(self.repeated, self.places)


@dataclass(frozen=True)
class Judge:
    """What tasks need of Firsts."""

    repeated: np.ndarray
    places: np.ndarray

    def judged(self, batch: pa.RecordBatch, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, lines, starts and sets of those lines of a batch that are first and whose sets have tokens."""
        rows, lines, starts, values = _line_sets(batch["text"], levels)
        n = np.diff(starts)
        if not len(n):
            return rows, lines, starts, values
        place = _place_numbers(batch["doc"].take(pa.array(rows)), lines)
        mine = n >= LEAST
        mine[mine] = ~self._copied(starts, values, mine) | sets.in_bitmap(self.places, place[mine])
        return rows[mine], lines[mine], np.concatenate([[0], np.cumsum(n[mine])]), values[np.repeat(mine, n)]

    def _copied(self, starts: np.ndarray, values: np.ndarray, mine: np.ndarray) -> np.ndarray:
        n = np.diff(starts)
        keys = _keys(np.concatenate([[0], np.cumsum(n[mine])]), values[np.repeat(mine, n)])
        return sets.in_bitmap(self.repeated, np.ascontiguousarray(keys[:, 0]))


#: Tokens are exchanged by their first BLOCK_BITS bits, with the next 32; the bitmap of shared ones goes by their first SHARED_BITS bits.
BLOCK_BITS, SHARED_BITS = 10, 27
#: Tokens that a task holds before it sends them.
HELD_TOKENS = 1 << 20


def _token_blocks(docs: DataFrame, levels: np.ndarray, judge: Judge) -> DataFrame:
    """All tokens of the judged lines, cut to 42 bits: blocks of sorted numbers, equal ones as often as they occur."""
    def blocks(found: list[np.ndarray]) -> pa.RecordBatch:
        token = np.sort(np.concatenate(found).view(np.uint64) >> np.uint64(32 - BLOCK_BITS))
        ends = np.searchsorted(token >> np.uint64(32), np.arange((1 << BLOCK_BITS) + 1, dtype=np.uint64))
        low, own = token.astype(np.uint32), np.flatnonzero(np.diff(ends))
        return pa.record_batch([pa.array(own, pa.int32()), pa.array([low[ends[b] : ends[b + 1]].tobytes() for b in own.tolist()], pa.binary())], ["block", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in words.pieces(batches, 2048):
            _, _, starts, values = judge.judged(batch, levels)
            if len(starts) > 1:
                found.append(_tokens(starts, values)[0])
                held += len(found[-1])
            if held >= HELD_TOKENS:
                yield blocks(found)
                found, held = [], 0
        if held:
            yield blocks(found)
    return docs.select(document_key().alias("doc"), "text").mapInArrow(run, "block int, tokens binary")


def shared_tokens(docs: DataFrame, levels: np.ndarray, judge: Judge) -> np.ndarray:
    """A bitmap of the tokens of two sets or more, and few others: each block is sorted and gives its part of the map, so the driver
    receives a map of one size, whatever the input is."""
    def repeated(table: pa.Table) -> pa.Table:
        token = np.sort(np.frombuffer(b"".join(table["tokens"].to_pylist()), np.uint32))
        bits = np.zeros(1 << (SHARED_BITS - BLOCK_BITS), bool)
        bits[token[1:][token[1:] == token[:-1]] >> np.uint32(32 - SHARED_BITS + BLOCK_BITS)] = True
        return pa.table([table["block"][:1], pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    found = _token_blocks(docs, levels, judge).groupBy("block").applyInArrow(repeated, "block int, bits binary").toArrow()
    out = np.zeros((1 << BLOCK_BITS, 1 << (SHARED_BITS - BLOCK_BITS - 3)), np.uint8)
    for block, bits in zip(found["block"].to_pylist(), found["bits"].to_pylist()):
        out[block] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def _is_shared(shared: np.ndarray, token: np.ndarray) -> np.ndarray:
    at = token.view(np.uint64) >> np.uint64(64 - SHARED_BITS)
    return (shared[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _signatures(starts: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """128 bits of each set, of which every word flips one, as two columns of 64."""
    bit, half = np.uint64(1) << (values & np.uint64(63)), (values >> np.uint64(6)) & np.uint64(1)
    return [np.bitwise_xor.reduceat(np.where(half == np.uint64(i), bit, np.uint64(0)), starts[:-1]).view(np.int64) for i in (0, 1)]


OPEN_SETS = "doc struct<known: boolean, id: bigint, h: bigint>, line int, n int, s1 bigint, s2 bigint, tokens array<bigint>, places array<int>"


def _open_sets(docs: DataFrame, levels: np.ndarray, judge: Judge, shared: np.ndarray) -> DataFrame:
    """Sets with tokens that may be in another set: place, size, signature, such tokens with their places in the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches, 1024):
            rows, lines, starts, values = judge.judged(batch, levels)
            if len(starts) == 1:
                continue
            token, group, place = _tokens(starts, values)
            hit = _is_shared(shared, token)
            token, group, place = token[hit], group[hit], place[hit]
            own, n = np.unique(group, return_counts=True)
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(x, kind))
            s1, s2 = _signatures(starts, values)
            yield pa.record_batch([
                batch["doc"].take(pa.array(rows[own])), pa.array(lines[own], pa.int32()), pa.array(np.diff(starts)[own], pa.int32()), pa.array(s1[own]),
                pa.array(s2[own]), lists(token, pa.int64()), lists(place, pa.int32())], ["doc", "line", "n", "s1", "s2", "tokens", "places"])
    return docs.select(document_key().alias("doc"), "text").mapInArrow(run, OPEN_SETS)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by place, each place once: documents that stand in the table twice are one."""
    last = None
    for batch in batches:
        places = list(zip(*[batch["doc"].field(f).to_pylist() for f in ("known", "id", "h")], batch["line"].to_pylist()))
        yield batch.filter(pa.array([a != b for a, b in zip(places, [last, *places])]))
        last = places[-1] if places else last


def _numbered(open_: DataFrame) -> DataFrame:
    """The open sets with numbers (id) in the order of their places."""
    return open_.orderBy("doc", "line").mapInArrow(_once, OPEN_SETS).withColumn("id", F.monotonically_increasing_id())


def _whole_sets(docs: DataFrame, levels: np.ndarray, wanted: DataFrame) -> DataFrame:
    """(id, words) of the wanted sets (id, doc, line), from the texts: only the wanted lines are cut into words."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(_place_numbers(batch["doc"], batch["line"].to_numpy()))], ["k"])
    bits = sets.bitmap(wanted.select("doc", "line").mapInArrow(number, "k long"), "k", wanted.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches, 1024):
            n_lines = pc.add(pc.count_substring(pc.fill_null(batch["text"], ""), "\n"), 1).to_numpy().astype(np.int64)
            rows = np.repeat(np.arange(len(n_lines)), n_lines)
            lines = np.arange(len(rows)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
            hit = sets.in_bitmap(bits, _place_numbers(batch["doc"].take(pa.array(rows)), lines))
            rows, lines = rows[hit], lines[hit]
            if not len(rows):
                continue
            cut: dict[int, list[str]] = {}
            own = []
            for row, line in zip(rows.tolist(), lines.tolist()):
                if row not in cut:
                    cut = {row: (batch["text"][row].as_py() or "").split("\n")}
                own.append(cut[row][line])
            at, _, starts, values = _line_sets(pa.array(own, pa.large_string()), levels)
            whole = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.record_batch([batch["doc"].take(pa.array(rows[at])), pa.array(lines[at], pa.int32()), whole], ["doc", "line", "words"])
    found = docs.select(document_key().alias("doc"), "text").mapInArrow(run, "doc struct<known: boolean, id: bigint, h: bigint>, line int, words array<bigint>")
    # rows of the table may be repeated
    return found.join(wanted, ["doc", "line"]).select("id", "words").dropDuplicates(["id"])


def _near(x: Column, y: Column) -> Column:
    """Length, positional and signature filter of x and y that share the token at their places p; false as well where the tokens before it
    (prev) are equal, so that a pair is met at the first token of a row of shared ones only. The first of all tokens that a pair shares, in the
    order in which y lists them, is never left out."""
    most = F.least(x.p, y.p) + F.least(x.n - x.p, y.n - y.p)
    apart = F.bit_count(x.s1.bitwiseXOR(y.s1)) + F.bit_count(x.s2.bitwiseXOR(y.s2))
    return (~F.coalesce(x.prev == y.prev, F.lit(False)) & (100 * x.n >= PERCENT * y.n) & (100 * y.n >= PERCENT * x.n) & ((100 + PERCENT) * most >= PERCENT * (x.n + y.n))
            & ((100 + PERCENT) * apart <= (100 - PERCENT) * (x.n + y.n)))


def _verified(pairs: DataFrame, whole: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (x, y) of numbers whose sets are similar; `whole` gives the words of sets."""
    pairs = stored(pairs.distinct(), "pairs")
    words_ = stored(whole(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()), "whole-sets")
    both = (pairs.join(words_.select(F.col("id").alias("x"), F.col("words").alias("wx")), "x")
            .join(words_.select(F.col("id").alias("y"), F.col("words").alias("wy")), "y"))
    shared = F.size(F.array_intersect("wx", "wy"))
    found = stored(both.where(100 * shared >= PERCENT * (F.size("wx") + F.size("wy") - shared)).select("x", "y"), "similar")
    dropped(words_)
    dropped(pairs)
    return found


#: Earliest holders of a token that every other holder is compared with.
HEADS = 8


def _met(distinct: DataFrame) -> DataFrame:
    """What the holders of a token find when they meet its earliest holders: token, y (the holder), first (the number of the earliest
    holder, where it is near), others (numbers of the next ones that are near), late (whether there are two or more holders beyond those, and y is one).
    Holders that find nothing are left out. One shuffle by token; heads stand in a column, so no row is made for a pair that is not near."""
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice("tokens", F.lit(1), F.size("tokens") - 1))
    held = (distinct.select("id", "n", "s1", "s2", F.explode(F.arrays_zip("tokens", "places", before.alias("before"))).alias("t"))
            .select(F.col("t.tokens").alias("token"), F.struct("id", "n", F.col("t.places").alias("p"), F.col("t.before").alias("prev"), "s1", "s2").alias("y")))
    order = Window.partitionBy("token").orderBy("y.id")
    group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = held.withColumn("rank", F.row_number().over(order)).withColumns({
        "c": F.count("*").over(group), "heads": F.collect_list(F.when(F.col("rank") <= HEADS, F.col("y"))).over(group)}).where("rank > 1")
    y = F.col("y")
    found = held.select("token", "y", F.when(_near(F.col("heads")[0], y), F.col("heads")[0]["id"]).alias("first"),
                        F.transform(F.filter(F.slice("heads", 2, HEADS - 1), lambda x: (x.id < y.id) & _near(x, y)), lambda x: x.id).alias("others"),
                        ((F.col("c") > HEADS + 1) & (F.col("rank") > HEADS)).alias("late"))
    return found.where(F.col("first").isNotNull() | (F.size("others") > 0) | F.col("late"))


def _removed_sets(distinct: DataFrame, whole: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Numbers of the open sets (id, n, s1, s2, tokens, places) that an earlier one is similar to."""
    met = stored(_met(distinct), "met")
    found = _verified(met.where("first is not null").select(F.col("first").alias("x"), F.col("y.id").alias("y")), whole)
    decided = found.select(F.col("y").alias("id")).distinct()
    open_ = met.where("late or size(others) > 0").withColumn("id", F.col("y.id")).join(decided, "id", "left_anti")
    heads = open_.select(F.explode("others").alias("x"), F.col("id").alias("y"))
    late = met.where("late").select("token", F.col("y").alias("x"))
    rest = open_.where("late").select("token", "y").join(late, "token").where("x.id < y.id").where(_near(F.col("x"), F.col("y")))
    more = _verified(heads.unionByName(rest.select(F.col("x.id").alias("x"), F.col("y.id").alias("y"))), whole)
    return found.unionByName(more).select(F.col("y").alias("id")).distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc, removed): the numbers of the lines to remove from each document that has any."""
    with scratch(docs.sparkSession):
        levels = sets.rarity(docs, lambda column: words.flat_words(column)[0])
        firsts = Firsts.of(stored(_lines_of(docs, levels), "lines"))
        judge = firsts.judge()
        shared = shared_tokens(docs, levels, judge)
        open_ = stored(_open_sets(docs, levels, judge, shared), "open-sets")
        distinct = stored(_numbered(open_), "line-sets")
        dropped(open_)
        places = distinct.select("id", "doc", "line")
        gone = _removed_sets(distinct, lambda ids: _whole_sets(docs, levels, places.join(ids, "id"))).join(places, "id").select("doc", "line")
        return stored(firsts.later().unionByName(gone).groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("removed")), "removed", keep=True)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the lines that repeat an earlier one; other columns stay as they are."""
    text, gone = F.col("text"), F.coalesce("removed", F.array().cast("array<int>"))
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    rows = docs.withColumn("_doc", document_key()).join(removed_lines(docs).withColumnRenamed("doc", "_doc"), "_doc", "left")
    return rows.withColumn("text", F.when(F.col("removed").isNull(), text).otherwise(kept)).select(*docs.columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its number of lines, of removed lines, and their numbers, joined by commas."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", document_key().alias("doc"), F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    return rows.join(removed_lines(docs), "doc", "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed_lines"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without near-repeated lines; documents whose text thereby becomes empty stay, with n_chars as they came."""
    return deduplicated(docs)
