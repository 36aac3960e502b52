"""HTML extraction by wrapper induction.

Pages of one host are aligned with a reference page of the host (the one with the smallest page_id) by simple tree
matching. An aligned node whose whole content recurs in the same slot on MIN_PAGES pages or more is template, whatever slot it is: hosts
turn several menus, notices or adverts in one place. All other slots vary and are content. What the wrapper can't know from one page alone, or
on hosts of few pages, is left to the meaning of elements: navigation, footers, asides, forms, scripts and the like are never
content, nor are elements whose class or id names them so; where a page has an article or main element, content is
what it holds. Text inside such an element is not dropped for recurring: copies of an article on one host are content.

Trees travel as skeletons (labels and hashes), not as pages. References meet pages by a salted join, constant slots are counted in
each task before they are shuffled, and no host is gathered in one place. Alignment pairs long lists of children in
one walk (dom.MOST_PAIRS), which costs precision of the template but no text.

Null html is an empty text, null urls are one host. Pages are told apart by page_id, url and html; repeated rows get the same result.
Columns of the input named like those of the result are not used.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm import dom, words
from lineweave.llm.op1_url_filter import url_host
from lineweave.llm.shared import scratch, stored

#: Pages of a host on which a slot must hold the same content to be template; copies of a reference in the join.
MIN_PAGES, SALTS = 3, 8

NEVER = dom.RAW | frozenset("head nav footer aside form button select option input menu dialog".split())
#: Words in classes, ids and roles that name what is not content.
NAMES = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies
    contentinfo disqus footer header masthead menu nav navbar navigation newsletter notice notices popup promo promoted related share sharing
    sidebar signup social sponsor sponsored subscribe toolbar widget""".split())
MAIN = frozenset({"article", "main"})

_PART = re.compile(r"[^a-z0-9]+")


def _named(names: str) -> bool:
    return bool(names) and not NAMES.isdisjoint(_PART.split(names))


def _excluded(node: dom.Element, in_main: bool) -> bool:
    return node.tag in NEVER or (node.tag == "header" and not in_main) or (_named(node.names) and node.tag not in ("body", "html"))


def main_text(page: str, template: set[int]) -> str:
    """The blocks of content of a page, one per line. template: numbers of its template elements."""
    root = dom.parsed(page)
    elements = dom.numbered(root)
    mains = {e.number for e in elements if e.tag in MAIN and not _excluded(e, True)}
    blocks: list[str] = []
    text: list[str] = []

    def close() -> None:
        block = " ".join("".join(text).split())
        text.clear()
        if block:
            blocks.append(block)

    work: list[tuple] = [(root, not mains, False)]
    while work:
        node, inside, own_main = work.pop()
        if node is None:
            close()
        elif isinstance(node, str):
            if inside:
                text.append(node)
        else:
            if _excluded(node, own_main) or (node.number in template and not own_main):
                if node.tag in dom.BLOCK:
                    close()
                continue
            block = node.tag in dom.BLOCK
            if block:
                close()
                work.append((None, False, False))
            own_main = own_main or node.number in mains
            work.extend((c, inside or own_main, own_main) for c in reversed(node.children))
    close()
    return "\n".join(blocks)


def _skeleton(page: str) -> str:
    """The tree as a flat list in page order: label, value, number, size, number of children. Subtrees of main elements are left out."""
    root = dom.parsed(page)
    dom.numbered(root)
    rows, work = [], [root]
    while work:
        e = work.pop()
        inner = [] if e.tag in MAIN else [c for c in e.children if isinstance(c, dom.Element)]
        rows.append([f"{e.tag} {e.names}", e.value, e.number, e.size, len(inner)])
        work.extend(reversed(inner))
    return json.dumps(rows)


def _tree(skeleton: str) -> dom.Tree:
    waiting: list[dom.Tree] = []
    for label, value, number, size, n in reversed(json.loads(skeleton)):
        children = [waiting.pop() for _ in range(n)]
        waiting.append((label, value, number, size, children))
    return waiting[0]


KEY = "page struct<page_id: bigint, h: bigint>"


def _page() -> F.Column:
    return F.struct(F.col("page_id").cast("long").alias("page_id"), F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))).alias("h"))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.pieces(batches):
        yield pa.record_batch([batch["page"], batch["host"], pa.array([_skeleton(h or "") for h in batch["html"].to_pylist()], pa.string())], ["page", "host", "tree"])


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page, host, slot of the reference, element of the page and its value, for each aligned element with content."""
    known: dict[str, list] = {}
    for batch in words.pieces(batches):
        row, slot, number, value = [], [], [], []
        for r, (own, ref) in enumerate(zip(batch["tree"].to_pylist(), batch["ref"].to_pylist())):
            if ref not in known:
                if len(known) > 200:
                    known.clear()
                known[ref] = _tree(ref)
            tree = _tree(own)
            values = {}
            work = [tree]
            while work:
                node = work.pop()
                values[node[2]] = node[1]
                work.extend(node[4])
            for a, b in dom.matched(known[ref], tree):
                if b:
                    row.append(r)
                    slot.append(a)
                    number.append(b)
                    value.append(values[b])
        if row:
            at = pa.array(row)
            yield pa.record_batch([batch["page"].take(at), batch["host"].take(at), pa.array(slot, pa.int32()), pa.array(number, pa.int32()), pa.array(value, pa.int64())],
                                  ["page", "host", "slot", "number", "value"])


def template_elements(pages: DataFrame) -> DataFrame:
    """(page, numbers): the elements of each page that belong to the template of its host."""
    with scratch(pages.sparkSession):
        rows = pages.select(_page().alias("page"), url_host(F.col("url")).alias("host"), "html")
        trees = stored(rows.mapInArrow(_skeletons, f"{KEY}, host string, tree string"), "trees")
        refs = trees.groupBy("host").agg(F.min_by("tree", "page").alias("ref"), F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
        refs = refs.select("host", "ref", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = trees.withColumn("salt", F.pmod(F.col("page.h"), F.lit(SALTS)).cast("int"))
        slots = stored(salted.join(refs, ["host", "salt"]).select("page", "host", "tree", "ref").mapInArrow(
            _slots, f"{KEY}, host string, slot int, number int, value long"), "slots")
        fixed = slots.groupBy("host", "slot", "value").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES).drop("n")
        return stored(slots.join(fixed, ["host", "slot", "value"], "left_semi").groupBy("page").agg(F.collect_set("number").alias("numbers")), "template", keep=True)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches):
            batch = words.unpacked(batch, "html")
            texts = [main_text(h or "", set(n or ())) for h, n in zip(batch["html"].to_pylist(), batch["numbers"].to_pylist())]
            yield pa.record_batch([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = words.packed(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _page().alias("page")), "html")
    # the template grows with the pages: it is no side to broadcast, at no size
    return rows.join(template_elements(pages).hint("merge"), "page", "left").select("page_id", "url", "html", "numbers").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
