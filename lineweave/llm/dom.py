"""A small element tree of an HTML page, and simple tree matching of two such trees."""

from __future__ import annotations

import html
import math
import re

import numpy as np
import xxhash

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
_CLASS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CUT = re.compile(r"<[a-zA-Z/!][^>]*\Z")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                  "header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul br".split())
#: Start tags that end an open element of these names.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that such an end does not reach beyond.
_SCOPE = frozenset("table ul ol dl select body html div article section main".split())


class Element:
    __slots__ = ("tag", "names", "children", "number", "value", "size")

    def __init__(self, tag: str, names: str = ""):
        self.tag, self.names, self.children = tag, names, []
        self.number = self.size = 0
        self.value = 0


def parsed(page: str) -> Element:
    """The tree of a page. Children are elements and strings with references decoded; raw elements have none."""
    root = Element("#page")
    stack, at = [root], 0
    page = _CUT.sub("", page)
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            stack[-1].children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in BLOCK and tag != "br":
            _close(stack, {"p"})
        if tag in _ENDS:
            _close(stack, _ENDS[tag])
        given = m[3] or m[6] or ""
        names = " ".join(sorted({w for x in _CLASS.findall(given) for w in "".join(x).lower().split()})) if given else ""
        node = Element(tag, names)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not given.endswith("/"):
            stack.append(node)
    if at < len(page):
        stack[-1].children.append(html.unescape(page[at:]))
    return root


def _close(stack: list[Element], tags: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in _SCOPE:
            return


def numbered(root: Element) -> list[Element]:
    """All elements in page order, each with its number, the size of its subtree and a hash of what it holds."""
    out: list[Element] = []
    work: list[tuple[Element, bool]] = [(root, False)]
    while work:
        node, done = work.pop()
        if not done:
            node.number = len(out)
            out.append(node)
            work.append((node, True))
            work.extend((c, False) for c in reversed(node.children) if isinstance(c, Element))
            continue
        parts = [f"<{node.tag} {node.names}>"]
        node.size = 1
        for c in node.children:
            if isinstance(c, Element):
                node.size += c.size
                parts.append(str(c.value))
            else:
                parts.append(" ".join(c.split()))
        node.value = xxhash.xxh3_64_intdigest("\n".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)
    return out


# --- matching

#: A tree for matching: (label, value, number, size, children).
Tree = tuple

#: Products of list lengths up to which all rows of a table are kept; of longer ones some are, and the others are made again.
KEPT_CELLS = 1 << 20


def matched(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Pairs of numbers that simple tree matching aligns: roots of one label, and between their children an alignment in
    order with the most aligned nodes. Equal first and last children are taken as they are, which is never worse. Trees of
    every depth and lists of every length are aligned alike."""
    shapes = _Shapes()
    out: list[tuple[int, int]] = []
    work = [(shapes.shaped(a), shapes.shaped(b))] if a[0] == b[0] else []
    while work:
        x, y = work.pop()
        out.append((x[2], y[2]))
        work.extend(_aligned(x[4], y[4], shapes))
    return out


class _Shapes:
    """The shapes of two trees: how many nodes align depends on the labels alone, so it is counted once for two shapes. A node
    that is larger than its children say (they are left out) has its value in its shape."""

    def __init__(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.labels: list[str] = []
        self.sizes: list[int] = []
        self.children: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, int], int] = {}

    def shaped(self, tree: Tree) -> Tree:
        """The tree with the shape of each node behind its children."""
        order, work = [], [tree]
        while work:
            node = work.pop()
            order.append(node)
            work.extend(node[4])
        done: dict[int, Tree] = {}
        for node in reversed(order):
            children = [done[id(c)] for c in node[4]]
            inner = tuple(c[5] for c in children)
            key = (node[0], inner) if inner or node[3] == 1 else (node[0], node[3], node[1])
            shape = self.ids.setdefault(key, len(self.ids))
            if shape == len(self.labels):
                self.labels.append(node[0])
                self.sizes.append(node[3])
                self.children.append(inner)
            done[id(node)] = (*node[:4], children, shape)
        return done[id(tree)]

    def open(self, p: int, q: int) -> bool:
        return p != q and self.labels[p] == self.labels[q] and bool(self.children[p] and self.children[q]) and (p, q) not in self.known

    def score(self, p: int, q: int) -> int:
        if p == q:
            return self.sizes[p]
        if self.labels[p] != self.labels[q]:
            return 0
        return self.known[p, q] if self.children[p] and self.children[q] else 1

    def settle(self, xs: list[int], ys: list[int]) -> None:
        """Counts the aligned nodes of all pairs of shapes of two lists; without recursion, as pages may be deep."""
        work = [(p, q) for p in set(xs) for q in set(ys) if self.open(p, q)]
        while work:
            p, q = work[-1]
            if (p, q) in self.known:
                work.pop()
                continue
            low, xe, ye = _trimmed(self.children[p], self.children[q])
            left, right = self.children[p][low:xe], self.children[q][low:ye]
            missing = [(v, w) for v in set(left) for w in set(right) if self.open(v, w)]
            if missing:
                work.extend(missing)
                continue
            ends = self.children[p][:low] + self.children[p][xe:]
            self.known[p, q] = 1 + sum(self.sizes[c] for c in ends) + self.most(left, right)

    def flat(self, xs: list[int], ys: list[int]) -> bool:
        """Leaves of one label."""
        label = self.labels[xs[0]]
        return all(not self.children[t] and self.labels[t] == label for t in {*xs, *ys})

    def most(self, xs: list[int], ys: list[int]) -> int:
        """The most nodes that two lists align."""
        if not xs or not ys:
            return 0
        if self.flat(xs, ys):
            return sum(map(self.score, xs, ys))
        if len({*xs, *ys}) == 1:
            return self.sizes[xs[0]] * min(len(xs), len(ys))
        row, scores = _first_row(ys), _Scores(self, ys)
        for p in xs:
            row = _next_row(row, scores.of(p))
        return int(row[-1])


class _Scores:
    """Rows of scores of one shape against a list."""

    def __init__(self, shapes: _Shapes, ys: list[int]) -> None:
        self.shapes, self.ys, self.made = shapes, ys, {}
        self.distinct, self.places = np.unique(ys, return_inverse=True) if len(ys) >= _LONG else (None, None)

    def of(self, p: int):
        if p not in self.made:
            if len(self.made) == 64:
                self.made.clear()
            score = self.shapes.score
            self.made[p] = ([score(p, q) for q in self.ys] if self.distinct is None
                            else np.array([score(p, q) for q in self.distinct.tolist()], np.int64)[self.places])
        return self.made[p]


# rows of the table are lists up to this length, then arrays: same numbers
_LONG = 64


def _first_row(ys: list[int]):
    return [0] * (len(ys) + 1) if len(ys) < _LONG else np.zeros(len(ys) + 1, np.int64)


def _next_row(above, scores):
    if isinstance(above, list):
        row = [0]
        for j, s in enumerate(scores):
            row.append(max(above[j + 1], row[j], above[j] + s))
        return row
    row = np.zeros_like(above)
    np.maximum.accumulate(np.maximum(above[1:], above[:-1] + scores), out=row[1:])
    return row


def _trimmed(xs, ys) -> tuple[int, int, int]:
    """How many first items are equal, and the ends of both lists without equal last ones."""
    low, xe, ye = 0, len(xs), len(ys)
    while low < xe and low < ye and xs[low] == ys[low]:
        low += 1
    while xe > low and ye > low and xs[xe - 1] == ys[ye - 1]:
        xe, ye = xe - 1, ye - 1
    return low, xe, ye


def _aligned(xs: list[Tree], ys: list[Tree], shapes: _Shapes) -> list[tuple[Tree, Tree]]:
    low, xe, ye = _trimmed([t[:2] for t in xs], [t[:2] for t in ys])
    pairs = list(zip(xs[:low], ys[:low])) + list(zip(xs[xe:], ys[ye:]))
    xs, ys = xs[low:xe], ys[low:ye]
    if not xs or not ys:
        return pairs
    left, right = [t[5] for t in xs], [t[5] for t in ys]
    if shapes.flat(left, right):
        return pairs + list(zip(xs, ys))
    if len({*left, *right}) == 1:
        n = min(len(xs), len(ys))
        return pairs + list(zip(xs[-n:], ys[-n:]))
    shapes.settle(left, right)
    scores = _Scores(shapes, right)
    step = 1 if len(xs) * len(ys) <= KEPT_CELLS else math.isqrt(len(xs))
    kept = [_first_row(right)]
    row = kept[0]
    for i, p in enumerate(left, 1):
        row = _next_row(row, scores.of(p))
        if i % step == 0:
            kept.append(row)
    i, j, base = len(xs), len(ys), -1
    while i and j:
        if base != (i - 1) // step:
            base = (i - 1) // step
            rows = [kept[base]]
            if step == 1:
                rows.append(kept[i])
            else:
                for p in left[base * step : i]:
                    rows.append(_next_row(rows[-1], scores.of(p)))
        above, here, s = rows[i - 1 - base * step], rows[i - base * step], scores.of(left[i - 1])[j - 1]
        if s and here[j] == above[j - 1] + s:
            i, j = i - 1, j - 1
            pairs.append((xs[i], ys[j]))
        elif here[j] == above[j]:
            i -= 1
        else:
            j -= 1
    return pairs
