"""Plain versions of the operators, one document or pair at a time."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(word: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


def line_sets(text: str | None) -> list[tuple[int, frozenset]]:
    sets = [(i, frozenset(map(lower, WORD.findall(x)))) for i, x in enumerate((text or "").split("\n"))]
    return [(i, s) for i, s in sets if s]


def removed_lines(rows: list[tuple[int | None, str | None]]) -> dict[tuple, set[int]]:
    """rows: (doc_id, text); numbers of the removed lines by row."""
    order = sorted({(d is not None, d or 0, t or "") for d, t in rows})
    lines = [((d if known else None, t), i, s) for known, d, t in order for i, s in line_sets(t)]
    out = defaultdict(set)
    for n, (doc, i, s) in enumerate(lines):
        if any(100 * len(s & o) >= 80 * len(s | o) for _, _, o in lines[:n]):
            out[doc].add(i)
    return out


def shingles(text: str | None, size: int = 4) -> frozenset:
    ws = list(map(lower, WORD.findall(text or "")))
    return frozenset(tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))) if ws else frozenset()


def classes(rows: list[tuple[int | None, str | None]], size: int = 4, percent: int = 85) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of each row."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def cut(texts: list[str | None], size: int = 200) -> list[tuple[int, int, int, str]]:
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    seen = Counter(b[i : i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def counts(text: str | None) -> tuple:
    text = text or ""
    ws = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    cover = {k for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for k in range(i, i + 5)}
    failed = len(ws) < 10 or 100 * len(cover) > 20 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), failed


class KneserNey:
    """Interpolated modified Kneser-Ney over the characters of the words of one language."""

    def __init__(self, texts: list[str], order: int):
        self.order = order
        level = Counter()
        for t in texts:
            for w in WORD.findall(t):
                padded = "\2" * (order - 1) + w + "\3"
                level.update(padded[i : i + order] for i in range(len(w) + 1))
        self.levels = {order: level}
        for size in range(order - 1, 0, -1):
            up, level = level, Counter()
            for g, c in up.items():
                level[g[1:]] += c if g[1] == "\2" else 1
            self.levels[size] = level
        self.cuts, self.contexts = {}, {}
        for size, level in self.levels.items():
            n = Counter(level.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
            self.cuts[size] = [max(0.1, min(i - 0.1, i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i)) for i in (1, 2, 3)]
            totals = defaultdict(lambda: [0, 0.0])
            for g, c in level.items():
                totals[g[:-1]][0] += c
                totals[g[:-1]][1] += self.cut(size, c)
            self.contexts[size] = totals

    def cut(self, size: int, c: int) -> float:
        return min(self.cuts[size][min(c, 3) - 1], c)

    def p(self, gram: str) -> float:
        size = len(gram)
        if not size:
            return 1e-6
        rest = self.p(gram[1:])
        total, cut = self.contexts[size].get(gram[:-1], (0, 0))
        if not total:
            return rest
        c = self.levels[size].get(gram, 0)
        return (c - self.cut(size, c) if c else 0) / total + cut / total * rest

    def score(self, text: str) -> float:
        ws, cost = WORD.findall(text), 0.0
        for w in ws:
            padded = "\2" * (self.order - 1) + w + "\3"
            cost -= sum(math.log(self.p(padded[i : i + self.order])) for i in range(len(w) + 1))
        return 1000 * cost / sum(len(w) + 1 for w in ws)
