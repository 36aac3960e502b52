"""Sorted runs of byte strings of one length, front-coded, and their merge by a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Run:
    """A sorted run: the length of the prefix that each string shares with the one before, and what follows it."""

    def __init__(self, common: np.ndarray, rest: bytes, size: int):
        self.common, self.rest, self.size = common.tolist(), rest, size
        self.i, self.at, self.text = -1, 0, b""

    def advance(self) -> int:
        """Reads the next string; the prefix it shares with the one before, or -1 at the end."""
        self.i += 1
        if self.i == len(self.common):
            return -1
        c = self.common[self.i]
        end = self.at + self.size - c
        self.text = self.text[:c] + self.rest[self.at : end]
        self.at = end
        return c


def coded(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Front code of sorted rows of bytes: shared prefix lengths, and the rests one after the other."""
    n, size = rows.shape
    differ = rows[1:] != rows[:-1]
    common = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), size)]) if n else np.zeros(0)
    common = common.astype(np.uint16)
    return common, rows[np.arange(size)[None, :] >= common[:, None]].tobytes()


def merged(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(run, place in the run, prefix shared with the string given before) of all strings in order.

    Each inner node holds a loser and how much it shares with the winner that passed it. A new contender shares a known
    prefix with the same winner, so the longer shared prefix wins without looking at a byte; only when both share
    equally much are bytes compared, and only those behind the shared prefix."""
    k = max(1, 1 << (len(runs) - 1).bit_length())
    shares = [r.advance() for r in runs] + [-1] * (k - len(runs))
    for i, r in enumerate(runs):
        shares[i] = 0 if shares[i] >= 0 else -1
    size = runs[0].size if runs else 0
    loser, lost = [0] * k, [0] * k

    def play(a: int, sa: int, b: int, sb: int) -> tuple[int, int, int, int]:
        """Winner and loser with what each shares: the winner with the last output, the loser with the winner."""
        if sa != sb:
            return (a, sa, b, sb) if sa > sb else (b, sb, a, sa)
        if sa < 0 or sa == size:
            return a, sa, b, sb
        x, y = int.from_bytes(runs[a].text[sa:], "big"), int.from_bytes(runs[b].text[sa:], "big")
        both = size - ((x ^ y).bit_length() + 7) // 8
        return (a, sa, b, both) if x <= y else (b, sb, a, both)

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, shares[node - k]
        a, sa = build(2 * node)
        b, sb = build(2 * node + 1)
        w, sw, loser[node], lost[node] = play(a, sa, b, sb)
        return w, sw

    winner, share = build(1)
    while share >= 0:
        yield winner, runs[winner].i, share
        share = runs[winner].advance()
        node = (winner + k) >> 1
        while node:
            b, sb = loser[node], lost[node]
            if share > sb:
                pass
            elif share < sb:
                loser[node], lost[node] = winner, share
                winner, share = b, sb
            else:
                winner, share, loser[node], lost[node] = play(winner, share, b, sb)
            node >>= 1
