"""A run-length grammar of a sequence by recompression, and longest common extensions read from it.

Rounds alternate. Block compression writes every block of equal symbols as one symbol; pair compression deals the alphabet into left
and right symbols and writes every pair of a left and a right one as one symbol. Symbols of a round are equal exactly where what they
stand for is equal, and equal stretches are parsed alike but for their edges. So the grammar compares two places from the top of what
begins (or ends) at both: equal symbols are passed as a whole, unequal ones are opened, and blocks are passed by their common
length. Extensions are exact however the alphabet is dealt.

All in arrays: a round is one pass over the symbols that are left, and all queries take their steps side by side.
"""

from __future__ import annotations

import numpy as np

ROUNDS = 200
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair, equal for equal pairs."""
    return np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)[1]


def _block_starts(symbol: np.ndarray) -> np.ndarray:
    """Where blocks of equal symbols begin; the end last."""
    return np.concatenate([[0], np.flatnonzero(symbol[1:] != symbol[:-1]) + 1, [len(symbol)]])


def _pair_starts(symbol: np.ndarray, seed: int) -> np.ndarray:
    """Where pairs and single symbols begin, the end last. The alphabet is dealt by a hash, the better way round."""
    with np.errstate(over="ignore"):
        mixed = (symbol.astype(np.uint64) + np.uint64(seed + 1)) * _ODD[0]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD[1]
    left = (mixed >> np.uint64(40)) & np.uint64(1) == 1
    one, other = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
    pair = one if one.sum() >= other.sum() else other
    return np.append(np.flatnonzero(np.append(True, ~pair)), len(symbol))


class Grammar:
    """Of a sequence of numbers from 0. Rounds end when ``least`` symbols are left.

    The rounds' symbols lie one round after another, each round between two symbols that equal none.
    """

    def __init__(self, sequence: np.ndarray, least: int = 1):
        symbol = np.asarray(sequence, np.int64)
        self._rounds: list[dict[str, np.ndarray]] = []
        self._at = 0
        self._add(symbol, np.ones(len(symbol), np.int64), None)
        for seed in range(ROUNDS):
            if len(symbol) <= least:
                break
            start = _block_starts(symbol)
            size = np.diff(start)
            where = np.arange(len(symbol)) - np.repeat(start[:-1], size)
            self._inner("behind", where + 1)
            self._inner("ahead", np.repeat(size, size) - where)
            if len(size) < len(symbol):
                symbol = self._grouped(start, _numbered(symbol[start[:-1]], size))
            start = _pair_starts(symbol, seed)
            if 1 < len(start) - 1 < len(symbol):
                behind = symbol[np.minimum(start[:-1] + 1, len(symbol) - 1)] + 1
                symbol = self._grouped(start, _numbered(symbol[start[:-1]], np.where(np.diff(start) == 2, behind, 0)))
        for name in ("symbol", "length", "first", "last", "ahead", "behind", "parent", "opens", "closes"):
            setattr(self, name, np.concatenate([r[name] for r in self._rounds]))
        self._lowest = self._rounds[0]["symbol"].size
        del self._rounds

    def _add(self, symbol: np.ndarray, length: np.ndarray, start: np.ndarray | None) -> None:
        n, below = len(symbol), self._at - (len(self._rounds[-1]["symbol"]) if self._rounds else 0)
        kind = np.int32

        def framed(inner, front, back):
            out = np.empty(n + 2, np.asarray(inner).dtype)
            out[0], out[1:-1], out[-1] = front, inner, back
            return out

        if start is None:
            first = last = framed(np.zeros(n, kind), 0, 0)
        else:
            under = len(self._rounds[-1]["symbol"])
            first = framed((start[:-1] + 1 + below).astype(kind), below, below + under - 1)
            last = framed((start[1:] + below).astype(kind), below, below + under - 1)
        ones = np.ones(n + 2, kind)
        self._rounds.append({
            "symbol": framed(symbol.astype(np.int64), -1, -2).astype(kind), "length": framed(length.astype(kind), 0, 0),
            "first": first, "last": last, "ahead": ones, "behind": ones.copy(), "parent": np.zeros(n + 2, kind),
            "opens": np.zeros(n + 2, bool), "closes": np.zeros(n + 2, bool)})
        self._at += n + 2

    def _inner(self, name: str, values: np.ndarray) -> None:
        self._rounds[-1][name][1:-1] = values

    def _grouped(self, start: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The round above, whose symbols begin at ``start``."""
        now = self._rounds[-1]
        self._inner("parent", np.repeat(np.arange(len(symbol)), np.diff(start)) + 1 + self._at)
        now["opens"][start[:-1] + 1] = True
        now["closes"][start[1:]] = True
        self._add(symbol, np.add.reduceat(now["length"][1:-1], start[:-1]), start)
        return symbol

    def extension(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """For each two places the length of the longest equal stretches that begin (``back``: end) there.

        A place may be -1 or the length of the sequence; nothing begins or ends there.
        """
        out, query = np.zeros(len(a), np.int64), np.arange(len(a))
        a, b = np.asarray(a, np.int64) + 1, np.asarray(b, np.int64) + 1
        edge, run, child, way = ((self.closes, self.behind, self.last, -1) if back
                                 else (self.opens, self.ahead, self.first, 1))
        while len(query):
            # Up where both begin a symbol and the same one; along equal symbols; else down.
            up, x, y = edge[a] & edge[b], self.parent[a], self.parent[b]
            up &= self.symbol[x] == self.symbol[y]
            along = ~up & (self.symbol[a] == self.symbol[b])
            step = np.minimum(run[a], run[b])
            out[query[along]] += step[along].astype(np.int64) * self.length[a[along]]
            goes_on = up | along | (a >= self._lowest)
            down = ~up & ~along
            move = way * step.astype(np.int64)
            a = np.where(up, x, np.where(down, child[a], a + move))[goes_on]
            b = np.where(up, y, np.where(down, child[b], b + move))[goes_on]
            query = query[goes_on]
        return out
