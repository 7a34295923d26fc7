"""Run-length grammar of a sequence by recompression, and longest common extensions on it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .wordhash import mix


@dataclass
class Level:
    """One row of the grammar. Boundary b stands in front of symbol b; boundary n ends the row."""

    symbols: np.ndarray
    #: boundary b is one of the next level too
    kept: np.ndarray
    #: number at the next level of the symbol that holds symbol b, or of boundary b where kept
    up: np.ndarray
    #: boundaries of the level below
    down: np.ndarray


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal pairs, equal names from 0."""
    return np.unique((left << np.int64(32)) | right, return_inverse=True)[1].astype(np.int64)


class Grammar:
    """Levels by turns: blocks of one symbol become (symbol, length), then chosen pairs become one symbol.

    Pairs are those whose left symbol is in one half of the alphabet and whose
    right one is in the other, so they never overlap, and equal stretches are
    cut alike but near their ends. Names come from the pairs themselves, without
    hashing. Levels are made when an extension first reaches them; each two
    shorten the row by about a quarter or more.
    """

    def __init__(self, symbols: np.ndarray):
        names = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.levels: list[Level] = []
        self._rows = [(names, np.arange(len(names) + 1))]

    def level(self, h: int) -> Level:
        while len(self.levels) <= h:
            self._compress()
        return self.levels[h]

    def _compress(self) -> None:
        h = len(self.levels)
        symbols, down = self._rows[h]
        n = len(symbols)
        kept = np.ones(n + 1, bool)
        if h % 2 == 0:
            kept[1:-1] = symbols[1:] != symbols[:-1]
        else:
            side = (mix(symbols.astype(np.uint64) + np.uint64(h * 0x1F3D5B79)) >> np.uint64(40)) & np.uint64(1) == 1
            ways = [side[:-1] & ~side[1:], ~side[:-1] & side[1:]]
            kept[1:-1] = ~max(ways, key=np.count_nonzero)
        up = np.cumsum(kept) - 1
        first = np.flatnonzero(kept)
        length = np.diff(first)
        heads = symbols[first[:-1]]
        if h % 2 == 0:
            names = _named(heads, length)
        else:
            tails = np.where(length == 2, symbols[first[1:] - 1] + 1, 0)
            names = _named(heads, tails)
        self.levels.append(Level(symbols, kept, up, down))
        self._rows[h] = (symbols[:0], down[:0])
        self._rows.append((names, first))

    def _steps(self, h: int, a: np.ndarray, b: np.ndarray, ahead: bool) -> np.ndarray | int:
        """Symbols that two pointers at equal symbols pass: the shorter rest of their blocks."""
        if h % 2:
            return 1
        at, bounds = self.level(h), self.level(h + 1).down
        if ahead:
            return np.minimum(bounds[at.up[a] + 1] - a, bounds[at.up[b] + 1] - b)
        return np.minimum(a - bounds[at.up[a - 1]], b - bounds[at.up[b - 1]])

    def extend(self, i: np.ndarray, j: np.ndarray, ahead: bool = True) -> np.ndarray:
        """Symbols that agree from boundaries i and j on (or, not ahead, up to them).

        Every stretch must meet a symbol that occurs once before the row ends. Pointers climb while
        their symbols agree and they stand at a boundary of the next level, pass
        at most a few symbols where they do not, and descend from the first pair
        of symbols that differ: work by the logarithm of the answer.
        """
        out = np.zeros(len(i), np.int64)
        off, sign = (0, 1) if ahead else (-1, -1)
        who, a, b = np.arange(len(i)), i.astype(np.int64), j.astype(np.int64)
        met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        h = 0
        while len(who):
            row = self.level(h)
            climbing, apart = [], []
            while len(who):
                differ = row.symbols[a + off] != row.symbols[b + off]
                rise = ~differ & row.kept[a] & row.kept[b]
                apart.append((who[differ], a[differ], b[differ]))
                climbing.append((who[rise], row.up[a[rise]], row.up[b[rise]]))
                go = ~differ & ~rise
                who, a, b = who[go], a[go], b[go]
                step = self._steps(h, a, b, ahead)
                a, b = a + sign * step, b + sign * step
            met.append(tuple(np.concatenate(x) for x in zip(*apart, strict=True)))
            who, a, b = (np.concatenate(x) for x in zip(*climbing, strict=True))
            h += 1
        for h in range(len(met) - 1, -1, -1):
            who, a, b = (np.concatenate(x) for x in zip((who, a, b), met[h], strict=True))
            if h == 0:
                break
            down, row = self.level(h).down, self.level(h - 1)
            a, b = down[a], down[b]
            done = []
            while len(who):
                differ = row.symbols[a + off] != row.symbols[b + off]
                done.append((who[differ], a[differ], b[differ]))
                who, a, b = who[~differ], a[~differ], b[~differ]
                step = self._steps(h - 1, a, b, ahead)
                a, b = a + sign * step, b + sign * step
            if done:
                who, a, b = (np.concatenate(x) for x in zip(*done, strict=True))
        out[who] = sign * (a - i[who])
        return out
