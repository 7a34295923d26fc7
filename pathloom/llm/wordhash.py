"""Vectorised hashes of words and of runs of words.

A batch of texts becomes one byte buffer; all words are hashed at once by
differences of prefix sums modulo 2**64, so no Python object per word exists.
Hashes are 64 bits and depend on the bytes alone, not on process or machine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BLOCK = 1 << 16  # bytes hashed at a time, so that what is computed stays in the cache; longer texts are cut at white space
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (the public splitmix64 constants)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int, name: str) -> np.ndarray:
    held = _tables.get(name)
    if held is None or len(held) < n:
        steps = np.full(max(n, 1), base, np.uint64)
        steps[0] = 1
        held = np.cumprod(steps, dtype=np.uint64)
        if n <= BLOCK + 1 or name not in _tables:
            _tables[name] = held
    return held[:n]


def _pow(n: int) -> np.ndarray:
    return _powers(n, _BASE, "up")


def _inv(n: int) -> np.ndarray:
    return _powers(n, pow(_BASE, -1, 1 << 64), "down")


def _luts() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "byte" not in _tables:
        _tables["byte"] = mix(np.arange(1, 257, dtype=np.uint64))
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        _tables["fold"] = fold
        space = np.zeros(256, bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        _tables["space"] = space
        letters = np.arange(256) >= 128
        letters[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
        _tables["punctuation"] = ~letters
    return _tables["byte"], _tables["fold"], _tables["space"]


def _block_words(data: bytes, fold: bool, bare: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of one block."""
    values, lower, spaces = _luts()
    if bare:
        spaces = _tables["punctuation"]
    raw = np.frombuffer(data, np.uint8)
    if fold:
        raw = lower[raw]
    gap = np.ones(len(raw) + 2, np.int8)
    gap[1:-1] = spaces[raw]
    edge = np.diff(gap)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * _pow(len(raw)), out=sums[1:])
    if not len(start):
        return np.empty(0, np.uint64), start, end
    return mix((sums[end] - sums[start]) * _inv(len(raw) + 1)[start]), start, end


def _blocks(size: int, data: bytes, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut [0, size) at white space or text ends into parts of about BLOCK bytes."""
    at = 0
    while at < size:
        to = min(size, at + BLOCK)
        if to < size:
            i = int(np.searchsorted(bounds, to, "right")) - 1
            if i >= 0 and bounds[i] > at:
                to = int(bounds[i])
            else:
                cut = max(data.rfind(c, at, to) for c in (b" ", b"\n", b"\t"))
                if cut <= at:
                    cuts = [c for c in (data.find(c, to) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if c >= 0]
                    cut = min(cuts, default=size)
                to = max(cut, at + 1)
        yield at, to
        at = to


class Words:
    """Words of a batch: ``hashes``, byte spans in ``data``, and per text its first word.

    ``fold`` lower-cases A-Z; ``bare`` ends words at any ASCII character but letters and digits.
    """

    def __init__(self, texts: Iterable[str | None], fold: bool, bare: bool = False):
        parts = [b"" if t is None else t.encode() for t in texts]
        self.data = b"\n".join(parts)
        lengths = np.fromiter((len(p) for p in parts), np.int64, len(parts))
        ends = np.cumsum(lengths + 1)
        starts = ends - lengths - 1
        found = [(h, s + at, e + at) for at, to in _blocks(len(self.data), self.data, starts)
                 for h, s, e in [_block_words(self.data[at:to], fold, bare)]]
        none = np.empty(0, np.int64)
        self.hashes = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.uint64)
        self.start = np.concatenate([f[1] for f in found]) if found else none
        self.end = np.concatenate([f[2] for f in found]) if found else none
        #: words first[i]..first[i+1] belong to text i
        self.first = np.append(np.searchsorted(self.start, starts), len(self.start)).astype(np.int64)

    def words(self, a: int, b: int) -> list[bytes]:
        """The words a..b as bytes."""
        return [self.data[s:e] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on (len - k + 1 values)."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64)
    out = np.empty(n - k + 1, np.uint64)
    step = BLOCK // 2
    for at in range(0, len(out), step):
        part = hashes[at : at + step + k - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _pow(len(part)), out=sums[1:])
        got = (sums[k:] - sums[:-k]) * _inv(len(part) + 1)[: len(part) - k + 1]
        out[at : at + len(got)] = got[: len(out) - at]
    return mix(out)


def whole_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole sequence, apart from those of runs."""
    return run_hashes(hashes, len(hashes))[0] ^ np.uint64(0xA5A5A5A5A5A5A5A5 + len(hashes)) if len(hashes) else np.uint64(0)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Distinct k-word runs of each text, sorted; shorter texts give one value, empty ones none."""
    runs = run_hashes(words.hashes, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        else:
            out.append(np.array([whole_hash(words.hashes[a:b])] if b > a else [], np.uint64))
    return out


def slices_of(texts: list[str | None], limit: int = 8 * BLOCK) -> Iterator[tuple[int, int]]:
    """Index ranges of texts of at most about ``limit`` characters together."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and held + n > limit:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(texts):
        yield at, len(texts)
