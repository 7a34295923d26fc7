"""Runs of words that repeat with a period, found by recompression."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recompression import Grammar
from .wordhash import Words, slices_of

TIMES = 4  # a run is at least this many periods long
SHORTEST = 6  # and at least this many words
CANDIDATES = 1 << 20  # grid points judged together

_RUNS = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def repeated_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Word numbers of a document whose words from a on repeat with a period, for every tenth id; else None."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def _spacing(period: np.ndarray) -> np.ndarray:
    """Least number of successive words that equal the one a period later, in a run."""
    return np.maximum(SHORTEST, TIMES * period) - period


def grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, word, period) such that every run of a text spans one of its points with both ends of a period.

    Points of one period stand as far apart as the shortest run allows, so a text
    of n words has about n log(n) / 3 of them. They come in parts of bounded size.
    """
    most = np.where(sizes >= SHORTEST, np.maximum(sizes // TIMES, 1), 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    count = (sizes[text] - period) // _spacing(period)
    ends = np.cumsum(count)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, "right")))
        t, p, c = text[at:to], period[at:to], count[at:to]
        nth = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        p = np.repeat(p, c)
        yield np.repeat(t, c), (nth + 1) * _spacing(p) - 1, p
        at = to


def _near(words: np.ndarray, first: np.ndarray, text: np.ndarray, word: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Numbers of the grid points that have three successive words around them that equal those a period later."""
    x = first[text] + word
    at = np.flatnonzero(words[x] == words[x + period])
    text, x, period = text[at], x[at], period[at]
    same = []
    for d in (-2, -1, 1, 2):
        y = np.clip(x + d, first[text], first[text + 1] - 1 - period)
        same.append((y == x + d) & (words[y] == words[y + period]))
    return at[(same[0] & same[1]) | (same[1] & same[2]) | (same[2] & same[3])]


def _distinct(rows: np.ndarray, leading: int) -> np.ndarray:
    """Columns in order, the first of those that agree in the ``leading`` rows."""
    rows = rows[:, np.lexsort(rows[::-1])]
    head = np.ones(rows.shape[1], bool)
    head[1:] = (rows[:leading, 1:] != rows[:leading, :-1]).any(axis=0)
    return rows[:, head]


def runs_of(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows text, start, length and period of every run, by text, start and period.

    ``words`` are the words of all texts as numbers, those of text i at first[i]..first[i+1]. A grid
    point can only lie in a run if three successive words around it equal those
    a period later; texts without such a point have no run, and the others make
    up the grammar, parted by symbols that occur once. Two extensions at a
    point give the whole stretch that keeps the period. A stretch found with
    several periods has the smallest of them, which divides the others.
    """
    hit = np.zeros(len(first) - 1, bool)
    for text, word, period in grid(np.diff(first)):
        hit[text[_near(words, first, text, word, period)]] = True
    used = np.flatnonzero(hit)
    sizes = np.diff(first)[used]
    before = np.cumsum(sizes) - sizes
    place = before + np.arange(1, len(used) + 1)  # of each used text, behind its parting symbol
    inside = np.repeat(place - before, sizes) + np.arange(int(sizes.sum()))
    names = np.full(int(sizes.sum()) + len(used) + 1, -1, np.int64)
    joined = words[np.repeat(first[used] - before, sizes) + np.arange(int(sizes.sum()))]
    names[inside] = np.unique(joined, return_inverse=True)[1]
    parting = np.flatnonzero(names < 0)
    names[parting] = -1 - np.arange(len(parting))
    grammar, bounds = Grammar(names), np.append(before, len(joined))

    found = [np.empty((4, 0), np.int64)]
    for text, word, period in grid(sizes):
        at = _near(joined, bounds, text, word, period)
        text, p = text[at], period[at]
        i = place[text] + word[at]
        ahead, back = grammar.extend(i, i + p), grammar.extend(i, i + p, False)
        length = ahead + back + p
        rows = np.stack([used[text], i - back - place[text], length, p])
        found.append(_distinct(rows[:, length >= np.maximum(SHORTEST, TIMES * p)], 3))
    rows = _distinct(np.concatenate(found, axis=1), 3)
    return rows[:, np.lexsort((rows[3], rows[1], rows[0]))]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run (start, length, period) of greatest exact length / period; ties: smallest start, then period."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _judged(ids: list[int | None], texts: list[str | None], repeat: bool) -> list[tuple]:
    words = Words(texts, False)
    first = words.first
    orders = [repeated_order(i, n) if repeat else None for i, n in zip(ids, np.diff(first).tolist(), strict=True)]
    hashes = words.hashes.copy()
    for k, order in enumerate(orders):
        if order is not None:
            hashes[first[k] : first[k + 1]] = words.hashes[first[k] + order]
    text, start, length, period = runs_of(hashes, first)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    out = []
    for k, (doc_id, value) in enumerate(zip(ids, texts, strict=True)):
        a, b = bounds[k], bounds[k + 1]
        runs = list(zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True))
        parts = (value or "").encode().split()  # ASCII white space, as in the word class
        if orders[k] is not None:
            parts = [parts[x] for x in orders[k].tolist()]
        if runs:
            dropped = np.zeros(len(parts) + 1, np.int64)
            np.add.at(dropped, start[a:b] + period[a:b], 1)
            np.add.at(dropped, start[a:b] + length[a:b], -1)
            parts = [parts[x] for x in np.flatnonzero(np.cumsum(dropped[:-1]) == 0).tolist()]
            s, n, p = strongest(runs)
            best = (s, n, p, 1000 * n // p)
        else:
            best = (None, None, None, None)
        collapsed = b" ".join(parts)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        out.append((doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest(),
                    [{"start": s, "length": n, "period": p} for s, n, p in runs], collapsed.decode()))
    return out


def find_runs(docs: DataFrame, repeat: bool = False, texts: bool = True) -> DataFrame:
    """Runs of every document (doc_id, text), and its text with each run cut to one period.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged and numbered from 0. A run is a
    stretch of words with smallest period q, at least 6 words and 4 periods long,
    that neither neighbour continues. ``runs`` lists (start, length, period) by start and period;
    start, length, period and exponent_milli are of the run of greatest
    exact length / period (ties: smallest start, then period), null without runs. ``collapsed`` holds the words that no run
    contains after its first q words, joined by one space; ``texts=False`` leaves
    both columns out. ``repeat`` first makes every tenth document periodic from some word on, by its id.

    One row per row of ``docs``, nothing is shuffled: a text is judged alone, with others only to share array
    operations. Null and empty texts have no words. A null id is kept, and never made periodic. Repeated rows are judged
    one by one. Words are compared by 64-bit hashes, and the grammar without hashing.
    """
    names = [c.split()[0] for c in _RUNS.replace("<start:bigint,length:bigint,period:bigint>", "").split(", ")]
    width = len(names) if texts else len(names) - 2
    schema = _RUNS if texts else _RUNS[: _RUNS.index(", runs array")]
    span = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])
    types = [*[pa.int64()] * 6, pa.string(), pa.string(), pa.list_(span), pa.string()][:width]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices_of(values):
                rows = _judged(ids[a:b], values[a:b], repeat)
                columns = list(zip(*rows, strict=True))[:width]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names[:width])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(read, schema)
