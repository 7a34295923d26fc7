"""Runs against trying every period, and the grammar against comparing symbol by symbol."""

from __future__ import annotations

import random
from collections import Counter

import brute
import numpy as np
import pandas as pd
import pytest

from pathloom.llm import periodic_runs
from pathloom.llm.queries import QUERIES
from pathloom.llm.recompression import Grammar

FIELDS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def quick_runs(w):
    """As brute.runs, on numbers of words: stretches that equal themselves a period later."""
    w = np.unique(np.array(w, object).astype(str), return_inverse=True)[1] if len(w) else np.empty(0, np.int64)
    found = {}
    for p in range(1, len(w) // 4 + 1):
        same = np.diff(np.concatenate([[0], (w[p:] == w[:-p]).astype(np.int8), [0]]))
        for s, e in zip(np.flatnonzero(same == 1).tolist(), np.flatnonzero(same == -1).tolist(), strict=True):
            if e - s + p >= max(6, 4 * p):
                found.setdefault((s, e - s + p), p)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("folder", ["small_dir", "odd_dir"])
def test_against_every_period(spark, request, folder, monkeypatch):
    monkeypatch.setattr(brute, "runs", quick_runs)
    folder = request.getfixturevalue(folder)
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    docs = docs[~docs.text.fillna("").str.startswith("word word")]  # held below: trying every period of it takes minutes
    want = Counter(brute.periodic(None if pd.isna(r.doc_id) else int(r.doc_id), r.text) for r in docs.itertuples())
    rows = QUERIES["op13_periodic_runs"](spark, folder).collect()
    got = Counter(tuple(r[f] for f in FIELDS) for r in rows)
    assert len(rows) == len(pd.read_parquet(f"{folder}/documents.parquet")) and not want - got


def some_texts(draw):
    out = []
    for _ in range(draw.randrange(1, 6)):
        k, w = draw.choice([1, 2, 2, 3, 5]), []
        for _ in range(draw.randrange(0, 6)):
            part = [draw.randrange(k) for _ in range(draw.randrange(1, 9))] * draw.randrange(1, 12)
            w += part * (1 + (draw.random() < 0.3))
        out.append(w[:200])
    return out


def test_quick_form_agrees_with_the_plain_one():
    draw = random.Random(2)
    for _ in range(60):
        for w in some_texts(draw):
            assert quick_runs(w) == brute.runs(w)


def test_runs_of_many_small_texts(monkeypatch):
    draw = random.Random(1)
    for trial in range(150):
        monkeypatch.setattr(periodic_runs, "CANDIDATES", 1 << 20 if trial % 2 else 13)
        texts = some_texts(draw)
        first = np.cumsum([0, *map(len, texts)])
        rows = periodic_runs.runs_of(np.array([x for w in texts for x in w], np.uint64), first).T.tolist()
        assert rows == [[k, *r] for k, w in enumerate(texts) for r in brute.runs(w)]


def test_long_repetition_and_fibonacci_words():
    w = np.zeros(100_000, np.uint64)
    assert periodic_runs.runs_of(w, np.array([0, len(w)])).T.tolist() == [[0, 0, 100_000, 1]]
    a, b = [0], [0, 1]
    while len(b) < 50_000:
        a, b = b, b + a
    assert not periodic_runs.runs_of(np.array(b, np.uint64), np.array([0, len(b)])).size  # no fourth power in a Fibonacci word


def test_extensions_against_comparing_symbols():
    draw = random.Random(4)
    for _ in range(100):
        body = [draw.randrange(2) for _ in range(draw.randrange(3, 20))] * draw.randrange(1, 8)
        row = np.array([-1, *body, -2])
        i, j = (np.array([draw.randrange(1, len(row)) for _ in range(40)]) for _ in range(2))
        i, j = i[i != j], j[i != j]
        grammar = Grammar(row)
        ahead, back = grammar.extend(i, j), grammar.extend(i, j, False)
        for a, b, f, r in zip(i.tolist(), j.tolist(), ahead.tolist(), back.tolist(), strict=True):
            f2 = next(d for d in range(len(row)) if max(a, b) + d >= len(row) or row[a + d] != row[b + d])
            r2 = next(d for d in range(len(row)) if row[a - 1 - d] != row[b - 1 - d])
            assert (f, r) == (f2, r2)


def test_texts_and_spans(spark):
    docs = spark.createDataFrame([(1, "a b a b a b a b c"), (2, None), (None, "x " * 7)], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs.find_runs(docs).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 8, 2)] and got[1].collapsed == "a b c" and got[1].exponent_milli == 4000
    assert got[2].runs == [] and got[2].collapsed == "" and got[2].start is None
    assert got[None].collapsed == "x" and [tuple(x) for x in got[None].runs] == [(0, 7, 1)]
