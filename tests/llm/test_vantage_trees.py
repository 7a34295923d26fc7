"""SimHash components against all pairs; what the trees prune and what they may not."""

from __future__ import annotations

from collections import Counter

import brute
import numpy as np
import pandas as pd
import pytest

from pathloom.llm import vantage_trees
from pathloom.llm.queries import QUERIES


@pytest.mark.parametrize("folder", ["small_dir", "odd_dir", "plain_dir"])
def test_against_all_pairs(spark, request, folder):
    folder = request.getfixturevalue(folder)
    docs = [(None if pd.isna(r.doc_id) else int(r.doc_id), None if r.text is None else r.text) for r in pd.read_parquet(f"{folder}/documents.parquet").itertuples()]
    prints = [brute.simhash(t) for _, t in docs]
    labels = brute.hamming_components(prints)
    lowest = {}
    for (i, _), c in zip(docs, labels, strict=True):
        lowest[c] = min((x for x in (lowest.get(c), i) if x is not None), default=None)
    want = Counter((i, f"{p:016x}", lowest[c]) for (i, _), p, c in zip(docs, prints, labels, strict=True))
    rows = QUERIES["op12_vantage_trees"](spark, folder).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == want


def test_long_texts_are_cut_into_parts(monkeypatch):
    text = " ".join(f"w{i % 91}" for i in range(1000))
    monkeypatch.setattr(vantage_trees, "CELLS", 64)
    assert vantage_trees.fingerprint(text) == brute.simhash(text)


def near_prints(draw, groups, size):
    out = set()
    for _ in range(groups):
        centre = int(draw.integers(0, 1 << 62))
        for _ in range(size):
            x = centre
            for b in draw.choice(64, draw.integers(0, 7), replace=False):
                x ^= 1 << int(b)
            out.add(x)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("layout", vantage_trees.LAYOUTS)
def test_every_link_meets_in_a_shard_and_others_are_pruned(layout):
    fps = near_prints(np.random.default_rng(3), 80, 6)
    trees = vantage_trees.trees_for(fps[:50], *layout)
    home, guests = {}, {}
    for some, shards, own in trees.shards(fps):
        for f, s in zip(some.tolist(), shards.tolist(), strict=True):
            (home if own else guests).setdefault(s, []).append(f)
    met = {frozenset((a, b)) for s, own in home.items() for a in own for b in own + guests.get(s, []) if a != b}
    links = {frozenset((a, b)) for a in fps.tolist() for b in fps.tolist() if a < b and (a ^ b).bit_count() <= 4}
    assert links and links <= met
    assert len(met) < 0.3 * len(fps) ** 2 / 2


@pytest.mark.parametrize("rows", [7, 4096])
def test_components_do_not_depend_on_blocks(spark, rows):
    fps = near_prints(np.random.default_rng(5), 3, 150)
    classes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    trees = vantage_trees.trees_for(fps[:40], 4, 4)
    links = vantage_trees.near_links(classes, trees, rows).collect()
    assert len(links) < 40 * len(fps)
    parent = {int(x): int(x) for x in fps.view(np.int64)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        parent[root(r.a)] = root(r.b)
    want = brute.hamming_components(fps.tolist())
    got = [root(int(x)) for x in fps.view(np.int64)]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))
