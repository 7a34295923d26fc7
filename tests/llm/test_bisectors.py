"""Centroid clustering against plain Python, and its tournament against all distances."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pytest

from pathloom.llm import bisectors
from pathloom.llm.queries import QUERIES


def plain(rows, k=16, rounds=3):
    kept = []
    for key, x in rows:
        if x is not None and len(x) == 64 and all(c is not None and math.isfinite(c) and abs(64 * float(c)) < 1 << 31 for c in x):
            kept.append((key, [math.floor(64 * float(c)) for c in x]))
    seeds = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centres = [v for _, v in seeds]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((apart(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        centres = [
            [sum(x) // len(x) for x in zip(*(v for (_, v), o in zip(kept, own, strict=True) if o == n), strict=True)] if n in own else c
            for n, c in enumerate(centres)
        ]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = [sum(d for _, c, d in found if c == n) for n in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, sums[c], sum(sums), digest[c]) for i, c, d in found), key=str)


@pytest.mark.parametrize("folder", ["small_dir", "odd_dir", "plain_dir"])
def test_against_plain_python(spark, request, folder):
    folder = request.getfixturevalue(folder)
    rows = [(None if pd.isna(r.vec_id) else int(r.vec_id), r.embedding) for r in pd.read_parquet(f"{folder}/embeddings.parquet").itertuples()]
    got = QUERIES["op11_bisector_tournament"](spark, folder).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


@pytest.mark.parametrize("scale", [3, 1 << 20, (1 << 31) - 1])
def test_tournament_finds_the_nearest_with_ties(scale):
    draw = np.random.default_rng(scale)
    centroids = draw.integers(-1, 2, (9, 5)) * scale
    centroids[4] = centroids[1]
    x = draw.integers(-1, 2, (400, 5)) * scale
    got = bisectors.Bisectors(centroids.tolist())
    apart = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids] for v in x]
    assert got.nearest(x).tolist() == [min(range(9), key=lambda n: (d[n], n)) for d in apart]
    assert got.distances(x, got.nearest(x)) == [m if (m := min(d)) < 1 << 63 else None for d in apart]


def test_fewer_vectors_than_centroids_and_huge_distances(spark):
    far = 3e7
    rows = [(1, [far] * 64), (2, [-far] * 64), (None, [0.0] * 64)]
    got = bisectors.clusters_with_inertia(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2, rounds=0).collect()
    assert len(got) == 3 and {r.cluster for r in got} == {0, 1}
    none = bisectors.clusters_with_inertia(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"))
    assert none.count() == 0
