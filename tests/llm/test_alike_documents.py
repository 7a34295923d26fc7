"""Near copies among all documents by signatures, against comparing every pair."""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
import pytest

from pathloom.llm import spot_signatures


def every_pair(rows, threshold):
    sets = [frozenset(x.tolist()) for x in spot_signatures.signature_sets([t for _, t in rows])]
    classes = defaultdict(list)
    for (i, _), s in zip(rows, sets, strict=True):
        classes[s].append(i)
    name = {s: min((i for i in ids if i is not None), default=None) for s, ids in classes.items()}
    want = Counter()
    for s, ids in classes.items():
        rest = Counter(ids) - Counter([name[s]])
        for i, n in rest.items():
            want[i, name[s], 1.0] += n
    held = list(classes)
    for k, a in enumerate(held):
        for b in held[:k]:
            near = len(a & b) / len(a | b)
            if a and b and near >= threshold:
                ids = sorted((name[a], name[b]), key=lambda x: (x is None, x or 0), reverse=True)
                want[(ids[0], ids[1], round(near, 9))] += 1
    return want


def tables(folder):
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    return [(None if pd.isna(r.doc_id) else int(r.doc_id), None if pd.isna(r.text) else r.text) for r in docs.itertuples()]


@pytest.mark.parametrize("threshold", [0.3, 0.8])
@pytest.mark.parametrize("folder", ["small_dir", "odd_dir"])
def test_all_alike_documents_are_found(spark, request, folder, threshold):
    folder = request.getfixturevalue(folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = Counter((r.doc_id, r.near_id, round(r.near, 9)) for r in spot_signatures.alike_documents(docs, threshold).collect())
    want = every_pair(tables(folder), threshold)
    assert got == want and any(near < 1 for *_, near in want)


@pytest.mark.parametrize("threshold", [0, 1])
def test_a_threshold_lies_between_0_and_1(spark, small_dir, threshold):
    with pytest.raises(ValueError):
        spot_signatures.alike_documents(spark.read.parquet(f"{small_dir}/documents.parquet"), threshold)


def test_an_empty_table_has_no_alike_documents(spark, empty_dir):
    assert spot_signatures.alike_documents(spark.read.parquet(f"{empty_dir}/documents.parquet"), 0.8).count() == 0
