"""The pipeline's rows against its stages stated in SQL and plain Python, not through its own functions."""

from __future__ import annotations

from collections import Counter

import brute
import duckdb
import pandas as pd
import public_tokenizers
import pytest

import corpus_pipeline
from pathloom.llm import best_fit
from pathloom.llm.oracles import ORACLES, mixing_sql


def answer(sql, docs):
    con = duckdb.connect()
    con.register("given", docs)
    con.execute("create table documents as select doc_id::bigint as doc_id, text::varchar as text, lang::varchar as lang, source::varchar as source from given")
    return con.execute(sql).df()


def value(x):
    return None if pd.isna(x) else x


def frame(rows):
    return pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})


def whole_pipeline(folder):
    """Counter of (doc_id, piece, start, length, crc), and the documents that each stage leaves; ids are distinct."""
    docs = {int(r.doc_id): (value(r.text), value(r.lang), value(r.source)) for r in pd.read_parquet(f"{folder}/documents.parquet").itertuples()}
    table = lambda: frame([(i, *row) for i, row in docs.items()])
    left = [len(docs)]
    kept = answer(ORACLES["op1_quality_divergence"], table())
    docs = {i: docs[i] for i in kept[kept.kept].doc_id}
    left.append(len(docs))
    texts = {r.doc_id: value(r.text) for r in answer(ORACLES["op9_site_lines"], table()).itertuples()}
    docs = {i: (texts[i], *row[1:]) for i, row in docs.items()}
    firsts = brute.near_components([(i, row[0]) for i, row in docs.items()])
    docs = {i: row for i, row in docs.items() if firsts[i][1] == i}
    left.append(len(docs))
    repeats = Counter(answer(mixing_sql(corpus_pipeline.TEMPER), table()).doc_id)
    library = best_fit.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")).library
    want = Counter()
    for i, n in repeats.items():
        ids = [*library.encode(docs[i][0] or "", add_special_tokens=False).ids, 2]
        for k, piece in enumerate(brute.pieces(ids, 1024)):
            want[(i, k, *piece)] += n
    return want, left


def rows_of(spark, folder):
    return Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect())


@pytest.mark.parametrize("folder", ["small_dir", "plain_dir"])
def test_pipeline_rows(spark, request, folder):
    folder = request.getfixturevalue(folder)
    want, left = whole_pipeline(folder)
    assert left[0] > left[1] > left[2] > 0
    assert rows_of(spark, folder) == want


@pytest.mark.parametrize("k", range(4))
def test_a_loss_inside_a_stage_shows(spark, small_dir, monkeypatch, k):
    want, _ = whole_pipeline(small_dir)
    name, stage = corpus_pipeline.STAGES[k]
    last = max(i for i, *_ in want)
    lossy = [*corpus_pipeline.STAGES]
    lossy[k] = (name, lambda spark, docs, sf_dir: stage(spark, docs, sf_dir).filter(f"doc_id <> {last}"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", lossy)
    assert rows_of(spark, small_dir) != want
