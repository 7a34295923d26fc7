"""Language prediction in plain Python; passages of documents without ids and of very long ones."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import brute
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathloom.llm import language_id, passages
from pathloom.llm.queries import QUERIES


def grams(text):
    """Counts of the 1- to 3-grams of lower-cased letters, words padded by one blank on either side."""
    letters = "".join(c if c.isalpha() and ord(c) < 0x32400 else " " for c in text)
    low = "".join(c if c == " " or len(c.lower()) > 1 else c.lower() for c in letters)
    joined = " " + " ".join(low.split()) + " " if low.split() else ""
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(joined) - n + 1):
            g = joined[i : i + n]
            if g.strip() and " " not in g[1:-1]:
                out[g] += 1
    return out


def code(g):
    out = 0
    for c in g:
        out = out << 21 | (0 if c == " " else ord(c))
    return out << 2 | len(g)


def profile(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:400]]


def unit(doc_id):
    return int(hashlib.md5(f"profile:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:12], 16) / 16**12


def plain(docs, sample):
    """{(doc_id, text): (lang_pred, score)}; documents are (doc_id, text, lang)."""
    import zlib

    by = {}
    for i, t, lang in docs:
        held = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        if lang is not None and not held:
            by.setdefault(lang, set()).add((unit(i), float("-inf") if i is None else i))
    ranks = {}
    for lang, keys in by.items():
        chosen = {k for _, k in sorted(keys)[:sample]}
        counts = Counter()
        for i, t, other in docs:
            if other == lang and i is not None and i in chosen and t:
                counts += grams(t)
        ranks[lang] = {g: r for r, g in enumerate(profile(counts))}
    ranks = {k: v for k, v in ranks.items() if v}
    out = {}
    for i, t, _ in docs:
        top = profile(grams(t or ""))
        if not top or not ranks:
            out[i, t] = ("und", 0.0)
            continue
        away = {lang: sum(abs(r.get(g, 10**9) - k) if g in r else 400 for k, g in enumerate(top)) for lang, r in ranks.items()}
        best = min(sorted(away), key=lambda x: away[x])
        out[i, t] = (best, 1 - away[best] / (400 * len(top)))
    return out


def rows_of(folder):
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    return [(None if pd.isna(r.doc_id) else int(r.doc_id), r.text if isinstance(r.text, str) else None, r.lang if isinstance(r.lang, str) else None)
            for r in docs.itertuples()]


@pytest.mark.parametrize("folder", ["small_dir", "plain_dir"])
def test_predictions_and_scores(spark, request, folder):
    folder = request.getfixturevalue(folder)
    want = plain(rows_of(folder), language_id.SAMPLE)
    text = {i: t for i, t, _ in rows_of(folder)}
    got = QUERIES["op4_language_profiles"](spark, folder).collect()
    assert len(got) == len(want)
    for r in got:
        pred, score = want[r.doc_id, text[r.doc_id]]
        assert r.lang_pred == pred and r.score == pytest.approx(score, abs=1e-12)


@pytest.mark.parametrize("sample", [1, 7, 40, 1000])
def test_the_same_documents_are_chosen_with_a_bound(spark, sample):
    rows = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 == 0, "few").otherwise("hot").alias("lang"))
    got = {(r.lang, r.doc_id) for r in language_id.chosen_documents(rows, sample).collect()}
    want = set()
    for lang, ids in (("few", range(0, 900, 9)), ("hot", [i for i in range(900) if i % 9])):
        want |= {(lang, i) for i in sorted(ids, key=lambda i: (unit(i), i))[:sample]}
    assert got == want


def test_documents_without_ids_keep_their_own_phrases(spark):
    """Twenty texts without an id, each sharing another passage with a document that has one."""
    draw = random.Random(9)
    prose = lambda n: " ".join(f"w{draw.randrange(5000)}" for _ in range(n))
    shared = [prose(60) for _ in range(20)]
    docs = [(i, f"{prose(30)} {s}") for i, s in enumerate(shared)] + [(None, f"{prose(20)} {s} {prose(10)}") for s in shared]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute.passages(docs)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in passages.remove_repeats(frame)[0].collect())
    assert got == Counter((i, *want[i, t]) for i, t in docs)


def test_long_passages_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(passages, "PIECE", 70)
    monkeypatch.setattr(passages, "SHARD_WORDS", 300)
    draw = random.Random(10)
    long = " ".join(f"v{draw.randrange(3000)}" for _ in range(900))
    docs = [(1, long), (2, "a b c " + long + " d"), (3, " ".join(long.split()[100:400])), (4, " ".join(long.split()[850:] + long.split()[:60]))]
    want = brute.passages(docs)
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in passages.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))[0].collect()}
    assert got == {(i, *want[i, t]) for i, t in docs}


def test_documents_send_stretches_around_phrases_and_not_their_text(spark, monkeypatch):
    monkeypatch.setattr(passages, "SHARD_WORDS", 200)
    monkeypatch.setattr(passages, "READ_WORDS", 300)
    sent, write = [], passages.materialize
    monkeypatch.setattr(passages, "materialize", lambda df, name, *a: sent.append(out) or out if (out := write(df, name, *a)) is not None and name == "stretches" else out)
    draw = random.Random(11)
    prose = lambda n: " ".join(f"x{draw.randrange(9000)}" for _ in range(n))
    shared = [prose(60 + k) for k in range(12)]
    docs = [(i, f"{s} {prose(40)}") for i, s in enumerate(shared)]
    docs += [(50 + i, " ".join(f"{prose(700)} {s}" for s in draw.sample(shared, 4)) + f" {shared[i]} {shared[i]}") for i in range(8)]
    want = brute.passages(docs)
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in passages.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))[0].collect()}
    assert got == {(i, *want[i, t]) for i, t in docs}
    rows = sent[0].collect()
    assert len({r.shard for r in rows}) > 2
    # a text has more than 2,800 words, of which four passages and two copies are shared
    whole = Counter()
    for r in rows:
        whole[r.doc_id] += r.n_words
        assert r.n_words == sum(r.places[1::2]) + len(r.places) // 2 - 1 and len(r.words) == 8 * r.n_words
    assert max(whole.values()) < 1_200
