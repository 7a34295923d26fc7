"""The parts that run inside tasks, against plain Python."""

from __future__ import annotations

import random

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import odd_documents

from pathloom.llm import best_fit, jaccard_join, language_id, passages, spot_signatures, token_counts, wordhash

TEXTS = [r["text"] for r in odd_documents(True)]
odd_text = st.text(alphabet=" \t\n\r\x0b\x0c'abAB12.,#é日\u3000\x1c\u00a0▁sd", max_size=60)


@given(st.lists(st.one_of(st.none(), odd_text), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_equal_plain_split(texts):
    got = wordhash.Words(texts, fold=False)
    for i, text in enumerate(texts):
        a, b = got.first[i], got.first[i + 1]
        assert [w.decode() for w in got.words(a, b)] == brute.words(text)


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    whole = wordhash.Words(TEXTS, True).hashes
    runs = wordhash.run_hashes(whole, 5)
    monkeypatch.setattr(wordhash, "BLOCK", 64)
    assert (wordhash.Words(TEXTS, True).hashes == whole).all()
    assert (wordhash.run_hashes(whole, 5) == runs).all()


def test_equal_words_have_equal_hashes_only():
    words = wordhash.Words(["a b c a bc ab c"], False)
    assert words.hashes[0] == words.hashes[3] and len(set(words.hashes.tolist())) == 5


@pytest.fixture(scope="module")
def counter():
    return token_counts.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"), held=50)


def test_vocabulary_proofs(counter):
    assert counter.closed and len(counter.whole) > 10_000


@given(odd_text)
@settings(max_examples=300, deadline=None)
def test_piece_counts_equal_the_library(counter, text):
    assert counter.count(text) == len(counter.model.encode(text))


@pytest.fixture(scope="module")
def encoder():
    return best_fit.ByteEncoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), held=50)


def ids_of(encoder, text):
    return np.frombuffer(encoder.ids(text), "<u4").tolist()


@given(odd_text)
@settings(max_examples=300, deadline=None)
def test_byte_ids_equal_the_library(encoder, text):
    assert ids_of(encoder, text) == encoder.library.encode(text, add_special_tokens=False).ids


def test_byte_ids_of_odd_texts(encoder):
    for text in [t for t in TEXTS if t and len(t) < 20_000] + ["a<|endoftext|> b", " it's  we'll\n\n x", "   ", "a \n b"]:
        assert ids_of(encoder, text) == encoder.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece_once(seed):
    draw = random.Random(seed)
    counts = {draw.randint(1, 64): draw.randint(1, 300) for _ in range(draw.randint(1, 40))}
    plan = best_fit.sweep_plan(dict(counts), 64)
    bins, ranks = {}, {}
    for size, rank, n, first, offset in plan:
        for i in range(n):
            bins.setdefault(first + i, []).append((offset, size))
            ranks.setdefault(size, []).append(rank + i)
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in counts.items()}
    for held in bins.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= 64
    least = -(-sum(s * n for s, n in counts.items()) // 64)
    large = sum(n for s, n in counts.items() if 2 * s > 64)
    assert len(bins) <= max(1.15 * max(least, large) + 2, 1)


def test_plan_of_many_tiny_pieces_is_small_and_full():
    plan = best_fit.sweep_plan({1: 1_000_000, 7: 1_000_000, 500: 3}, 1024)
    assert len({x for _, _, n, first, _ in plan for x in (first, first + n - 1)}) < 10_000
    assert max(first + n for _, _, n, first, _ in plan) <= 1.01 * (8_000_000 + 1500) / 1024 + 1


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 128, 130])
def test_cut_points(n):
    assert best_fit.cut_points(n, 64) == [(a, k) for a, k, _ in brute.pieces(list(range(n)), 64)]


def test_prefixes_keep_every_linked_pair():
    """Linked sets share min(ell, ell') tokens of both prefixes whose rows allow the other's size."""
    draw = random.Random(3)
    universe = [int(x) for x in wordhash.mix(np.arange(400, dtype=np.uint64))]
    hot = np.sort(np.array(universe[:120], np.uint64))
    counts = np.arange(10, 130, dtype=np.int64) * 50
    seen = 0
    for _ in range(400):
        base = set(draw.sample(universe, draw.randint(3, 90)))
        one, two = set(base), set(base)
        for s in (one, two):
            for x in draw.sample(sorted(base), draw.randint(0, max(1, len(base) // 12))):
                s.discard(x)
                s.add(draw.choice(universe))
        a, b = (np.sort(np.array(sorted(s), np.uint64)) for s in (one, two))
        if 100 * len(one & two) < 80 * len(one | two):
            continue
        seen += 1
        rows = []
        for s in (a, b):
            prefix, ell, _ = jaccard_join.prefix_rows(s, hot, counts)
            rows.append(({int(t): (len(s) - i + ell - 1) * 180 // 80 - len(s) for i, t in enumerate(prefix)}, ell))
        met = [t for t in rows[0][0] if t in rows[1][0] and rows[0][0][t] >= len(b) and rows[1][0][t] >= len(a)]
        assert len(met) >= min(rows[0][1], rows[1][1])
    assert seen > 100


def test_automaton_finds_what_plain_search_finds():
    draw = random.Random(5)
    words = wordhash.mix(np.arange(9, dtype=np.uint64))
    docs = [words[np.array([draw.randrange(9) for _ in range(draw.randint(0, 300))], int)] for _ in range(4)]
    docs.append(np.concatenate([docs[0][20:120], docs[1][:90], words[:3], docs[0][-60:]]))
    known = [(i, d) for i, d in enumerate(docs[:4]) if len(d) >= 50]
    automaton = passages.PassageAutomaton(known)
    got = np.zeros(len(docs[4]), bool)
    for a, b in automaton.covered(9, docs[4]):
        got[a:b] = True
    want = np.zeros(len(docs[4]), bool)
    held = {tuple(d[p : p + 50].tolist()) for _, d in known for p in range(len(d) - 49)}
    for p in range(len(docs[4]) - 49):
        if tuple(docs[4][p : p + 50].tolist()) in held:
            want[p : p + 50] = True
    assert (got == want).all() and want.any()
    assert automaton.covered(0, docs[4]) == []


def test_signatures():
    sets = spot_signatures.signature_sets([None, "", "!!", "one two", "the quick brown fox", "The quick, brown fox!"])
    assert [len(s) for s in sets] == [0, 0, 1, 1, 1, 1] and (sets[4] == sets[5]).all()
    assert spot_signatures.pruned_jaccard(sets[0], sets[1]) == 1.0 and spot_signatures.pruned_jaccard(sets[0], sets[2]) == 0.0
    a, b = np.arange(10, dtype=np.uint32), np.arange(2, 12, dtype=np.uint32)
    assert spot_signatures.pruned_jaccard(a, b) == 8 / 12 and spot_signatures.pruned_jaccard(a, b, 0.9) == 0.0


def test_length_partitions_hold_all_alike_sets():
    for n in range(1, 400):
        for m in range(n, int(n / 0.8) + 1):
            assert abs(spot_signatures.length_partition(n, 0.8) - spot_signatures.length_partition(m, 0.8)) <= 1


def test_gram_counts(monkeypatch):
    text = "Abba, ça va! " * 40
    codes, counts = language_id.gram_counts(text)
    assert counts[codes == (ord("a") << 2 | 1)][0] == 40 * 4
    monkeypatch.setattr(language_id, "_CHUNK", 17)
    again, n = language_id.gram_counts(text)
    assert (again == codes).all() and (n == counts).all()


def test_a_worker_holds_few_words_and_few_texts_of_a_batch():
    """Words held are bounded well below what one executor's two workers may take."""
    held = best_fit.ByteEncoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert held.held <= 60_000 and best_fit.TEXTS <= 1_000
    assert held.ids("a b a") == held.ids("a b a") and len(held) == 2
