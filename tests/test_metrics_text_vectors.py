"""Metrics, texts, vectors and jobs against hand-computed values."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from toys import EDGE, NODE, links, rows_of

from pathloom.functions.text import compose_text
from pathloom.operators import jobs, metrics, neighbors, numbering
from pathloom.operators import phrases as phrases_module
from pathloom.operators import text as te
from pathloom.operators import vectors as ve
from pathloom.operators.phrases import in_slices, phrase_hits


def brute_auroc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(rows):
    total, out = sum(y for _, y in rows), 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        above = [y for t, y in rows if t >= s]
        out += sum(y for t, y in rows if t == s) / total * (sum(above) / len(above))
    return out


def brute_f1(rows):
    best, at = -1.0, None
    for t in sorted({s for s, _ in rows}):
        tp = sum(y for s, y in rows if s > t)
        fp = sum(1 - y for s, y in rows if s > t)
        fn = sum(y for s, y in rows if s <= t)
        f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
        if f1 > best + 1e-12:
            best, at = f1, t
    return at, best


@pytest.mark.parametrize("rows_per_task", [10, 1_000_000])
def test_ranking_metrics(spark, monkeypatch, rows_per_task):
    monkeypatch.setattr(numbering.prefix_sums, "__defaults__", ((), rows_per_task))
    rng = random.Random(4)
    rows = [(rng.randint(-40, 40) / 16, int(rng.random() < 0.4)) for _ in range(400)]
    df = spark.createDataFrame(rows, "score double, label int")
    got = metrics.ranking_metrics(df).first()
    assert math.isclose(got.auroc, brute_auroc(rows)) and math.isclose(got.average_precision, brute_ap(rows))
    best = metrics.best_f1_threshold(df).first()
    t, f1 = brute_f1([(1 / (1 + math.exp(-s)), y) for s, y in rows])
    assert math.isclose(best.threshold, t) and math.isclose(best.best_f1, f1)
    grouped = df.withColumn("g", F.when(F.col("score") > 0, "a").otherwise("b"))
    for r in metrics.ranking_metrics(grouped, ["g"]).collect():
        part = [x for x in rows if (x[0] > 0) == (r.g == "a")]
        assert math.isclose(r.auroc, brute_auroc(part)) and math.isclose(r.average_precision, brute_ap(part))


def test_one_class_and_no_rows(spark):
    one = metrics.ranking_metrics(spark.createDataFrame([(1.0, 1)], "score double, label int")).first()
    assert one.auroc is None and one.average_precision == 1.0
    empty = spark.createDataFrame([], "score double, label int")
    best = metrics.best_f1_threshold(empty).first()
    assert (best.threshold, best.best_f1) == (0.5, 0.0)


@pytest.mark.parametrize("rows_per_task", [7, 1_000_000])
def test_lower_median(spark, monkeypatch, rows_per_task):
    monkeypatch.setattr(numbering.prefix_sums, "__defaults__", ((), rows_per_task))
    rng = random.Random(1)
    rows = [("ab"[i % 2], float(rng.randint(0, 30))) for i in range(101)]
    got = dict(rows_of(numbering.lower_median(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]), "g", "median"))
    for g in "ab":
        values = sorted(v for k, v in rows if k == g)
        assert got[g] == values[(len(values) - 1) // 2]


@pytest.mark.parametrize("rows_per_task", [2, 3, 1_000_000])
def test_prefix_sums_do_not_depend_on_size(spark, rows_per_task):
    """Null comes first, NaN last, and a null group is a group."""
    values = [None, -1.0, 0.0, 2.0, 5.5, float("inf"), float("nan")]
    rows = [(g, v, i + 1) for g in ("a", None) for i, v in enumerate(values)]
    got = numbering.prefix_sums(spark.createDataFrame(rows, "g string, v double, c long"), "v", ["c"], ["g"], rows_per_task)
    want = sorted((str(g), c, sum(range(1, c))) for g, _, c in rows)
    assert sorted((str(r.g), r.c, r.c_before) for r in got.collect()) == want


@pytest.mark.parametrize("rows_per_task", [5, 1_000_000])
def test_rows_without_a_number_rank_nowhere(spark, monkeypatch, rows_per_task):
    monkeypatch.setattr(numbering.prefix_sums, "__defaults__", ((), rows_per_task))
    rows = [(0.1 * (i % 7), i % 2) for i in range(30)]
    odd = [*rows, (None, 1), (float("nan"), 0), (0.3, None), (float("nan"), 1)]
    plain, with_odd = (spark.createDataFrame(x, "score double, label int") for x in (rows, odd))
    assert metrics.ranking_metrics(plain).first() == metrics.ranking_metrics(with_odd).first()
    assert metrics.best_f1_threshold(plain).first() == metrics.best_f1_threshold(with_odd).first()


def test_expected_reciprocal_of_a_large_tie(spark, monkeypatch):
    rows = [(0, 0, 0.5)] + [(0, k, 0.5 if k < 400 else 0.9) for k in range(1, 700)]
    df = spark.createDataFrame(rows, "g int, candidate_idx int, score double")
    want = sum(1 / r for r in range(301, 701)) / 400
    for places in (10_000, 50):
        monkeypatch.setattr(metrics, "EXACT_PLACES", places)
        assert math.isclose(metrics.hits_mrr(df, ["g"], (1,), "expected").first().mrr, want, rel_tol=1e-12)


def test_losses(spark):
    df = spark.createDataFrame([(2.0, 1.0), (1.5, -0.5), (0.2, 0.1)], "pos_score double, neg_score double")
    got = metrics.pair_losses(df).first()
    bpr = sum(math.log1p(math.exp(-(p - n))) for p, n in ((2.0, 1.0), (1.5, -0.5), (0.2, 0.1))) / 3
    bce = (sum(math.log1p(math.exp(-p)) for p in (2.0, 1.5, 0.2)) + sum(math.log1p(math.exp(n)) for n in (1.0, -0.5, 0.1))) / 6
    assert math.isclose(got.bpr, bpr) and math.isclose(got.bce, bce)
    assert metrics.pairwise_accuracy(df).first().pairwise_accuracy == 1.0
    big = spark.createDataFrame([(-800.0, 800.0)], "pos_score double, neg_score double")
    assert metrics.pair_losses(big).first().bpr == 1600.0


def test_ties_in_ranks(spark):
    rows = [(0, 0, 1.0), (0, 1, 1.0), (0, 2, 2.0), (0, 3, 0.0), (0, 4, 1.0)]
    df = spark.createDataFrame(rows, "g int, candidate_idx int, score double")
    got = {t: metrics.hits_mrr(df, ["g"], (1, 3), t).first() for t in ("min", "mid", "expected")}
    assert (got["min"].mrr, got["mid"].mrr) == (0.5, 1 / 3)
    assert math.isclose(got["expected"].mrr, (1 / 2 + 1 / 3 + 1 / 4) / 3)
    assert math.isclose(got["expected"].hit_at_3, 2 / 3) and got["min"].hit_at_1 == 0.0
    audit = metrics.tie_audit(df, ["g"]).first()
    assert (audit.same_pair_exact, audit.group_close, audit.spread) == (False, False, 2.0)


def test_filtered_rank_matches_scan(spark):
    rng = random.Random(7)
    drugs, diseases = range(30), range(4)
    scores = {(d, c): rng.randint(-3, 3) / 2 for d in drugs for c in diseases if rng.random() < 0.6}
    known = {(d, c) for d in drugs for c in diseases if rng.random() < 0.2}
    targets = [(d, c, scores.get((d, c), 0.0)) for d, c in sorted(known)][:12]
    got = metrics.filtered_mrr(
        spark.createDataFrame(targets, "drug bigint, disease bigint, score double"),
        spark.createDataFrame([(d, c, s) for (d, c), s in scores.items()], "drug bigint, disease bigint, score double"),
        spark.createDataFrame(sorted(known), "drug bigint, disease bigint"), len(drugs), 0.0,
    )
    expected = []
    for d, c, s in targets:
        others = [scores.get((x, c), 0.0) for x in drugs if (x, c) not in known]
        expected.append((d, c, 1 + sum(o > s for o in others) + 0.5 * sum(o == s for o in others)))
    assert rows_of(got, "drug", "disease", "rank") == sorted(expected)


TOY_NODES = [
    (0, 0, "drug::DB1", "drug", "Zolmin", "x"), (1, 0, "gene/protein::101", "gene/protein", "KLN4", "x"),
    (2, 0, "disease::1", "disease", "Dry Cough", "x"),
]


def test_graph_context_leaves_out_clinical_relations(spark):
    nodes = spark.createDataFrame(TOY_NODES, NODE)
    rows = links("targets", "drug", "gene/protein", [(0, 1)])
    for rel in ("indication", "off-label use", "contraindication"):
        rows += links(rel, "drug", "disease", [(0, 2)])
    got = rows_of(te.graph_context(spark.createDataFrame(rows, EDGE), nodes, 5), "global_id", "text")
    assert got == [(0, "targets: KLN4."), (1, "targeted by drugs: Zolmin.")]


def test_sanitising(spark):
    nodes = spark.createDataFrame([*TOY_NODES, (3, 1, "disease::2", "disease", "Gout", "x"), (4, 1, "drug::2", "drug", "Abc", "x")], NODE)
    drugs, diseases = te.name_phrases(nodes, "drug"), te.name_phrases(nodes, "disease")
    rows = [
        (0, "drug", "eases a Dry Cough quickly. taken as a syrup."),
        (1, "gene/protein", "raised in dry cough. a membrane channel."),
        (2, "disease", "yields to Zolmin. an airway complaint."),
        (3, "drug", "only Dry Cough"), (4, "anatomy", " keeps Dry Cough. "), (5, "drug", None), (6, "drug", "has gout. not"),
    ]
    df = spark.createDataFrame(rows, "k int, node_type string, text string")
    got = [r.text for r in te.sanitize_texts(df, "text", drugs, diseases).orderBy("k").collect()]
    assert got == [
        "taken as a syrup.", "a membrane channel.", "an airway complaint.", "", "keeps Dry Cough.", None, "not."
    ]


def test_phrase_rule(spark):
    """A phrase counts inside a word only if some word starts with its first four characters."""
    nodes = spark.createDataFrame([(0, 0, "d", "disease", "Art Pain", "x"), (1, 1, "e", "disease", "ab", "x"), (2, 2, "f", "disease", "flu", "x")], NODE)
    phrases = te.name_phrases(nodes, "disease")
    assert rows_of(phrases, "phrase") == [("art pain",), ("flu",)]
    texts = ["heart painful", "art of heart painful", "influenza", "flu", "ab", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = te.flag_phrases(df, "t", phrases).orderBy("k").collect()
    assert [r.hit for r in got] == [False, True, False, True, False, False, False]


def test_phrases_with_null_and_repeated_keys(spark):
    phrases = spark.createDataFrame([("flu",), ("gout",), ("art pain",)], "phrase string")
    rows = [(None, "flu. fine"), (None, "clean. ok"), (1, "gout"), (1, "none here"), (1, "art pain. left")]
    df = spark.createDataFrame(rows, "k int, t string")
    flags = te.flag_phrases(df, "t", phrases).collect()
    assert {(r.t, r.hit) for r in flags} == {(t, t.split()[0].strip(".") in ("flu", "gout", "art")) for _, t in rows}
    cleaned = te.clean_sentences(df, "t", phrases).collect()
    assert sorted((str(r.k), r.t) for r in cleaned) == [("1", ""), ("1", "left."), ("1", "none here."), ("None", "clean. ok."), ("None", "fine.")]


def _holds(text, phrase):
    words = re.findall("[a-z0-9]+", text.lower())
    return phrase in " ".join(words) and any(w.startswith(phrase.split(" ")[0][:4]) for w in words)


@pytest.mark.parametrize("items_per_row, hot_texts", [(1024, 200_000), (2, 5)])
def test_phrase_index_against_every_pair(spark, items_per_row, hot_texts):
    """Words from few letters, so that phrases begin, end and lie inside words; small bounds deal every word and list out."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("ab1") for _ in range(draw.choice([1, 2, 3, 5, 9, 20])))
    texts = [" ".join(word() for _ in range(draw.randrange(0, 9))) for _ in range(120)]
    phrases = {" ".join(word() for _ in range(draw.choice([1, 1, 2, 2, 3, 4]))) for _ in range(150)}
    phrases |= {" ".join(t.split()[:4]) for t in texts[:40]} | {t[1:-1].strip() for t in texts[:60] if len(t) > 4}
    rows = spark.createDataFrame([(i, "x" if i % 2 else "y", t) for i, t in enumerate(texts) if t], "row long, side string, norm string")
    listed = spark.createDataFrame([(s, p) for p in phrases for s in (("x", "y") if len(p) % 2 else ("x",))], "side string, phrase string")
    got = {r.row for r in phrase_hits(rows, listed, items_per_row, hot_texts).collect()}
    want = {i for i, t in enumerate(texts) if any(p and _holds(t, p) for p in phrases if i % 2 or len(p) % 2)}
    assert got == want and 10 < len(want) < len(texts)


def test_slices_are_bounded_and_whole(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    rows = in_slices(df, "k", "v", 100).collect()
    assert max(len(r["items"]) for r in rows) < 160 and sorted(v for r in rows for v in r["items"]) == list(range(3000))


def test_phrases_meet_texts_by_equal_words(spark, monkeypatch):
    """No cross join, no Python, and a text moves with the lists found for it only."""
    plans = []
    kept = phrases_module.materialize
    monkeypatch.setattr(phrases_module, "materialize", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, *a))
    rows = spark.createDataFrame([(1, "", "a flu case")], "row long, side string, norm string")
    out = phrase_hits(rows, spark.createDataFrame([("", "flu")], "side string, phrase string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any(x in p for p in plans for x in ("Cartesian", "NestedLoop", "Python", "Arrow"))


@pytest.mark.parametrize(
    "strategy, rich, graph, text, source",
    [
        ("name_only", "r", "g", "b", "name_only"), ("rich_text_only", "r", "g", "b. r", "name+rich_text"),
        ("rich_text_only", None, "g", "b", "name_only_fallback"), ("graph_context_only", "r", "g", "b. g", "name+graph_context"),
        ("hybrid", "r", "r", "b r", "name+rich_text+graph_context"), ("hybrid", "", None, "b", "name"),
    ],
)
def test_compose(spark, strategy, rich, graph, text, source):
    df = spark.createDataFrame([("b", rich, graph)], "b string, r string, g string")
    assert tuple(df.select(*compose_text(strategy, F.col("b"), F.col("r"), F.col("g"))).first()) == (text, source)


def test_entity_segments_are_capped_in_first_seen_order(spark):
    rows = [("d", i, f"n{i % 10}; n{i}", None) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, ord int, names string, other string")
    got = te.entity_text_aggregate(df, "k", [("names", "names", 3, ", "), ("other", "other", 2, "; ")], "ord")
    assert rows_of(got, "text") == [("names: n0, n1, n2.",)]


def toy_vectors(spark, n=60, d=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ np.diag(np.arange(1, d + 1)) + 1.0
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "key bigint, vec array<double>")


@pytest.mark.parametrize("block", [7, 1000])
def test_best_cosine_by_blocks(spark, block):
    x, df = toy_vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -np.inf)
    got = {r.key: (r.best, r.nearest) for r in ve.best_cosine(df, block_rows=block).collect()}
    assert all(math.isclose(got[i][0], sims[i].max()) and got[i][1] == sims[i].argmax() for i in range(len(x)))
    cross = ve.best_cosine(df.filter("key < 20"), df.filter("key >= 20"), block_rows=block)
    assert {r.key: r.nearest for r in cross.collect()} == {i: 20 + int((u[i] @ u[20:].T).argmax()) for i in range(20)}


def clustered(n, d, groups, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    return centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, d))


def as_vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "key bigint, vec array<double>")


def nearest_by_all_pairs(x, y=None):
    """{number: (rounded best, first with it)}; a zero vector has similarity 0."""
    norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    sims = np.round(norm(x) @ norm(x if y is None else y).T, 12)
    if y is None:
        np.fill_diagonal(sims, -np.inf)
    return {i: (s.max(), int(s.argmax())) for i, s in enumerate(sims)}


@pytest.mark.parametrize("block", [20, 8192])
def test_nearest_with_copies_and_zero_vectors(spark, block):
    x = clustered(300, 5, 6, 0.2, 1)
    x[40:80] = x[7]
    x[[3, 90, 200]] = 0
    got = {r.key: (r.best, r.nearest) for r in ve.best_cosine(as_vectors(spark, x), block_rows=block).collect()}
    want = nearest_by_all_pairs(x)
    assert all(math.isclose(got[k][0], v[0], abs_tol=2e-12) for k, v in want.items())
    assert {k: got[k][1] for k in want} == {k: v[1] for k, v in want.items()}
    cross = {r.key: r.nearest for r in ve.best_cosine(as_vectors(spark, x[:50]), as_vectors(spark, x[50:], 50), block).collect()}
    assert cross == {k: 50 + v[1] for k, v in nearest_by_all_pairs(x[:50], x[50:]).items()}


def test_pairs_visited_on_clustered_and_on_even_vectors(spark):
    """Groups around pivots are ruled out where vectors cluster; where all are about equally far, all pairs are computed at most twice."""
    n = 1500
    near = ve.cosine_work(as_vectors(spark, clustered(n, 16, 12, 0.05, 2)), block_rows=64).collect()
    assert sum(r.pairs for r in near) < 0.35 * n * n
    even = ve.cosine_work(as_vectors(spark, np.random.default_rng(3).normal(size=(n, 60))), block_rows=64).collect()
    assert 0.5 * n * n < sum(r.pairs for r in even) <= n * n
    assert ve.best_cosine(as_vectors(spark, np.zeros((0, 3)))).count() == 0


def test_whitening_and_all_but_top(spark):
    x, df = toy_vectors(spark)
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(np.cov(x.T))
    axes, values = axes[:, ::-1], values[::-1]
    white = centred @ axes[:, :4] / np.sqrt(values[:4])
    white /= np.linalg.norm(white, axis=1, keepdims=True)
    got = np.array([r.vec for r in ve.whiten(df, 4).orderBy("key").collect()])
    assert got.shape == (60, 4) and np.allclose(got @ got.T, white @ white.T)
    rest = centred - centred @ axes[:, :2] @ axes[:, :2].T
    rest /= np.linalg.norm(rest, axis=1, keepdims=True)
    got = np.array([r.vec for r in ve.all_but_top(df, 2).orderBy("key").collect()])
    assert np.allclose(got, rest)


def test_choose_k(spark):
    def pick(rows):
        return ve.choose_k(spark.createDataFrame(rows, "k int, mean double")).first().k

    assert pick([(1, 0.61), (2, 0.45), (3, 0.52)]) == 3
    assert pick([(1, 0.9), (2, 0.3)]) == 2
    assert pick([(4, 0.45), (2, 0.45)]) == 2


def test_zero_vectors_and_lengths(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "key bigint, vec array<double>")
    assert rows_of(ve.l2_normalize(df), "vec") == [([0.0, 0.0],), ([0.6, 0.8],)]
    assert ve.validate_dims(df) == 2
    for bad in (df.limit(0), df.unionByName(spark.createDataFrame([(3, [1.0])], df.schema))):
        with pytest.raises((ValueError, AssertionError)):
            ve.validate_dims(bad)


def test_pooling(spark):
    rows = [(1, 2, [1.0, 5.0], 0.0), (1, 2, [3.0, 1.0], math.log(3))]
    paths = spark.createDataFrame(rows, "drug bigint, disease bigint, vec array<double>, score double")
    pairs = spark.createDataFrame([(1, 2), (7, 7)], "drug bigint, disease bigint")
    for mode, expected in (("mean", [2.0, 3.0]), ("max", [3.0, 5.0]), ("attention", [2.5, 2.0])):
        got = {r.drug: r.vec for r in ve.pool_paths(pairs, paths, mode, 2).collect()}
        assert np.allclose(got[1], expected) and got[7] == [0.0, 0.0]
    tokens = spark.createDataFrame(
        [("a", 0, 1, [1.0]), ("a", 1, 1, [3.0]), ("a", 2, 0, [9.0]), ("b", 0, 0, [4.0])], "key string, pos int, mask int, vec array<double>"
    )
    assert rows_of(ve.pool_tokens(tokens, "mean", 1), "key", "vec") == [("a", [2.0]), ("b", [0.0])]
    assert rows_of(ve.pool_tokens(tokens, "cls", 1), "key", "vec") == [("a", [1.0]), ("b", [4.0])]


def test_path_vectors_blank_dummies(spark):
    vectors = spark.createDataFrame([(0, [9.0]), (1, [1.0]), (2, [2.0]), (4, [4.0])], "key bigint, vec array<float>")
    paths = spark.createDataFrame([(1, 2, 0, 4), (0, 0, 0, 0), (1, 3, 2, 4)], "drug bigint, gene bigint, pathway bigint, disease bigint")
    assert rows_of(ve.concat_path_vectors(paths, vectors, 1), "drug", "gene", "vec") == [
        (0, 0, [0.0] * 4), (1, 2, [1.0, 2.0, 0.0, 4.0]), (1, 3, [1.0, 0.0, 2.0, 4.0])
    ]


def test_encoding_retries_items_of_a_failing_batch(spark):
    def make():
        def encode(texts):
            if "bad" in texts:
                raise ValueError("bad text")
            return [[float(len(t))] for t in texts]

        return encode

    df = spark.createDataFrame([("1", "ab"), ("2", "bad"), ("3", "abc"), ("4", " none ")], "key string, text string").coalesce(1)
    out = jobs.encode_text_job(df, make, 1, batch_size=10)
    assert rows_of(out, "key", "vec", "status") == [
        ("1", [2.0], "retried"), ("2", [0.0], "failed"), ("3", [3.0], "retried"), ("4", [0.0], "missing")
    ]
    stats = jobs.build_run_stats(out).first()
    assert (stats.total, stats.success, stats.zero_filled, stats.failed, stats.missing) == (4, 2, 2, 1, 1)


def test_seed_summary(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.7), ("b", 0.1)], "v string, m double")
    got = {r.v: r for r in metrics.seed_summary(df, ["v"], ["m"]).collect()}
    assert math.isclose(got["a"].m_std, 0.1414213562373095) and got["b"].m_std is None and got["a"].m_text == "0.6000 +/- 0.1414"
    assert metrics.seed_summary(df.filter("v = 'b'"), ["v"], ["m"], True).first().m_std == 0.0


def test_groups_of_prefix_sums_are_cut_each_for_itself(spark):
    """Groups with ranges far apart, one of them half of all rows: no bucket of any is large."""
    draw = random.Random(6)
    rows = [(g, 1e6 * g + draw.random()) for g in range(1, 9) for _ in range(250)] + [(0, draw.gauss(0, 1)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g int, v double")
    cut = numbering.value_buckets(df, "v", ["g"], 100)
    sizes = cut.groupBy("g", "_bucket").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    assert max(r.n for r in sizes) <= 200 and len(sizes) > 30
    for g in range(9):
        mine = sorted((r._bucket, r.lo, r.hi) for r in sizes if r.g == g)
        assert all(a[2] < b[1] for a, b in zip(mine, mine[1:]))


@pytest.mark.parametrize("sent", [1 << 24, 0])
@pytest.mark.parametrize("edges_per_task", [100, 2])
def test_neighbor_sums_of_hubs_and_small_weights(spark, monkeypatch, edges_per_task, sent):
    """Weight sums below one stay as they are, others divide; a hub added up in parts gives the same sums."""
    monkeypatch.setattr(ve, "NUMBERS_SENT", sent)
    edges = [(src, "drug", rel, None, dst) for src in range(9) for rel in ("a", "b") for dst in (1, 2, 3) if (src + dst) % 3 or dst == 2]
    table = spark.createDataFrame(edges, "src_id long, src_type string, rel string, dst_type string, dst_id long")
    vec = {i: [float(i), 1.0 - i, 0.5] for i in range(7)}
    vectors = spark.createDataFrame(list(vec.items()), "key long, vec array<float>")
    out = ve.neighbor_aggregate(table, vectors, (F.col("src_id") + 1) / 16, edges_per_task)
    expected = {}
    for dst in (1, 2, 3):
        sums = [0.0] * 3
        for rel in ("a", "b"):
            met = [e[0] for e in edges if e[4] == dst and e[2] == rel and e[0] in vec]
            most = max(1.0, sum((s + 1) / 16 for s in met))
            sums = [t + sum((s + 1) / 16 * vec[s][i] for s in met) / most for i, t in enumerate(sums)]
        expected[dst] = sums
    got = {r["key"]: r["vec"] for r in out.collect()}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k]) for k in expected)


def test_no_vector_of_a_small_table_is_shuffled(spark, monkeypatch):
    """Only numbers of edges are dealt by node."""
    monkeypatch.setattr(ve, "EDGES_TOGETHER", 1)
    edges = spark.createDataFrame([(1, "drug", "a", "gene", d) for d in (2, 3)], "src_id long, src_type string, rel string, dst_type string, dst_id long")
    vectors = spark.createDataFrame([(1, [1.0, 2.0])], "key long, vec array<float>")
    lines = ve.neighbor_aggregate(edges, vectors)._jdf.queryExecution().executedPlan().toString().splitlines()
    first = next(i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x)
    assert sum("ObjectHashAggregate" in x for x in lines[:first]) == 2
    assert not any("ObjectHashAggregate" in x for x in lines[first:])


def test_queries_meet_blocks_without_a_shuffle_of_vectors(spark, monkeypatch):
    """Far apart vectors visit nearly all blocks; their vectors move to chunks once a round, whatever the number of blocks."""
    plans, write = [], neighbors.materialize

    def keep(df, name="stage", *rest):
        if name == "met":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, *rest)

    monkeypatch.setattr(neighbors, "materialize", keep)
    monkeypatch.setattr(neighbors, "chunk_rows", lambda n, dim: 70)
    x = np.random.default_rng(8).normal(size=(600, 24))
    x[300:340] = x[:40]
    x[340:420] = x[5]
    got = {r.key: (r.best, r.nearest) for r in ve.best_cosine(as_vectors(spark, x), block_rows=30).collect()}
    want = nearest_by_all_pairs(x)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(math.isclose(got[k][0], want[k][0]) for k in want)
    assert len(plans) == 2 and all("CartesianProduct" in p and "Exchange" not in p for p in plans)


@pytest.mark.parametrize("several", [0, 1 << 13])
def test_similarities_of_32_bits_leave_no_better_vector_out(monkeypatch, several):
    """Vectors that differ by less than numbers of 32 bits can tell."""
    monkeypatch.setattr(neighbors, "SEVERAL", several)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(5, 40))
    x = np.concatenate([x + 1e-8 * rng.normal(size=x.shape) for _ in range(60)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = len(x)
    pivots = neighbors.Pivots.__new__(neighbors.Pivots)
    pivots.rows, pivots.vectors = np.arange(1), x[:1]
    keys = pa.array([f"k{(7 * i) % n:03d}" for i in range(n)])
    angle = np.arccos(np.clip(x @ x[0], -1, 1))
    house = neighbors.House(np.arange(n), x, np.zeros(n, np.int64), np.zeros(n, np.int32), angle, keys)
    best, at, visits, pairs = house.nearest(np.arange(n), x, np.zeros(n, np.int32), np.full(n, 4.0), pivots, True, True)
    sims = np.round(x @ x.T, 12)
    np.fill_diagonal(sims, -np.inf)
    names = np.array(keys.to_pylist())
    assert (visits, pairs) == (n, n * n) and np.abs(best - sims.max(axis=1)).max() < 2e-12
    exact = np.round(np.einsum("ij,ij->i", x, x[at]), 12)
    assert np.abs(exact - sims.max(axis=1)).max() < 2e-12 and len(set(names[at])) > 5
