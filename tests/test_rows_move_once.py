"""Large intermediate tables are neither shuffled nor computed more often than needed."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pathloom.functions.keyed import key_hash
from pathloom.operators import metrics, paths, sampling


def edges_of(spark, drug_genes, disease_genes):
    d = [(a, "drug", "targets", "gene/protein", g) for a, g in drug_genes]
    s = [(a, "disease", "disease_protein", "gene/protein", g) for a, g in disease_genes]
    return spark.createDataFrame(d + s, "src_id long, src_type string, rel string, dst_type string, dst_id long")


@pytest.mark.parametrize("most, per_task", [(100_000, 2_000_000), (6, 2_000_000), (100_000, 10), (1, 1)])
def test_connected_pairs_of_lists_and_of_paths(spark, most, per_task):
    targets = [(d, 100 + g) for d in range(1, 7) for g in range(5) if (d + g) % 3]
    linked = [(s, 100 + g) for s in range(21, 27) for g in range(7) if (s * g) % 4 < 2]
    want = sorted({(d, s) for d, g in targets for s, k in linked if g == k})
    got = paths.connected_pairs(edges_of(spark, targets, linked), most, per_task)
    assert sorted(map(tuple, got.collect())) == want


def test_connected_pairs_enumerate_no_paths_of_small_diseases(spark, monkeypatch):
    monkeypatch.setattr(paths, "join_on_gene", lambda *_: pytest.fail("paths were enumerated"))
    got = paths.connected_pairs(edges_of(spark, [(1, 5), (2, 5), (1, 6)], [(9, 5), (9, 6)]))
    assert sorted(map(tuple, got.collect())) == [(1, 9), (2, 9)]


@pytest.mark.parametrize("per_list", [4, 100_000])
def test_path_chunks_meet_once(spark, monkeypatch, per_list):
    if per_list > 4:
        monkeypatch.setattr(paths, "list_chunks", lambda *_: pytest.fail("small pairs were range-sorted"))
    rows = [(1, 2, g, g % 3) for g in range(11)] + [(1, 3, 7, 0), (1, 3, 7, 0), (1, 3, 5, 1)]
    df = spark.createDataFrame(rows, "drug long, disease long, gene long, pathway long")
    got = {(r.drug, r.disease, r.chunk): [tuple(p) for p in r.paths] for r in paths.nested_path_chunks(df, 3, per_list).collect()}
    whole = sorted({r[2:] for r in rows if r[1] == 2})
    want = {(1, 2, i): whole[3 * i:3 * i + 3] for i in range(4)} | {(1, 3, 0): [(5, 1), (7, 0)]}
    assert got == want


def captured(monkeypatch, name):
    """Optimized plans of the tables written under ``name``."""
    plans, write = [], metrics.materialize

    def keep(df, stage="stage", *rest):
        if stage == name:
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, stage, *rest)

    monkeypatch.setattr(metrics, "materialize", keep)
    return plans


def derived_scores(spark, tmp_path):
    spark.range(60).selectExpr("id % 6 drug", "id div 6 disease", "cast(id % 4 = 0 as int) label").write.parquet(str(tmp_path / "s"))
    return spark.read.parquet(str(tmp_path / "s")).withColumn("score", F.pmod(key_hash("s", "drug", "disease"), F.lit(7)).cast("double"))


def test_best_f1_computes_a_score_once(spark, monkeypatch, tmp_path):
    plans = captured(monkeypatch, "scores")
    assert metrics.best_f1_threshold(derived_scores(spark, tmp_path)).count() == 1
    assert len(plans) == 1 and plans[0].count("md5(") == 1


def test_filtered_ranks_score_candidates_of_targets_only(spark, monkeypatch, tmp_path):
    plans = captured(monkeypatch, "candidates")
    scores = derived_scores(spark, tmp_path)
    targets = spark.createDataFrame([(1, 2, 3.0)], "drug long, disease long, score double")
    rank = metrics.filtered_mrr(targets, scores, targets, 6, 0.0).first()
    others = [r.score for r in scores.filter("disease = 2 and drug <> 1").collect()]
    assert (rank.greater, rank.ties) == (sum(s > 3 for s in others), sum(s == 3 for s in others))
    # candidates of other diseases go before the others are held against the known pairs
    assert plans[0].count("md5(") == 1 and plans[0].index("LeftAnti") < plans[0].index("LeftSemi")


def test_random_pools_leave_the_topology_alone(spark, monkeypatch):
    written, write = [], sampling.materialize
    monkeypatch.setattr(sampling, "materialize", lambda df, name="stage", *a: written.append(name) or write(df, name, *a))
    pairs = spark.createDataFrame([(1, 21)], "drug long, disease long")
    drugs, diseases = spark.createDataFrame([(1,), (2,)], "drug long"), spark.createDataFrame([(21,), (22,)], "disease long")
    got = sampling.negative_pairs(pairs, pairs, pairs, drugs, diseases, "random", 3, drug_pool=drugs)
    assert got.count() == 1 and "valid" not in written


@pytest.mark.parametrize("rows_per_slice, most_bits", [(1 << 14, 16), (8, 16), (8, 2), (1, 5)])
def test_draws_by_rank_are_those_of_the_numbered_pool(spark, tmp_path, rows_per_slice, most_bits):
    spark.range(700).selectExpr("id % 70 neg_drug", "id div 70 neg_disease").write.parquet(str(tmp_path / "pool"))
    pool = spark.read.parquet(str(tmp_path / "pool"))
    asked = spark.range(400).selectExpr("id drug", "id * 7 disease")
    by_rank = sampling.draw_by_rank(asked, pool, 3, "3:random", sampling.PAIR, rows_per_slice, most_bits)
    numbered = sampling.draw_from_pool(asked, pool, [], 3, "3:random", sampling.PAIR)
    names = ["drug", "disease", "neg_drug", "neg_disease"]
    want = sorted(map(tuple, numbered.select(names).collect()))
    assert len(want) == 400 and sorted(map(tuple, by_rank.select(names).collect())) == want


def test_a_large_pool_is_not_numbered_for_random_negatives(spark, monkeypatch):
    linked = spark.range(900).selectExpr("id % 30 drug", "100 + id div 30 disease")
    known = linked.filter("pmod(drug + disease, 9) = 0")
    drugs, diseases = linked.select("drug").distinct(), linked.select("disease").distinct()
    draw = lambda: sorted(map(tuple, sampling.negative_pairs(known, linked, known, drugs, diseases, "random", 3).collect()))
    before = draw()
    monkeypatch.setattr(sampling, "ROWS_PER_TASK", 10)
    monkeypatch.setattr(sampling, "_numbered", lambda *_: pytest.fail("every candidate was numbered"))
    assert len(before) == known.count() and draw() == before


@pytest.mark.parametrize("per_list", [1 << 18, 3])
def test_known_pairs_leave_the_candidates_in_lists(spark, per_list):
    rows = [(d, s) for d in range(12) for s in range(20, 26) if (d * s) % 5] * 2
    known = [(d, s) for d in range(14) for s in range(18, 27) if (d + s) % 3 == 0]
    got = sampling._not_known(*[spark.createDataFrame(r, "drug long, disease long") for r in (rows, known)], per_list)
    assert sorted(map(tuple, got.collect())) == sorted(set(rows) - set(known))
    # pairs meet as lists of a disease's drugs: no row of one pair is shuffled or joined
    assert "collect_set" in got._jdf.queryExecution().optimizedPlan().toString()


def test_paths_of_both_signs_are_counted_together(spark, small_dir, monkeypatch):
    from pathloom.plans import sampling_queries as queries

    calls, count = [], queries.tp.pair_path_counts
    monkeypatch.setattr(queries.tp, "pair_path_counts", lambda *a: calls.append(a) or count(*a))
    assert queries.empty_path_ratio(spark, small_dir).agg(F.sum("n_pairs")).first()[0] > 0
    assert len(calls) == 1


def test_genes_of_drugs_are_not_read_for_pairs_of_smaller_diseases(spark, monkeypatch):
    edges = edges_of(spark, [(1, 5), (1, 6), (1, 7), (2, 5), (2, 8)], [(9, 5), (8, 6)])
    drug_genes = edges.filter("rel = 'targets'").selectExpr("src_id drug", "dst_id gene")
    disease_genes = edges.filter("rel = 'disease_protein'").selectExpr("src_id disease", "dst_id gene")
    pairs = spark.createDataFrame([(1, 9), (2, 9), (2, 8)], "drug long, disease long")
    got = paths.shared_genes(pairs, drug_genes, disease_genes)
    assert sorted(map(tuple, got.collect())) == [(1, 9, 5), (2, 9, 5)]
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("per_task", [1 << 18, 2])
def test_gene_links_are_distinct_and_move_once(spark, monkeypatch, per_task):
    plans, write = [], paths.materialize

    def keep(df, name="stage", *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, *rest)

    monkeypatch.setattr(paths, "materialize", keep)
    monkeypatch.setattr(paths, "ENDS_PER_TASK", per_task)
    targets, linked = [(1, 5), (2, 5), (7, 5), (1, 6), (1, 5)], [(9, 5), (9, 5), (8, 6)]
    drug_genes, disease_genes = paths.gene_links(edges_of(spark, targets, linked))
    assert sorted(map(tuple, drug_genes.select("drug", "gene").collect())) == sorted(set(targets))
    assert sorted(map(tuple, disease_genes.select("disease", "gene").collect())) == sorted(set(linked))
    assert [p.count("Exchange") for p in plans] == [1, 1]
    got = paths.connected_pairs(None, links=(drug_genes, disease_genes))
    assert sorted(map(tuple, got.collect())) == [(1, 8), (1, 9), (2, 9), (7, 9)]
