"""Exact surviving edges of the cleaning operators on toy graphs."""

from __future__ import annotations

import pytest
from toys import DISEASE, DRUG, EDGE, GENE, PATHWAY, cleaning_graph, flip, links, rows_of

from pathloom.operators import audits, graph
from pathloom.operators.checks import CheckFailed, assert_empty
from pathloom.operators.paths import expand_to_quads


def edges_of(spark, rows):
    return spark.createDataFrame(rows, EDGE)


def by_rel(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.src_type, r.rel), []).append((r.src_id, r.dst_id))
    return {k: sorted(v) for k, v in out.items()}


def test_direct_cleaning_drops_both_directions_only_for_held_out_pairs(spark):
    raw = edges_of(spark, cleaning_graph(direct=True))
    held = spark.createDataFrame([(1, 201), (3, 202)], "drug bigint, disease bigint")
    before, after = by_rel(raw), by_rel(graph.remove_direct_edges(raw, held))
    assert after[(DRUG, "indication")] == [(2, 202), (3, 201)]
    assert after[(DISEASE, "rev_indication")] == [(201, 3), (202, 2)]
    assert after[(DRUG, "off-label use")] == [(1, 202), (2, 201)]
    assert after[(DISEASE, "off-label use")] == [(202, 1)]
    assert after[(DRUG, "contraindication")] == [(2, 202)]
    assert after[(DISEASE, "contraindication")] == [(201, 3), (202, 2)]
    clinical = {"indication", "off-label use", "contraindication", "rev_indication"}
    assert {k: v for k, v in before.items() if k[1] not in clinical} == {
        k: v for k, v in after.items() if k[1] not in clinical
    }


def test_path_cleaning_drops_the_edges_of_held_paths(spark):
    raw = edges_of(spark, cleaning_graph())
    held = spark.createDataFrame([(1, 101, 201), (2, 103, 202)], "drug bigint, gene bigint, disease bigint")
    after = by_rel(graph.remove_path_edges(raw, held))
    assert after == {
        (DRUG, "targets"): [(1, 102), (2, 102), (3, 103)],
        (GENE, "targeted_by"): [(102, 1), (102, 2), (103, 3)],
        (GENE, "associates"): [(102, 201), (102, 202)],
        (DISEASE, "associated_with"): [(201, 102), (202, 102)],
        (DRUG, "treats"): [(1, 202), (3, 202)],
    }


@pytest.mark.parametrize("quad, kept", [(False, [(101, 301), (103, 302)]), (True, [(101, 301), (102, 301), (103, 302)])])
def test_pathway_edges_of_triplets_and_quads(spark, quad, kept):
    raw = edges_of(spark, cleaning_graph(pathways=True))
    if quad:
        held = spark.createDataFrame([(1, 102, 302, 201)], "drug bigint, gene bigint, pathway bigint, disease bigint")
    else:
        held = spark.createDataFrame([(1, 102, 201)], "drug bigint, gene bigint, disease bigint")
    after = by_rel(graph.remove_path_edges(raw, held))
    assert after[(GENE, "participates_in")] == kept
    assert after[(PATHWAY, "participates_in__reverse__")] == sorted((p, g) for g, p in kept)


def test_isolation_drops_every_edge_of_the_node(spark):
    raw = edges_of(spark, cleaning_graph())
    held = spark.createDataFrame([(2, 103, 202)], "drug bigint, gene bigint, disease bigint")
    gone = spark.createDataFrame([(DISEASE, 201)], "node_type string, node_id bigint")
    after = by_rel(graph.remove_path_edges(raw, held, gone))
    assert after[(DRUG, "treats")] == [(1, 202), (3, 202)]
    assert after[(GENE, "associates")] == [(102, 202)]
    assert after[(DISEASE, "associated_with")] == [(202, 102)]


SPLITS = [("train", 4, 61), ("train", 5, 61), ("valid", 6, 62), ("test", 7, 63)]


@pytest.mark.parametrize(
    "mode, expected", [("cross_drug", [(DRUG, 6), (DRUG, 7)]), ("cross_disease", [(DISEASE, 62), (DISEASE, 63)]), ("random", [])]
)
def test_isolation_targets(spark, mode, expected):
    splits = spark.createDataFrame(SPLITS, "split string, drug bigint, disease bigint")
    assert rows_of(graph.isolation_targets(mode, splits), "node_type", "node_id") == expected


def test_holdout_pairs(spark):
    rows = [("train", 1, 9), ("valid", 2, 9), ("valid", 3, 8), ("test", 2, 7), ("ot", 5, 5)]
    splits = spark.createDataFrame(rows, "split string, drug bigint, disease bigint")
    assert rows_of(graph.collect_holdout_pairs(splits, ("valid", "test")), "drug", "disease") == [(2, 7), (2, 9), (3, 8)]


def deletion_rows():
    return (
        links("targets", DRUG, GENE, [(1, 11), (2, 11), (3, 12)])
        + links("disease_protein", DISEASE, GENE, [(21, 11), (22, 12)])
        + links("indication", DRUG, DISEASE, [(1, 21), (2, 21), (3, 22)])
        + links("in_pathway", GENE, PATHWAY, [(11, 31), (12, 31), (12, 32)])
        + links("drug_drug", DRUG, DRUG, [(1, 2), (2, 3)])
    )


def test_deletion_report_categories(spark):
    raw = edges_of(spark, deletion_rows())
    held = spark.createDataFrame([(1, 11, 31, 21)], "drug bigint, gene bigint, pathway bigint, disease bigint")
    report = graph.order_deletions(graph.deletion_report(raw, graph.remove_path_edges(raw, held))).collect()
    got = [(r.category, r.n_deleted, r.n_before, round(r.deleted_ratio, 6)) for r in report]
    assert got[0] == ("direct_leakage", 1, 3, 0.333333)
    assert sorted(got[1:]) == [("mechanistic", 1, 2, 0.5), ("mechanistic", 1, 3, 0.333333), ("mechanistic", 1, 3, 0.333333)]
    totals = {r.category: r.n_deleted for r in graph.deletion_totals(graph.deletion_report(raw, graph.remove_path_edges(raw, held))).collect()}
    assert totals == {"direct_leakage": 1, "mechanistic": 3, None: 4}


def batch_rows():
    targets = links("targets", DRUG, GENE, [(1, 11), (1, 12), (2, 12)])
    protein = links("disease_protein", DISEASE, GENE, [(21, 11), (21, 12), (22, 12)])
    known = links("indication", DRUG, DISEASE, [(1, 21), (2, 21), (2, 22)])
    return targets + flip(targets, "targeted_by") + protein + flip(protein, "disease_protein_reverse") + known + flip(known, "rev_indication")


def test_batch_masking(spark):
    raw = edges_of(spark, batch_rows())
    batches = spark.createDataFrame([(0, 1, 21), (1, 2, 22)], "batch_id int, drug bigint, disease bigint")
    seen = by_rel(graph.batch_graph(raw, batches, 0))
    assert seen[(DRUG, "indication")] == [(2, 21), (2, 22)]
    assert seen[(DISEASE, "rev_indication")] == [(21, 2), (22, 2)]
    assert seen[(DRUG, "targets")] == [(1, 11), (1, 12), (2, 12)]
    masked = graph.masked_batch_edges(raw, batches)
    assert rows_of(masked.filter("batch_id = 0"), "rel", "src_id", "dst_id") == [("indication", 1, 21), ("rev_indication", 21, 1)]


def audit_rows():
    return (
        links("targets", DRUG, GENE, [(5, 15), (6, 15), (6, 16)])
        + links("associates", GENE, DISEASE, [(15, 25), (16, 25)])
        + links("participates_in", GENE, PATHWAY, [(15, 35), (16, 36)])
    )


def test_residual_audit(spark):
    quads = spark.createDataFrame([(5, 15, 35, 25)], "drug bigint, gene bigint, pathway bigint, disease bigint")
    clean = edges_of(spark, audit_rows())
    assert audits.residual_edges(clean, quads).isEmpty()
    leaky = edges_of(
        spark,
        audit_rows() + links("targets__reverse__", GENE, DRUG, [(15, 5), (15, 6)]) + links("indication", DRUG, DISEASE, [(5, 25), (6, 25)]),
    )
    found = rows_of(audits.residual_edges(leaky, quads), "kind", "edge_type")
    assert found == [
        ("reverse_gene_to_drug", "gene/protein|targets__reverse__|drug"),
        ("shortcut_drug_to_disease", "drug|indication|disease"),
    ]
    with pytest.raises(CheckFailed):
        assert_empty(audits.residual_edges(leaky, quads), "residual edges")


def test_purity_and_external_overlap(spark):
    splits = spark.createDataFrame(
        [("train", 5, 25), ("train", 6, 25), ("valid", 5, 26), ("test", 6, 27)], "split string, drug bigint, disease bigint"
    )
    clean = edges_of(spark, audit_rows())
    row = audits.cross_split_purity(splits, clean, "cross_disease").first()
    assert (row.n_overlap, row.n_still_in_graph) == (0, 0)
    leaky = edges_of(spark, audit_rows() + links("associates_extra", GENE, DISEASE, [(16, 27)]))
    assert audits.cross_split_purity(splits, leaky, "cross_disease").first().n_still_in_graph == 1
    assert audits.cross_split_purity(splits, clean, "random").isEmpty()
    train = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "drug bigint, disease bigint")
    external = spark.createDataFrame([(3, 4), (6, 5), (5, 6)], "drug bigint, disease bigint")
    assert rows_of(audits.overlap_pairs(train, external), "drug", "disease") == [(3, 4), (5, 6)]


def test_text_contamination(spark):
    pairs = spark.createDataFrame([(7, 8)], "drug bigint, disease bigint")
    schema = "global_id bigint, name string, text string"
    dirty = [(7, "Zolmin", "Tablets of Zolmin calm a Dry Cough."), (8, "Dry Cough", "A dry cough can yield to zolmin within days.")]
    found = rows_of(audits.text_contamination(pairs, spark.createDataFrame(dirty, schema)), "direction")
    assert found == [("disease_text_contains_drug_name",), ("drug_text_contains_disease_name",)]
    clean = [(7, "Zolmin", "Zolmin blocks a channel."), (8, "Dry Cough", None)]
    summary = audits.contamination_summary(pairs, spark.createDataFrame(clean, schema)).first()
    assert (summary.n_checks, summary.n_leaks, summary.contamination_ratio) == (2, 0, 0.0)


def test_expand_passes_quads_through(spark):
    quads = spark.createDataFrame([(1, 2, 3, 4), (1, 2, 3, 4)], "drug bigint, gene bigint, pathway bigint, disease bigint")
    assert expand_to_quads(quads, None).count() == 2
    assert expand_to_quads(quads, None, distinct=True).count() == 1
