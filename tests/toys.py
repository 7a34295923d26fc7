"""Toy graphs by global id."""

from __future__ import annotations

DRUG, GENE, PATHWAY, DISEASE = "drug", "gene/protein", "pathway", "disease"
EDGE = "src_id bigint, src_type string, rel string, dst_type string, dst_id bigint"


def links(rel, src_type, dst_type, pairs):
    return [(s, src_type, rel, dst_type, d) for s, d in pairs]


def flip(rows, rel):
    return [(d, dt, rel, st, s) for s, st, _, dt, d in rows]


def cleaning_graph(pathways=False, direct=False):
    """Three drugs, three genes and two diseases in which every gene but one is shared."""
    targets = links("targets", DRUG, GENE, [(1, 101), (1, 102), (2, 102), (2, 103), (3, 103)])
    associates = links("associates", GENE, DISEASE, [(101, 201), (102, 201), (102, 202), (103, 202)])
    rows = targets + flip(targets, "targeted_by") + associates + flip(associates, "associated_with")
    rows += links("treats", DRUG, DISEASE, [(1, 201), (1, 202), (2, 202), (3, 202)])
    if pathways or direct:
        member = links("participates_in", GENE, PATHWAY, [(101, 301), (102, 301), (102, 302), (103, 302)])
        rows += member + flip(member, "participates_in__reverse__")
    if direct:
        indication = links("indication", DRUG, DISEASE, [(1, 201), (2, 202), (3, 201)])
        rows += indication + flip(indication, "rev_indication")
        rows += links("off-label use", DRUG, DISEASE, [(1, 202), (2, 201)])
        rows += links("off-label use", DISEASE, DRUG, [(201, 1), (202, 1)])
        rows += links("contraindication", DRUG, DISEASE, [(2, 202), (3, 202)])
        rows += links("contraindication", DISEASE, DRUG, [(201, 3), (202, 2)])
    return rows


def sampler_graph(pathways=False):
    """Drug 5 and disease 24 are connected to nothing, gene 12 joins two drugs and two diseases."""
    targets = links("targets", DRUG, GENE, [(1, 11), (1, 12), (2, 12), (3, 13), (4, 14), (5, 15)])
    protein = links("disease_protein", DISEASE, GENE, [(21, 11), (21, 12), (22, 12), (22, 13), (23, 14), (24, 16)])
    rows = targets + flip(targets, "targets__reverse__") + protein + flip(protein, "disease_protein__reverse__")
    if pathways:
        rows += links("in_pathway", GENE, PATHWAY, [(11, 31), (12, 31), (12, 32), (13, 32)])
    return rows


def mechanism_graph():
    """Gene 11 has two pathways, gene 12 two diseases, gene 13 no pathway."""
    targets = links("targets", DRUG, GENE, [(1, 11), (2, 11), (2, 12), (3, 13)])
    associates = links("associates", GENE, DISEASE, [(11, 21), (12, 21), (12, 22), (13, 23)])
    member = links("participates_in", GENE, PATHWAY, [(11, 31), (11, 32), (12, 32)])
    return (
        targets + flip(targets, "targeted_by") + associates + flip(associates, "associated_with")
        + member + flip(member, "has_member")
    )


def node_rows(drugs, genes, pathways, diseases):
    out = []
    for node_type, ids in ((DRUG, drugs), (GENE, genes), (PATHWAY, pathways), (DISEASE, diseases)):
        out += [(i, n, f"{node_type}::{i}", node_type, f"{node_type} {i}", "toy") for n, i in enumerate(ids)]
    return out


NODE = "global_id bigint, local_id bigint, raw_id string, node_type string, name string, source string"


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
