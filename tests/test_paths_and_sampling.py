"""Paths, negatives and corruption on toy graphs, checked against brute force."""

from __future__ import annotations

import random
from itertools import product

import pytest
from pyspark.sql import functions as F
from toys import EDGE, NODE, mechanism_graph, node_rows, rows_of, sampler_graph

from pathloom.functions.keyed import key_hash
from pathloom.operators import graph as gr
from pathloom.operators import paths as pa
from pathloom.operators import sampling as sa

PAIR = "drug bigint, disease bigint"


def sampler(spark, pathways=False):
    return spark.createDataFrame(sampler_graph(pathways), EDGE)


def ids(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} bigint")


def test_connected_pairs_and_topology(spark):
    edges = sampler(spark)
    pairs = rows_of(pa.connected_pairs(edges), "drug", "disease")
    assert pairs == [(1, 21), (1, 22), (2, 21), (2, 22), (3, 22), (4, 23)]
    links = {(1, 11), (1, 12), (2, 12), (3, 13), (4, 14), (5, 15)}
    genes = {21: [11, 12], 22: [12, 13], 23: [14], 24: [16]}
    brute = sorted((d, g, c) for d, g in links for c, gs in genes.items() if g in gs)
    assert rows_of(pa.topology_paths(edges), "drug", "gene", "disease") == brute
    spread = pa.join_on_gene(gr.drug_gene(edges), gr.disease_gene(edges), paths_per_task=1)
    assert rows_of(spread, "drug", "gene", "disease") == brute


def test_hub_gene_is_spread_without_loss(spark):
    left = spark.range(300).select(F.col("id").alias("drug"), F.when(F.col("id") < 250, 1).otherwise(F.col("id")).cast("bigint").alias("gene"))
    right = spark.range(200).select(F.col("id").alias("disease"), F.when(F.col("id") < 150, 1).otherwise(F.col("id") + 200).cast("bigint").alias("gene"))
    plain = left.join(right, "gene").select("drug", "gene", "disease")
    spread = pa.join_on_gene(left, right, paths_per_task=500).select("drug", "gene", "disease")
    assert spread.count() == plain.count() > 37_500 - 1
    assert spread.exceptAll(plain).isEmpty()


def test_quads_of_a_pair(spark):
    edges = sampler(spark, pathways=True)
    paths = spark.createDataFrame([(1, 12, 21), (4, 14, 23)], "drug bigint, gene bigint, disease bigint")
    quads = pa.expand_to_quads(paths, gr.gene_pathways(edges))
    assert rows_of(quads, "drug", "gene", "pathway", "disease") == [(1, 12, 31, 21), (1, 12, 32, 21), (4, 14, 0, 23)]


def test_shared_genes_matches_brute_force(spark):
    edges = sampler(spark)
    pairs = spark.createDataFrame(list(product(range(1, 6), range(21, 25))), PAIR)
    found = pa.shared_genes(pairs, gr.drug_gene(edges), gr.disease_gene(edges))
    assert rows_of(found, "drug", "gene", "disease") == rows_of(pa.topology_paths(edges), "drug", "gene", "disease")


def test_a_pair_in_two_splits_belongs_to_the_last(spark):
    rows = [("train", 8, 9), ("test", 8, 9), ("valid", 8, 9)]
    splits = spark.createDataFrame(rows, "split string, drug bigint, disease bigint")
    assert rows_of(pa.last_split(splits), "split") == [("test",)]


def sample(spark, strategy, positives, **pools):
    edges = sampler(spark)
    pos = spark.createDataFrame(positives, PAIR)
    known = pa.known_positive_pairs(pos, edges, spark.createDataFrame([(1, 21), (4, 23)], PAIR))
    return sa.negative_pairs(
        pos, pa.connected_pairs(edges), known, ids(spark, "drug", range(1, 6)), ids(spark, "disease", range(21, 25)),
        strategy, 1, **{k: ids(spark, k.split("_")[0], v) for k, v in pools.items()},
    ).select("neg_drug", "neg_disease", "used").collect()


FREE = {(2, 21), (1, 22), (2, 22), (3, 22)}  # connected pairs that are not known


@pytest.mark.parametrize("strategy, allowed", [("cross_drug", {(2, 21)}), ("cross_disease", {(1, 22)}), ("random", FREE)])
def test_topology_negatives(spark, strategy, allowed):
    got = sample(spark, strategy, [(1, 21)])
    assert len(got) == 1 and tuple(got[0])[:2] in allowed and got[0].used == strategy


def test_fallback_to_random_when_nothing_is_connected(spark):
    got = sample(spark, "cross_drug", [(4, 23)])
    assert got[0].used == "random" and tuple(got[0])[:2] in FREE


def test_restricted_pools(spark):
    assert tuple(sample(spark, "cross_disease", [(1, 21)], disease_pool=[24])[0])[:2] == (1, 24)
    assert tuple(sample(spark, "cross_drug", [(1, 21)], drug_pool=[5])[0])[:2] == (5, 21)
    assert tuple(sample(spark, "random", [(1, 21)], drug_pool=[3], disease_pool=[24])[0])[:2] == (3, 24)


def test_pool_validation(spark):
    with pytest.raises(ValueError):
        sa.validate_pool(ids(spark, "drug", [99]), ids(spark, "drug", [10]))
    with pytest.raises(ValueError):
        sa.validate_pool(ids(spark, "drug", []), ids(spark, "drug", [10]))


@pytest.mark.parametrize("step, per_task", [(1 << 16, 1 << 20), (3, 4), (1, 7), (5, 2)])
def test_kth_free_counts_past_what_is_taken(spark, step, per_task):
    pool = spark.range(10).select((F.col("id") + 100).alias("v"), F.col("id").alias("idx"), F.lit(10).cast("bigint").alias("idx_n"))
    taken = {1: list(range(10)), 2: [], 3: [0, 1, 2, 3], 4: [1, 2], 5: [0, 2, 3, 4, 5, 6, 7, 8, 9], 6: list(range(9))}
    excluded = spark.createDataFrame([(c, 100 + i) for c, s in taken.items() for i in s] + [(3, 100)], "c int, v bigint")
    asked = spark.createDataFrame([(c, r, r) for c in taken for r in range(25)], "c int, r int, _k bigint")
    got = {(r.c, r.r): r.v for r in sa.kth_free(asked, ["c", "r"], ["c"], pool, [], excluded, "v", step, per_task).collect()}
    free = {c: [100 + i for i in range(10) if i not in s] for c, s in taken.items()}
    assert got == {(c, r): f[r % len(f)] for c, f in free.items() if f for r in range(25)}


def test_negative_genes_with_an_almost_full_pair(spark):
    paths = spark.createDataFrame([(1, g, 2) for g in range(9)] + [(3, 0, 4)], "drug bigint, gene bigint, disease bigint")
    genes = spark.range(10).select(F.col("id").alias("gene"))
    got = sa.negative_genes(paths, genes, 5, draws=1).collect()
    assert len(got) == 10
    assert all(r.neg_gene == 9 for r in got if r.drug == 1)
    assert all(r.neg_gene != 0 for r in got if r.drug == 3)
    with pytest.raises(ValueError, match="negative gene"):
        sa.negative_genes(paths, genes.filter("gene < 9"), 5)
    full = sa.negative_genes(paths, genes.filter("gene < 9"), 5, on_missing="drop")
    assert rows_of(full, "drug") == [(3,)]
    assert rows_of(sa.unresolved(paths, full, ["drug", "gene", "disease"]), "gene") == [(g,) for g in range(9)]


def test_tight_random_pools_stay_uniform(spark):
    """With three free pairs among 36 and one try, all three are drawn, and nothing else."""
    free = {(1, 103), (4, 100), (5, 105)}
    known = spark.createDataFrame([(d, c) for d in range(6) for c in range(100, 106) if (d, c) not in free], PAIR)
    positives = spark.createDataFrame([(50 + i, 200 + i) for i in range(60)], PAIR)
    got = sa.negative_pairs(
        positives, spark.createDataFrame([], PAIR), known, ids(spark, "drug", range(6)), ids(spark, "disease", range(100, 106)),
        "random", 1, draws=1,
    ).collect()
    drawn = [(r.neg_drug, r.neg_disease) for r in got]
    assert len(got) == 60 and set(drawn) == free and min(drawn.count(x) for x in free) >= 8


def test_a_positive_without_any_negative_is_an_error(spark):
    known = spark.createDataFrame([(1, 2)], PAIR)
    run = lambda **k: sa.negative_pairs(known, known, known, ids(spark, "drug", [1]), ids(spark, "disease", [2]), "mixed", 1, **k)
    with pytest.raises(ValueError, match="negative pair"):
        run()
    assert run(on_missing="drop").count() == 0


def test_negatives_do_not_depend_on_partitioning(spark):
    rows = [(d, c) for d in range(40) for c in range(40) if (d * c) % 3 == 0]
    connected = spark.createDataFrame([(d, c) for d in range(40) for c in range(40)], PAIR)
    pos = spark.createDataFrame(rows, PAIR)

    def run(parts):
        return rows_of(
            sa.negative_pairs(
                pos.repartition(parts), connected.repartition(parts), pos, ids(spark, "drug", range(40)),
                ids(spark, "disease", range(40)), "mixed", 3,
            ), "drug", "disease", "neg_drug", "neg_disease",
        )

    first = run(2)
    assert first == run(7)
    assert not {(a, b) for _, _, a, b in first} & set(rows)


def test_hot_pool_groups_are_numbered_in_slices(spark):
    pool = spark.range(1000).select((F.col("id") % 7 == 0).cast("int").alias("g"), F.col("id").alias("v"))
    pool = pool.withColumn("_h", key_hash(1, "v"))
    from pathloom.operators.numbering import number_within

    small = rows_of(number_within(pool, ["g"], "_h", ["v"], rows_per_task=50), "g", "v", "idx", "idx_n")
    assert small == rows_of(number_within(pool, ["g"], "_h", ["v"]), "g", "v", "idx", "idx_n")


POSITIVES = [(1, 11, 31, 21), (2, 11, 32, 21), (2, 12, 32, 22), (3, 13, 0, 23)]
OTHER_QUADS = [(1, 11, 32, 21), (2, 11, 31, 21), (2, 12, 32, 21)]
QUAD = ["drug", "gene", "pathway", "disease"]


@pytest.mark.parametrize("by_edges, draws", [(False, 4), (True, 4), (True, 1)])
def test_corruption_groups(spark, by_edges, draws):
    edges = spark.createDataFrame(mechanism_graph(), EDGE)
    nodes = spark.createDataFrame(node_rows(range(1, 5), range(11, 16), range(31, 35), range(21, 25)), NODE)
    real = pa.real_quads(edges)
    assert set(rows_of(real, *QUAD)) == {*POSITIVES, *OTHER_QUADS}
    quads = spark.createDataFrame(POSITIVES, "drug bigint, gene bigint, pathway bigint, disease bigint")
    rows = sa.corrupt_paths(quads, nodes, *((None, 11, draws, edges) if by_edges else (real, 11, draws))).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.pos_drug, r.pos_gene, r.pos_pathway, r.pos_disease), {})[r.candidate_idx] = r
    assert set(groups) == set(POSITIVES)
    true = set(rows_of(real, *QUAD))
    for pos, group in groups.items():
        assert sorted(group) == [0, 1, 2, 3, 4]
        assert [group[i].label for i in range(5)] == [1, 0, 0, 0, 0]
        assert tuple(group[0][c] for c in QUAD) == pos
        for i in range(1, 5):
            ids_ = tuple(group[i][c] for c in QUAD)
            assert [a != b for a, b in zip(ids_, pos)] == [j == i - 1 for j in range(4)]
            assert ids_ not in true


def test_ladder_spreads_a_context_with_many_exclusions(spark):
    """60,000 excluded numbers of one context stand in steps of 1,000, and no window holds more of it than a step."""
    n = 90_000
    pool = spark.range(n).select(F.col("id").alias("v"), F.col("id").alias("idx"), F.lit(n).cast("bigint").alias("idx_n"))
    excluded = spark.range(n).filter("id % 3 <> 1").select(F.lit(1).alias("c"), F.col("id").alias("v"))
    asked = spark.range(2000).select(F.lit(1).alias("c"), F.col("id").alias("r"), (F.col("id") * 15).alias("_k"))
    out = sa.kth_free(asked, ["c", "r"], ["c"], pool, [], excluded, "v", 1000, 500)
    assert {r.r: r.v for r in out.collect()} == {r: 3 * ((15 * r) % (n // 3)) + 1 for r in range(2000)}
    windows = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Window " in x]
    assert windows and all("_step" in x or "_part" in x for x in windows)


def test_values_that_complete_a_mechanism(spark):
    """Read off the edges of a context's own ids, they are those of the enumerated mechanisms."""
    draw = random.Random(5)
    link = lambda k, *ends: {tuple(draw.choice(e) for e in ends) for _ in range(k)}
    drugs, genes, ways, diseases = range(1, 6), range(10, 18), range(30, 34), range(50, 55)
    rows = [(d, "drug", "targets", "gene/protein", g) for d, g in link(18, drugs, genes)]
    rows += [(s, "disease", "disease_protein", "gene/protein", g) for s, g in link(18, diseases, genes)]
    rows += [(g, "gene/protein", "in_pathway", "pathway", w) for g, w in link(9, genes[:6], ways)]
    edges = spark.createDataFrame(rows, EDGE)
    real = set(rows_of(pa.real_quads(edges), *QUAD))
    contexts, want = set(), set()
    for q in real:
        for i in range(4):
            for other in (q, tuple(draw.choice(e) for e in (drugs, genes, [0, *ways], diseases))):
                at = tuple(-1 if k == i else v for k, v in enumerate(other))
                contexts.add((i, *at))
                want |= {(i, *at, r[i]) for r in real if all(k == i or r[k] == v for k, v in enumerate(other))}
    names = ["position", *[f"at_{c}" for c in QUAD]]
    asked = spark.createDataFrame(sorted(contexts), ", ".join(f"{n} bigint" for n in names))
    got = set(rows_of(sa._real_values(asked, edges), *names, "value"))
    # the dummy pathway is in no pool
    assert got == {w for w in want if w[0] != 2 or w[5] != 0} and len(got) > 50


def test_dropped_edges_keep_one_per_type(spark):
    edges = sampler(spark)
    none = sa.drop_edges(edges, 1.0, 3)
    assert none.count() == edges.select("rel").distinct().count()
    assert sa.drop_edges(edges, 1.0, 3, keep_one=False).isEmpty()
    assert sa.drop_edges(edges, 0.0, 3).count() == edges.count()


def test_banks(spark):
    own = spark.createDataFrame([(1, 2, 3), (1, 4, 3), (5, 6, 7)], "drug bigint, gene bigint, disease bigint")
    external = spark.createDataFrame([(1, 9, 3)], "drug bigint, gene bigint, disease bigint")
    assert rows_of(pa.positive_bank(own, external), "drug", "gene", "disease") == [(1, 9, 3), (5, 6, 7)]
    assert pa.topology_bank(own, external).count() == 4
    pairs = spark.createDataFrame([(1, 3), (8, 8)], PAIR)
    assert rows_of(pa.first_path_per_pair(pairs, own), "drug", "disease", "gene", "has_path") == [(1, 3, 2, True), (8, 8, 0, False)]


def test_paths_are_dealt_to_as_many_tasks_as_their_count_needs(spark):
    """Two small sides with many combinations: tasks follow the paths, not the bytes read."""
    left = spark.range(400).selectExpr("id as drug", "id % 4 as gene")
    right = spark.range(400).selectExpr("id as disease", "id % 4 as gene")
    joined = pa.join_on_gene(left, right, paths_per_task=2_000)
    assert joined.count() == 4 * 100 * 100
    sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 40_000 and len(sizes) >= 8 and max(sizes) <= 10_000
