"""Metric queries over score tables derived from the graph and from labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keyed import key_hash
from ..lineage import materialize
from ..operators import graph as gr
from ..operators import metrics as me
from ..operators import paths as pa
from ..operators import sampling as sa
from ..schema import DISEASE, DRUG
from .audit_queries import rounded
from .derived import connected, pseudo_score, scored_pairs, splits, triplets
from .graph_store import graph, table
from .oracle import SEED, expect, h, score
from .registry import query
from .sampling_queries import _NEG_BASE, negatives, negatives_sql, node_ids

# counts of positives and negatives per distinct score, and of those below it
_LADDER = """hist AS (SELECT g, s, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM lab GROUP BY g, s),
  lad AS (SELECT *, sum(pos) OVER (PARTITION BY g ORDER BY s) AS pos_to, sum(neg) OVER (PARTITION BY g ORDER BY s) AS neg_to, sum(pos) OVER (PARTITION BY g) AS p, sum(neg) OVER (PARTITION BY g) AS n FROM hist)"""
_AUROC = "round(sum(pos * (neg_to - neg + neg / 2.0::DOUBLE)) / nullif(max(p)::DOUBLE * max(n), 0), 6)"
_AP = "round(coalesce(sum(pos::DOUBLE / nullif(p, 0) * ((p - pos_to + pos)::DOUBLE / (p - pos_to + pos + n - neg_to + neg))), 0), 6)"
_F1 = "CASE WHEN 2 * (p - pos_to) + (n - neg_to) + pos_to > 0 THEN 2 * (p - pos_to)::DOUBLE / (2 * (p - pos_to) + (n - neg_to) + pos_to) ELSE 0 END"
_PAIRS = ", lab AS (SELECT 0 AS g, score AS s, label AS y FROM scored), "


@query(
    "auroc",
    expect("scored", _PAIRS + _LADDER + f" SELECT sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, {_AUROC} AS auroc FROM lad"),
)
def auroc(spark, sf_dir):
    return rounded(me.auroc(scored_pairs(spark, sf_dir)), "auroc")


@query(
    "average_precision",
    expect("scored", _PAIRS + _LADDER + f" SELECT sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, {_AP} AS average_precision FROM lad"),
)
def average_precision(spark, sf_dir):
    return rounded(me.average_precision(scored_pairs(spark, sf_dir)), "average_precision")


@query(
    "label_metrics",
    "WITH lab AS (SELECT lang AS g, n_chars::DOUBLE AS s, quality AS y FROM documents JOIN labels USING (doc_id)), "
    + _LADDER
    + f" SELECT g AS lang, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, {_AUROC} AS auroc, {_AP} AS average_precision FROM lad GROUP BY g",
)
def label_metrics(spark, sf_dir):
    """Document length as a score for the quality label, per language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").alias("score"))
    labelled = docs.join(table(spark, sf_dir, "labels").selectExpr("doc_id", "quality as label"), "doc_id")
    return rounded(me.ranking_metrics(labelled, ["lang"]), "auroc", "average_precision")


_PROB = "1.0::DOUBLE / (1.0::DOUBLE + exp(-score))"


@query(
    "best_f1",
    expect(
        "scored",
        f", lab AS (SELECT 0 AS g, score AS s, label AS y FROM scored), {_LADDER} SELECT round(1.0::DOUBLE / (1.0::DOUBLE + exp(-s)), 6) AS threshold, round(f1, 6) AS best_f1 FROM (SELECT s, {_F1} AS f1 FROM lad) ORDER BY round(f1, 12) DESC, s LIMIT 1",
    ),
)
def best_f1(spark, sf_dir):
    return rounded(me.best_f1_threshold(scored_pairs(spark, sf_dir)), "threshold", "best_f1")


@query(
    "f1_at",
    expect(
        "scored",
        f"""SELECT tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM (
  SELECT count(*) FILTER (WHERE y AND label = 1) AS tp, count(*) FILTER (WHERE y AND label = 0) AS fp, count(*) FILTER (WHERE NOT y AND label = 1) AS fn FROM (SELECT {_PROB} > 0.6::DOUBLE AS y, label FROM scored))""",
    ),
)
def f1_at(spark, sf_dir):
    return rounded(me.f1_at_threshold(scored_pairs(spark, sf_dir), 0.6), "f1")


# --- aligned positive and negative scores ---

_ALIGNED = negatives_sql("mixed") + f""", sc AS (SELECT used, {score('drug', 'disease')} + 0.5::DOUBLE AS pos_score, {score('neg_drug', 'neg_disease')} AS neg_score FROM neg)"""


def aligned_scores(spark, sf_dir):
    drawn = negatives(spark, sf_dir, "mixed")
    return drawn.select(
        "used",
        (pseudo_score("drug", "disease") + F.lit(0.5)).alias("pos_score"),
        pseudo_score("neg_drug", "neg_disease").alias("neg_score"),
    )


@query(
    "pairwise_accuracy",
    expect(_NEG_BASE, _ALIGNED + " SELECT used, count(*) AS n_pairs, round(avg(CASE WHEN pos_score > neg_score THEN 1.0::DOUBLE ELSE 0 END), 6) AS pairwise_accuracy FROM sc GROUP BY used"),
)
def pairwise_accuracy(spark, sf_dir):
    return rounded(me.pairwise_accuracy(aligned_scores(spark, sf_dir), ["used"]), "pairwise_accuracy")


@query(
    "pair_losses",
    expect(
        _NEG_BASE,
        _ALIGNED
        + """ SELECT used, count(*) AS n_pairs, round(avg(ln(1 + exp(-(pos_score - neg_score)))), 6) AS bpr, round(sum(ln(1 + exp(-pos_score)) + ln(1 + exp(neg_score))) / (2 * count(*)), 6) AS bce FROM sc GROUP BY used""",
    ),
)
def pair_losses(spark, sf_dir):
    return rounded(me.pair_losses(aligned_scores(spark, sf_dir), ["used"]), "bpr", "bce")


_SETTINGS = (
    """, valid AS (SELECT drug, disease FROM connected EXCEPT SELECT drug, disease FROM pairs),
  held AS (SELECT split, drug, disease FROM (SELECT DISTINCT split, drug, disease FROM pt_random) WHERE split <> 'train'),
  drawn AS ("""
    + " UNION ALL ".join(
        f"""SELECT p.split, '{name}' AS setting, p.drug, p.disease, coalesce(a.drug, r.drug) AS neg_drug, coalesce(a.disease, r.disease) AS neg_disease FROM held p
    LEFT JOIN (SELECT *, row_number() OVER ({part} ORDER BY {h(SEED, *keys)}, drug, disease) - 1 AS i, count(*) OVER ({part}) AS n FROM valid) a
      ON {on} a.i = {h(f'{SEED}:{name}', 'p.drug', 'p.disease')} % a.n
    LEFT JOIN (SELECT *, row_number() OVER (ORDER BY {h(SEED, 'drug', 'disease')}, drug, disease) - 1 AS i, count(*) OVER () AS n FROM valid) r ON r.i = {h(f'{SEED}:random', 'p.drug', 'p.disease')} % r.n"""
        for name, part, keys, on in (
            ("random", "", ("drug", "disease"), ""),
            ("cross_drug", "PARTITION BY disease", ("drug",), "a.disease = p.disease AND"),
            ("cross_disease", "PARTITION BY drug", ("disease",), "a.drug = p.drug AND"),
        )
    )
    + f"""), sc AS (SELECT split, setting, {score('drug', 'disease')} + 0.25::DOUBLE AS pos_score, {score('neg_drug', 'neg_disease')} AS neg_score FROM drawn),
  lab AS (SELECT split || ':' || setting AS g, pos_score AS s, 1 AS y FROM sc UNION ALL SELECT split || ':' || setting, neg_score, 0 FROM sc), """
)


@query(
    "settings",
    expect(
        ("pt_random", "pairs", "connected"),
        _SETTINGS + _LADDER
        + f""" SELECT split_part(g, ':', 1) AS split, split_part(g, ':', 2) AS setting, n_pairs, round(acc, 6) AS pairwise_accuracy, auroc, average_precision FROM
  (SELECT g, {_AUROC} AS auroc, {_AP} AS average_precision FROM lad GROUP BY g) JOIN
  (SELECT split || ':' || setting AS g, count(*) AS n_pairs, avg(CASE WHEN pos_score > neg_score THEN 1.0::DOUBLE ELSE 0 END) AS acc FROM sc GROUP BY ALL) USING (g)""",
    ),
)
def settings(spark, sf_dir):
    """Held-out pairs of each split against negatives of each setting."""
    held = triplets(spark, sf_dir, "random").filter("split <> 'train'").select("split", "drug", "disease").distinct()
    drawn = sa.negative_pairs(
        held, connected(spark, sf_dir), gr.pair_relations(graph(spark, sf_dir).edges),
        node_ids(spark, sf_dir, DRUG, "drug"), node_ids(spark, sf_dir, DISEASE, "disease"),
        ("random", "cross_drug", "cross_disease"), SEED,
    )
    scored = held.join(drawn, ["drug", "disease"]).select(
        "split",
        F.col("strategy").alias("setting"),
        (pseudo_score("drug", "disease") + F.lit(0.25)).alias("pos_score"),
        pseudo_score("neg_drug", "neg_disease").alias("neg_score"),
    )
    scored = materialize(scored, "scored")
    return rounded(me.evaluate_settings(scored), "pairwise_accuracy", "auroc", "average_precision")


# --- grouped candidates: each quad of a known pair against its gene's other pairs ---

_GROUPS = f""", q AS (SELECT drug, gene, coalesce(pathway, 0) AS pathway, disease FROM (SELECT DISTINCT drug, gene, disease FROM pt_random) LEFT JOIN gp USING (gene)),
  cs AS (SELECT drug, gene, pathway, disease, c AS candidate_idx, ({h('cand', 'drug', 'gene', 'pathway', 'disease', 'c')} % 8)::DOUBLE / 4::DOUBLE AS score FROM q, range(5) t(c)),
  rk AS (SELECT a.drug, a.gene, a.pathway, a.disease, count(*) FILTER (WHERE b.score > a.score) AS g, count(*) FILTER (WHERE b.score = a.score AND b.candidate_idx > 0) AS t, count(*) AS m
    FROM cs a JOIN cs b USING (drug, gene, pathway, disease) WHERE a.candidate_idx = 0 {{extra}} GROUP BY ALL)"""
_GROUP_KEYS = ["drug", "gene", "pathway", "disease"]


def grouped_scores(spark, sf_dir):
    """Five scored candidates per quad of a known pair; few distinct scores, hence ties."""
    edges = graph(spark, sf_dir).edges
    quads = pa.expand_to_quads(triplets(spark, sf_dir, "random").drop("split"), gr.gene_pathways(edges), distinct=True)
    candidates = quads.withColumn("candidate_idx", F.explode(F.sequence(F.lit(0), F.lit(4))))
    value = F.pmod(key_hash("cand", *_GROUP_KEYS, "candidate_idx"), F.lit(8)).cast("double") / F.lit(4.0)
    return candidates.withColumn("score", value)


def _hits_sql(ties: str) -> str:
    hit = {
        "min": lambda k: f"avg(CASE WHEN 1 + g <= {k} THEN 1.0::DOUBLE ELSE 0 END)",
        "mid": lambda k: f"avg(CASE WHEN 1 + g + t * 0.5 <= {k} THEN 1.0::DOUBLE ELSE 0 END)",
        "expected": lambda k: f"avg(least(1, greatest(0, ({k} - g)::DOUBLE / (t + 1))))",
    }[ties]
    mrr = {
        "min": "avg(1.0::DOUBLE / (1 + g))",
        "mid": "avg(1.0::DOUBLE / (1 + g + t * 0.5::DOUBLE))",
        "expected": "avg(list_sum(list_transform(range(t + 1), lambda j: 1.0::DOUBLE / (1 + g + j))) / (t + 1))",
    }[ties]
    return f"SELECT '{ties}' AS ties, count(*) AS n_groups, sum(m)::BIGINT AS n_candidates, round({hit(1)}, 6) AS hit_at_1, round({hit(3)}, 6) AS hit_at_3, round({mrr}, 6) AS mrr FROM rk"


@query(
    "hits_mrr",
    expect(("pt_random", "gp"), _GROUPS.format(extra="") + " " + " UNION ALL ".join(_hits_sql(t) for t in ("min", "mid", "expected"))),
)
def hits_mrr(spark, sf_dir):
    scores = grouped_scores(spark, sf_dir)
    out = None
    for ties in ("min", "mid", "expected"):
        row = me.hits_mrr(scores, _GROUP_KEYS, (1, 3), ties).select(F.lit(ties).alias("ties"), "*")
        out = row if out is None else out.unionByName(row)
    return rounded(out, "hit_at_1", "hit_at_3", "mrr")


@query(
    "pair_fixed",
    expect(
        ("pt_random", "gp"),
        _GROUPS.format(extra="AND b.candidate_idx IN (0, 2, 3)")
        + ", lab AS (SELECT 0 AS g, score AS s, CASE WHEN candidate_idx = 0 THEN 1 ELSE 0 END AS y FROM cs WHERE candidate_idx IN (0, 2, 3)), "
        + _LADDER
        + f""" SELECT count(*) AS n_groups, sum(m)::BIGINT AS n_candidates, round(avg(least(1, greatest(0, (1 - g)::DOUBLE / (t + 1)))), 6) AS hit_at_1,
  round(avg(list_sum(list_transform(range(t + 1), lambda j: 1.0::DOUBLE / (1 + g + j))) / (t + 1)), 6) AS mrr, (SELECT {_AP} FROM lad) AS average_precision FROM rk""",
    ),
)
def pair_fixed(spark, sf_dir):
    scores = grouped_scores(spark, sf_dir).withColumn("label", (F.col("candidate_idx") == 0).cast("int"))
    return rounded(me.pair_fixed_metrics(scores, _GROUP_KEYS), "hit_at_1", "mrr", "average_precision")


@query(
    "tie_audit",
    expect(
        ("pt_random", "gp"),
        _GROUPS.format(extra="")
        + """ SELECT drug, gene, pathway, disease, bool_and(b.candidate_idx NOT IN (0, 2, 3) OR b.score = a.score) AS same_pair_exact,
  bool_and(b.candidate_idx NOT IN (0, 2, 3) OR abs(b.score - a.score) <= 1e-8::DOUBLE + 1e-7::DOUBLE * abs(a.score)) AS same_pair_close,
  bool_and(abs(b.score - a.score) <= 1e-8::DOUBLE + 1e-7::DOUBLE * abs(a.score)) AS group_close, max(b.score) - min(b.score) AS spread
  FROM cs a JOIN cs b USING (drug, gene, pathway, disease) WHERE a.candidate_idx = 0 GROUP BY ALL""",
    ),
)
def tie_audit(spark, sf_dir):
    return me.tie_audit(grouped_scores(spark, sf_dir), _GROUP_KEYS)


# --- one target against every drug ---

_UNIVERSE = f""", sc AS (SELECT drug, disease, {score('drug', 'disease')} AS score FROM connected),
  univ AS (SELECT DISTINCT t.disease, n.global_id AS drug FROM {{targets}} t, nodes n WHERE n.node_type = 'drug'),
  cand AS (SELECT u.disease, u.drug, coalesce(sc.score, 0) AS score FROM univ u LEFT JOIN sc USING (drug, disease)
    WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.drug = u.drug AND k.disease = u.disease)),
  ranks AS (SELECT t.drug, t.disease, count(c.drug) FILTER (WHERE c.score > t.score) AS greater, count(c.drug) FILTER (WHERE c.score = t.score) AS ties
    FROM {{targets}} t LEFT JOIN cand c ON c.disease = t.disease GROUP BY t.drug, t.disease)"""
_TEST = f""", known AS (SELECT drug, disease FROM pairs), tg AS (SELECT s.drug, s.disease, coalesce(sc0.score, 0) AS score FROM split_random s
    LEFT JOIN (SELECT drug, disease, {score('drug', 'disease')} AS score FROM connected) sc0 USING (drug, disease) WHERE split = 'test')"""
_EXTERNAL = f""", known AS (SELECT drug, disease FROM pairs), tg AS (SELECT DISTINCT drug, disease, {score('disease', 'drug')} AS score FROM pt_cross_disease WHERE split = 'ot')"""


def _ranks(spark, sf_dir, targets):
    edges = graph(spark, sf_dir).edges
    linked = connected(spark, sf_dir).withColumn("score", pseudo_score("drug", "disease"))
    n_drugs = graph(spark, sf_dir).nodes.filter(F.col("node_type") == DRUG).agg(F.count("*")).scalar()
    return me.filtered_mrr(targets, linked, gr.pair_relations(edges), n_drugs, 0.0)


def _test_targets(spark, sf_dir):
    """Test pairs with their topology score, 0 without a path."""
    test = splits(spark, sf_dir, "random").filter("split = 'test'")
    linked = connected(spark, sf_dir).join(test, ["drug", "disease"], "left_semi").withColumn("_linked", F.lit(True))
    score = F.when(F.col("_linked"), pseudo_score("drug", "disease")).otherwise(F.lit(0.0))
    return test.join(linked, ["drug", "disease"], "left").select("drug", "disease", score.alias("score"))


@query(
    "filtered_ranks",
    expect(
        ("pairs", "split_random", "connected", "nodes"),
        _TEST + _UNIVERSE.format(targets="tg") + " SELECT drug, disease, greater, ties, 1 + greater + 0.5::DOUBLE * ties AS rank FROM ranks",
    ),
)
def filtered_ranks(spark, sf_dir):
    return _ranks(spark, sf_dir, _test_targets(spark, sf_dir))


@query(
    "filtered_mrr",
    expect(
        ("pairs", "split_random", "connected", "nodes"),
        _TEST + _UNIVERSE.format(targets="tg") + " SELECT count(*) AS n_targets, round(avg(1.0::DOUBLE / (1 + greater + 0.5::DOUBLE * ties)), 6) AS mrr FROM ranks",
    ),
)
def filtered_mrr(spark, sf_dir):
    return rounded(me.mean_reciprocal_rank(_ranks(spark, sf_dir, _test_targets(spark, sf_dir))), "mrr")


@query(
    "filtered_mrr_external",
    expect(
        ("pairs", "pt_cross_disease", "connected", "nodes"),
        _EXTERNAL + _UNIVERSE.format(targets="tg") + " SELECT count(*) AS n_targets, round(avg(1.0::DOUBLE / (1 + greater + 0.5::DOUBLE * ties)), 6) AS mrr FROM ranks",
    ),
)
def filtered_mrr_external(spark, sf_dir):
    """External targets scored from their own path bank, candidates from the topology."""
    ot = triplets(spark, sf_dir, "cross_disease").filter("split = 'ot'").select("drug", "disease").distinct()
    targets = ot.withColumn("score", pseudo_score("disease", "drug"))
    return rounded(me.mean_reciprocal_rank(_ranks(spark, sf_dir, targets)), "mrr")


@query(
    "seed_summary",
    """SELECT o_orderpriority AS variant, count(*) AS n_runs, round(avg(price), 6) AS price_mean, round(coalesce(stddev_samp(price), 0), 6) AS price_std,
  round(avg(items), 6) AS items_mean, round(coalesce(stddev_samp(items), 0), 6) AS items_std, printf('%.4f +/- %.4f', avg(items), coalesce(stddev_samp(items), 0)) AS items_text
  FROM (SELECT o_orderpriority, year(o_orderdate) AS y, avg(o_totalprice) / 100000 AS price, count(*)::DOUBLE AS items FROM orders GROUP BY ALL) GROUP BY o_orderpriority""",
)
def seed_summary(spark, sf_dir):
    """One run per year of orders, one variant per order priority."""
    runs = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(
        (F.avg("o_totalprice") / 100000).alias("price"), F.count("*").cast("double").alias("items")
    )
    out = me.seed_summary(runs.withColumnRenamed("o_orderpriority", "variant"), ["variant"], ["price", "items"], True)
    return rounded(out.drop("price_text"), "price_mean", "price_std", "items_mean", "items_std")
