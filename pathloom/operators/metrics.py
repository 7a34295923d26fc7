"""Ranking and threshold metrics over external score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import neg_log_sigmoid, safe_ratio, sigmoid, softplus
from ..lineage import materialize
from .numbering import prefix_sums


def ranked_rows(scores: DataFrame, score: str) -> DataFrame:
    """Rows whose score is a number."""
    # NaN is above infinity; a derived score is computed once
    return scores.filter(F.col(score).cast("double") <= F.lit(float("inf")))


def score_histogram(scores: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """One row per (group, score) with positives, negatives and those below it.

    Ties collapse before anything is ordered, so a score shared by a third of
    the rows is one row here. Rows without a score (null or NaN) or without a
    label rank nowhere and are left out.
    """
    positive = F.col(label).cast("int") == 1
    # rows without a number go after they are counted: a filter before would compute a derived score again
    counts = scores.filter(F.col(label).isNotNull()).groupBy(*groups, F.col(score).cast("double").alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    return prefix_sums(ranked_rows(materialize(counts, "scores"), "score"), "score", ["pos", "neg"], groups)


def _with_totals(hist: DataFrame, groups: Sequence[str]) -> DataFrame:
    totals = hist.groupBy(*groups).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if groups:
        return hist.join(totals, list(groups))
    return hist.withColumns({c: totals.select(c).scalar() for c in ("P", "N")})


def ranking_metrics(
    scores: DataFrame, groups: Sequence[str] = (), score: str = "score", label: str = "label"
) -> DataFrame:
    """auroc (ties averaged; null for one class) and step-sum average precision."""
    hist = _with_totals(score_histogram(scores, score, label, groups), groups)
    tp = F.col("P") - F.col("pos_before")
    fp = F.col("N") - F.col("neg_before")
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return hist.groupBy(*groups).agg(
        F.sum("pos").cast("bigint").alias("n_pos"),
        F.sum("neg").cast("bigint").alias("n_neg"),
        F.try_divide(wins, F.max(F.col("P").cast("double") * F.col("N"))).alias("auroc"),
        safe_ratio(F.sum(F.col("pos") * F.try_divide(tp.cast("double"), tp + fp)), F.max("P")).alias(
            "average_precision"
        ),
    )


def auroc(scores: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(scores, groups).drop("average_precision")


def average_precision(scores: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(scores, groups).drop("auroc")


def pairwise_accuracy(scored: DataFrame, groups: Sequence[str] = (), pos: str = "pos_score", neg: str = "neg_score") -> DataFrame:
    """Share of aligned pairs whose positive scores strictly higher."""
    return scored.groupBy(*groups).agg(
        F.count("*").alias("n_pairs"), F.avg((F.col(pos) > F.col(neg)).cast("double")).alias("pairwise_accuracy")
    )


def best_f1_threshold(scores: DataFrame, groups: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Lowest probability t whose rule ``probability > t`` has the highest F1."""
    probs = scores.withColumn("_p", sigmoid(score))
    hist = _with_totals(score_histogram(probs, "_p", label, groups), groups)
    tp = F.col("P") - F.col("pos_before") - F.col("pos")
    fp = F.col("N") - F.col("neg_before") - F.col("neg")
    f1 = safe_ratio(2 * tp, tp + fp + F.col("P"))
    best = hist.withColumn("f1", f1).groupBy(*groups).agg(
        F.max_by(F.struct(F.col("score").alias("threshold"), "f1"), F.struct("f1", -F.col("score"))).alias("_b")
    )
    return best.select(
        *groups,
        F.coalesce("_b.threshold", F.lit(0.5)).alias("threshold"),
        F.coalesce("_b.f1", F.lit(0.0)).alias("best_f1"),
    )


def f1_at_threshold(
    scores: DataFrame, threshold: float | Column, groups: Sequence[str] = (), score: str = "score", label: str = "label"
) -> DataFrame:
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    hit, true = sigmoid(score) > t, F.col(label).cast("int") == 1
    tp, fp, fn = F.count_if(hit & true), F.count_if(hit & ~true), F.count_if(~hit & true)
    return scores.groupBy(*groups).agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1")
    )


EXACT_PLACES = 10_000


def positive_ranks(scores: DataFrame, group_keys: Sequence[str]) -> DataFrame:
    """Per group, how many candidates beat (``better``) or tie (``ties``) candidate 0."""
    keys = list(group_keys)
    own = scores.filter("candidate_idx = 0").select(*keys, F.col("score").alias("_own"))
    joined = scores.join(own, keys)
    return joined.groupBy(*keys).agg(
        F.count_if(F.col("score") > F.col("_own")).alias("better"),
        F.count_if((F.col("score") == F.col("_own")) & (F.col("candidate_idx") != 0)).alias("ties"),
        F.count("*").alias("n_candidates"),
    )


def _expected_reciprocal() -> Column:
    """Mean of 1/rank over the equally likely places among the tied candidates.

    The first places are added one by one, at most EXACT_PLACES of them; the rest
    is the closed form of a harmonic sum, whose error is below 1e-15 there.
    """
    first, last = F.col("better") + 1, F.col("better") + F.col("ties") + 1
    few = F.sequence(first, F.least(last, first + EXACT_PLACES))
    head = F.aggregate(few, F.lit(0.0), lambda acc, r: acc + F.lit(1.0) / r)

    def harmonic(n: Column) -> Column:
        n = n.cast("double")
        return F.log(n) + 1 / (2 * n) - 1 / (12 * n * n) + 1 / (120 * n * n * n * n)

    tail = F.when(last > first + EXACT_PLACES, harmonic(last) - harmonic(first + EXACT_PLACES)).otherwise(0.0)
    return (head + tail) / (F.col("ties") + 1)


def hits_mrr(scores: DataFrame, group_keys: Sequence[str], ks: Sequence[int] = (1,), ties: str = "min") -> DataFrame:
    """Hit@k and mean reciprocal rank of candidate 0.

    ``ties``: 'min' ranks a tie in favour of the positive, 'mid' in the middle,
    'expected' averages over the places it may take.
    """
    ranks = positive_ranks(scores, group_keys)
    better, tied = F.col("better"), F.col("ties")
    if ties == "expected":
        # chance to land in the first k when the tied places are equally likely
        hits = {k: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(k) - better) / (tied + 1))) for k in ks}
        reciprocal = _expected_reciprocal()
    else:
        rank = 1 + better + (tied * 0.5 if ties == "mid" else F.lit(0))
        hits = {k: (rank <= k).cast("double") for k in ks}
        reciprocal = 1.0 / rank
    return ranks.agg(
        F.count("*").alias("n_groups"),
        F.sum("n_candidates").cast("bigint").alias("n_candidates"),
        *[F.avg(c).alias(f"hit_at_{k}") for k, c in hits.items()],
        F.avg(reciprocal).alias("mrr"),
    )


# --- fixed values: candidates that share the positive's pair ---
PAIR_FIXED_CANDIDATES = (0, 2, 3)
# --- end of fixed values ---


def pair_fixed_metrics(scores: DataFrame, group_keys: Sequence[str]) -> DataFrame:
    """Metrics over the candidates with the positive's drug and disease.

    Ties count with the expectation of breaking them by vanishing noise.
    """
    kept = scores.filter(F.col("candidate_idx").isin(*PAIR_FIXED_CANDIDATES))
    precision = average_precision(kept).select("average_precision")
    return hits_mrr(kept, group_keys, (1,), "expected").withColumn(
        "average_precision", precision.scalar()
    )


def filtered_mrr(
    targets: DataFrame, candidate_scores: DataFrame, known: DataFrame, n_drugs: int | Column, default_score: float
) -> DataFrame:
    """(drug, disease, rank) of each target among all drugs not known for its disease.

    ``targets`` has the target's own ``score``; ``candidate_scores`` holds the
    (drug, disease, score) rows that differ from ``default_score``, the score of
    every drug without a row; a row without a number as score counts as no row.
    Targets need a score. Candidates are counted by a prefix sum over the scores of
    a disease; the (target, candidate) pairs are never formed.
    """
    targets = materialize(ranked_rows(targets, "score"), "targets")
    known = known.select("drug", "disease").unionByName(targets.select("drug", "disease")).distinct()
    asked = candidate_scores.join(targets.select("disease").distinct(), "disease", "left_semi")
    free = asked.join(known, ["drug", "disease"], "left_anti")
    n_known = known.groupBy("disease").agg(F.count("*").alias("_known"))
    scored = F.col("score").cast("double").alias("score")
    # weight 1 marks a candidate, weight 0 the place of a target's score
    spots = free.select("disease", scored, F.lit(1).alias("_w")).unionByName(
        targets.select("disease", scored, F.lit(0).alias("_w"))
    )
    counts = spots.groupBy("disease", "score").agg(F.sum("_w").cast("bigint").alias("n"))
    counts = ranked_rows(materialize(counts, "candidates"), "score")
    ladder = prefix_sums(counts, "score", ["n"], ["disease"])
    totals = counts.groupBy("disease").agg(F.sum("n").alias("_scored"))
    at = targets.withColumn("score", F.col("score").cast("double"))
    placed = at.join(ladder, ["disease", "score"]).join(totals, "disease").join(n_known, "disease")
    drugs = F.lit(n_drugs) if isinstance(n_drugs, int) else n_drugs
    silent = drugs - F.col("_known") - F.col("_scored")
    greater = F.col("_scored") - F.col("n_before") - F.col("n")
    greater = greater + F.when(F.lit(default_score) > F.col("score"), silent).otherwise(F.lit(0))
    ties = F.col("n") + F.when(F.col("score") == F.lit(default_score), silent).otherwise(F.lit(0))
    return placed.select(
        "drug", "disease", greater.cast("bigint").alias("greater"), ties.cast("bigint").alias("ties"),
        (1.0 + greater + 0.5 * ties).alias("rank"),
    )


def mean_reciprocal_rank(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.count("*").alias("n_targets"), F.avg(1.0 / F.col("rank")).alias("mrr"))


def pair_losses(scored: DataFrame, groups: Sequence[str] = (), pos: str = "pos_score", neg: str = "neg_score") -> DataFrame:
    """Mean pairwise ranking loss and binary cross entropy over both scores."""
    bce = F.sum(softplus(-F.col(pos)) + softplus(neg)) / (2 * F.count("*"))
    return scored.groupBy(*groups).agg(
        F.count("*").alias("n_pairs"), F.avg(neg_log_sigmoid(F.col(pos) - F.col(neg))).alias("bpr"), bce.alias("bce")
    )


def evaluate_settings(scored: DataFrame) -> DataFrame:
    """Accuracy, AUROC and AP per (split, setting) of aligned scored pairs."""
    keys = ["split", "setting"]
    long = scored.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("pos_score").alias("score"), F.lit(1).alias("label")),
                F.struct(F.col("neg_score").alias("score"), F.lit(0).alias("label")),
            )
        ),
    )
    return pairwise_accuracy(scored, keys).join(
        ranking_metrics(long, keys).select(*keys, "auroc", "average_precision"), keys
    )


def seed_summary(runs: DataFrame, by: Sequence[str], metrics: Sequence[str], single_std_zero: bool = False) -> DataFrame:
    """Mean, sample deviation and ``m +/- s`` of each metric over the runs of a group."""
    aggs = []
    for m in metrics:
        std = F.stddev_samp(m)
        aggs += [F.avg(m).alias(f"{m}_mean"), (F.coalesce(std, F.lit(0.0)) if single_std_zero else std).alias(f"{m}_std")]
    out = runs.groupBy(*by).agg(F.count("*").alias("n_runs"), *aggs)
    text = {
        f"{m}_text": F.format_string("%.4f +/- %.4f", f"{m}_mean", F.coalesce(f"{m}_std", F.lit(0.0))) for m in metrics
    }
    return out.withColumns(text)


# --- fixed values: tolerances for two scores to count as equal ---
TIE_ATOL = 1e-8
TIE_RTOL = 1e-7
# --- end of fixed values ---


def tie_audit(scores: DataFrame, group_keys: Sequence[str]) -> DataFrame:
    """Per group: are the same-pair scores, and all scores, equal to candidate 0's."""
    keys = list(group_keys)
    own = scores.filter("candidate_idx = 0").select(*keys, F.col("score").alias("_own"))
    joined = scores.join(own, keys)
    same_pair = F.col("candidate_idx").isin(*PAIR_FIXED_CANDIDATES)
    close = F.abs(F.col("score") - F.col("_own")) <= F.lit(TIE_ATOL) + F.lit(TIE_RTOL) * F.abs("_own")
    return joined.groupBy(*keys).agg(
        F.bool_and(~same_pair | (F.col("score") == F.col("_own"))).alias("same_pair_exact"),
        F.bool_and(~same_pair | close).alias("same_pair_close"),
        F.bool_and(close).alias("group_close"),
        (F.max("score") - F.min("score")).alias("spread"),
    )
