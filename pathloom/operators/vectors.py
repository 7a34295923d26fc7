"""Embedding tables: similarity, whitening, pooling, look-ups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import cosine, l2_norm, safe_ratio, zeros
from ..lineage import materialize
from ..schema import DUMMY_PATHWAY, QUAD
from .checks import assert_empty
from .neighbors import BLOCK_ROWS, search
from .numbering import lower_median


def dim_violations(vectors: DataFrame, dim: int, vec: str = "vec") -> DataFrame:
    return vectors.filter(F.col(vec).isNull() | (F.size(vec) != dim))


def validate_dims(vectors: DataFrame, dim: int | None = None, vec: str = "vec") -> int:
    """The common vector length; raises on an empty table or a differing row."""
    seen = vectors.agg(F.min(F.size(vec)).alias("lo"), F.max(F.size(vec)).alias("hi")).first()
    if seen["lo"] is None:
        raise ValueError("the vector table is empty")
    expected = dim if dim is not None else seen["hi"]
    if (seen["lo"], seen["hi"]) != (expected, expected):
        assert_empty(dim_violations(vectors, expected, vec).select(F.size(vec).alias("size")), f"vectors not of length {expected}")
    return expected


def l2_normalize(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Unit vectors as ARRAY<DOUBLE>; a zero vector stays zero."""
    out = Normalizer(p=2.0, inputCol="_v", outputCol="_u").transform(
        vectors.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    )
    return out.withColumn(vec, vector_to_array("_u")).drop("_v", "_u")


def embedding_norms(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    return vectors.select(F.size(vec).alias("_d"), l2_norm(vec).alias("_n")).agg(
        F.count("*").alias("n_vectors"),
        F.max("_d").cast("bigint").alias("dim"),
        F.avg("_n").alias("norm_mean"),
        F.stddev_pop("_n").alias("norm_std"),
        F.min("_n").alias("norm_min"),
        F.max("_n").alias("norm_max"),
    )


def best_cosine(queries: DataFrame, others: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, best, nearest): the most similar other row of ``queries``, or row of ``others``.

    Exact, and not all pairs: vectors stand in blocks around pivots, and a query visits only blocks
    that can hold something as similar as the best it has seen (``neighbors``). Blocks have at most about ``block_rows``
    vectors. Keys keep their type, text ids included; similarities are rounded to 12
    digits, and of equal ones the smallest key counts. A zero vector has similarity 0 to all.
    """
    unit = l2_normalize(queries.select("key", "vec"))
    reference = None if others is None else l2_normalize(others.select("key", "vec"))
    return search(unit, reference, block_rows)[0].drop("row")


def cosine_work(queries: DataFrame, others: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(round, visits, pairs): blocks visited and similarities computed by ``best_cosine``."""
    unit = l2_normalize(queries.select("key", "vec"))
    return search(unit, None if others is None else l2_normalize(others.select("key", "vec")), block_rows)[1]


def cosine_stats(best: DataFrame) -> DataFrame:
    """Mean, population variance and deviation, range of each row's best cosine."""
    return best.agg(
        F.count("*").alias("n_rows"),
        F.avg("best").alias("mean"),
        F.var_pop("best").alias("variance"),
        F.stddev_pop("best").alias("std"),
        F.min("best").alias("min"),
        F.max("best").alias("max"),
    )


def max_cosine_stats(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return cosine_stats(best_cosine(vectors, block_rows=block_rows))


def nearest_train_summary(nearest: DataFrame, threshold: float, n_test: int | Column) -> DataFrame:
    """Mean, lower median and minimum best cosine; rows below the threshold.

    The ratio is over all test entities, with or without a vector.
    """
    total = F.lit(n_test) if isinstance(n_test, int) else n_test
    below = F.count_if(F.col("best") < threshold)
    return nearest.agg(
        F.count("*").alias("n_compared"), F.avg("best").alias("mean"), F.min("best").alias("min"), below.alias("n_below")
    ).select(
        "n_compared", "mean", lower_median(nearest, "best").scalar().alias("median"), "min", "n_below",
        safe_ratio(F.col("n_below"), total).alias("below_ratio"),
    )


def principal_axes(vectors: DataFrame, vec: str = "vec") -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(mean, variances, axes as columns, rows), variances descending with ddof 1.

    The covariance is summed by the executors; only its d x d matrix, bounded by
    the vector length, reaches the driver for the eigenvectors.
    """
    rows = vectors.select(array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"))
    summary = matrix.computeColumnSummaryStatistics()
    values, axes = np.linalg.eigh(matrix.computeCovariance().toArray())
    order = np.argsort(values)[::-1]
    return summary.mean(), np.maximum(values[order], 0.0), axes[:, order], int(summary.count())


def _project(vectors: DataFrame, vec: str, fn) -> DataFrame:
    @F.pandas_udf("array<double>")
    def apply(col: pd.Series) -> pd.Series:
        return pd.Series(list(fn(np.stack(col.to_numpy()).astype(float)))) if len(col) else col

    return vectors.withColumn(vec, apply(F.col(vec).cast("array<double>")))


def whitened(vectors: DataFrame, n_components: int, vec: str = "vec") -> DataFrame:
    """Centred rows along min(n_components, rows, length) principal axes, each of variance 1."""
    mean, variances, axes, rows = principal_axes(vectors, vec)
    n = min(n_components, rows, len(mean))
    scaled = axes[:, :n] / np.sqrt(np.maximum(variances[:n], np.finfo(float).eps))
    return _project(vectors, vec, lambda x: (x - mean) @ scaled)


def whiten(vectors: DataFrame, n_components: int, vec: str = "vec") -> DataFrame:
    """PCA-whitened unit vectors."""
    return l2_normalize(whitened(vectors, n_components, vec), vec)


def all_but_top(vectors: DataFrame, k: int, vec: str = "vec") -> DataFrame:
    """Centred unit vectors without their ``k`` leading principal directions."""
    mean, _, axes, rows = principal_axes(vectors, vec)
    top = axes[:, : min(k, rows, len(mean))]
    return l2_normalize(_project(vectors, vec, lambda x: (x - mean) - (x - mean) @ top @ top.T), vec)


# --- fixed values: wanted range and centre of the mean best cosine ---
COSINE_RANGE = (0.4, 0.6)
COSINE_GOAL = 0.5
# --- end of fixed values ---


def choose_k(results: DataFrame) -> DataFrame:
    """Of (k, mean): a mean inside the range first, then nearest the goal, then smaller k."""
    inside = F.col("mean").between(*COSINE_RANGE)
    return results.orderBy(F.desc(inside), F.abs(F.col("mean") - F.lit(COSINE_GOAL)), "k").limit(1)


def _as_vector(vec: str) -> Column:
    return array_to_vector(F.col(vec).cast("array<double>"))


def pool_tokens(tokens: DataFrame, mode: str, dim: int) -> DataFrame:
    """One vector per key from (key, pos, mask, vec): the first token or the masked mean."""
    if mode == "cls":
        return tokens.filter("pos = 0").select("key", F.col("vec").cast("array<double>").alias("vec"))
    if mode != "mean":
        raise ValueError(f"unknown token pooling: {mode}")
    weighted = tokens.withColumn("_v", _as_vector("vec")).withColumn("_w", F.col("mask").cast("double"))
    pooled = weighted.filter("_w > 0").groupBy("key").agg(Summarizer.mean(F.col("_v"), F.col("_w")).alias("_m"))
    return _zero_filled(tokens.select("key").distinct(), pooled, ["key"], dim)


def _zero_filled(keys: DataFrame, pooled: DataFrame, on: Sequence[str], dim: int) -> DataFrame:
    arrays = pooled.select(*on, vector_to_array("_m").alias("_a"))
    filled = F.coalesce("_a", zeros(dim).cast("array<double>"))
    return keys.join(arrays, list(on), "left").select(*on, filled.alias("vec"))


def pool_paths(pairs: DataFrame, path_vectors: DataFrame, mode: str, dim: int) -> DataFrame:
    """One vector per pair from its path vectors; zeros for a pair without paths.

    ``mode``: mean, max, or attention, a softmax over the given ``score`` column.
    All three are sums or maxima that combine before the shuffle.
    """
    on = ["drug", "disease"]
    rows = path_vectors.withColumn("_v", _as_vector("vec"))
    if mode == "mean":
        pooled = rows.groupBy(*on).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    elif mode == "max":
        pooled = rows.groupBy(*on).agg(Summarizer.max(F.col("_v")).alias("_m"))
    elif mode == "attention":
        peak = path_vectors.groupBy(*on).agg(F.max("score").alias("_s"))
        weighted = rows.join(peak, on).withColumn("_w", F.exp(F.col("score") - F.col("_s")))
        pooled = weighted.groupBy(*on).agg(Summarizer.mean(F.col("_v"), F.col("_w")).alias("_m"))
    else:
        raise ValueError(f"unknown path pooling: {mode}")
    return _zero_filled(pairs.select(*on).distinct(), pooled, on, dim)


# Edges into one node that one task adds up, edges of a task, and numbers of a vector table that every task gets.
EDGES_PER_TASK = 100_000
EDGES_TOGETHER = 500_000
NUMBERS_SENT = 1 << 24


def neighbor_aggregate(
    edges: DataFrame, vectors: DataFrame, weight: Column | None = None, edges_per_task: int = EDGES_PER_TASK
) -> DataFrame:
    """(key, vec): one propagation step along edge direction.

    Per relation, the weighted sum of source vectors over max(weight sum, 1);
    relations are then added up. ``vectors`` is (key, vec) by global id. Weight sums
    are found from numbers alone, which makes the step one sum per node: edges are dealt by node, and a vector
    table of at most ``NUMBERS_SENT`` numbers is sent to them; of a larger one a vector moves once an edge, as it is stored. A node with more than ``edges_per_task`` edges is added up by several tasks.
    """
    w = (weight if weight is not None else F.lit(1.0)).cast("double")
    kind = ["dst_id", "src_type", "rel", "dst_type"]
    links = edges.select("src_id", *kind, w.alias("_w"))
    sources = vectors.select(F.col("key").alias("src_id"), F.col("vec").alias("_v"))
    sums = links.join(sources.select("src_id"), "src_id").groupBy(*kind).agg(F.sum("_w").alias("_s"), F.count("*").alias("_n"))
    sums = materialize(sums.select(*[F.col(c).alias(f"_{c}") for c in kind], "_s", "_n"), "weights")
    many = sums.groupBy("_dst_id").agg(F.sum("_n").alias("_n")).filter(F.col("_n") > edges_per_task)
    # at most (number of edges) / edges_per_task nodes
    many = materialize(many.select(F.col("_dst_id").alias("dst_id"), F.ceil(F.col("_n") / edges_per_task).alias("_parts")), "many")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in kind])
    shares = links.join(sums, same).select("src_id", "dst_id", (F.col("_w") / F.greatest("_s", F.lit(1.0))).alias("_f"))

    tasks = -(-(sums.agg(F.sum("_n")).first()[0] or 0) // EDGES_TOGETHER) or 1
    sent = (vectors.agg(F.sum(F.size("vec").cast("bigint"))).first()[0] or 0) <= NUMBERS_SENT

    def added(rows: DataFrame, keys: list[str]) -> DataFrame:
        if sent:
            moved = rows.repartition(tasks, *keys).join(F.broadcast(sources), "src_id").select(*keys, "_f", "_v")
        else:
            moved = rows.join(sources, "src_id").select(*keys, "_f", "_v").repartition(tasks, *keys)
        mean = Summarizer.mean(_as_vector("_v"), F.col("_f")).alias("_m")
        total = moved.groupBy(*keys).agg(mean, F.sum("_f").alias("_s"))
        return total.select(F.col("dst_id").alias("key"), F.transform(vector_to_array("_m"), lambda x: x * F.col("_s")).alias("vec"))

    if many.isEmpty():
        return added(shares, ["dst_id"])
    few = added(shares.join(F.broadcast(many), "dst_id", "left_anti"), ["dst_id"])
    dealt = shares.join(F.broadcast(many), "dst_id").withColumn("_part", F.pmod(F.xxhash64("src_id"), F.col("_parts")))
    parts = added(dealt, ["dst_id", "_part"]).groupBy("key").agg(
        Summarizer.mean(array_to_vector("vec")).alias("_m"), F.count("*").cast("double").alias("_n")
    )
    return few.unionByName(parts.select("key", F.transform(vector_to_array("_m"), lambda x: x * F.col("_n")).alias("vec")))


def lookup_features(ids: DataFrame, features: DataFrame, dim: int, key: str = "key") -> DataFrame:
    """Vector of every id with an availability flag; zeros where there is none."""
    joined = ids.join(features.select(key, F.col("vec").alias("_v")), key, "left")
    return joined.select(
        *ids.columns,
        F.coalesce("_v", zeros(dim)).alias("vec"),
        F.col("_v").isNotNull().alias("available"),
    )


def override_features(base: DataFrame, external: DataFrame, key: str = "key") -> DataFrame:
    """Base vectors with those of ``external`` in their place where it has the key."""
    joined = base.join(external.select(key, F.col("vec").alias("_e")), key, "left")
    return joined.select(key, F.coalesce("_e", "vec").alias("vec"), F.col("_e").isNotNull().alias("overridden"))


def lookup_triplet_vectors(paths: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Vector of each path's (drug, disease, gene), zeros and ``hit=false`` on a miss."""
    keys = ["drug", "disease", "gene"]
    joined = paths.join(vectors.select(*keys, F.col("vec").alias("_v")), keys, "left")
    return joined.select(
        *paths.columns, F.coalesce("_v", zeros(dim)).alias("vec"), F.col("_v").isNotNull().alias("hit")
    )


def distill_metric(predictions: DataFrame, teacher: DataFrame, mode: str, dim: int) -> DataFrame:
    """1 - mean cosine, or mean squared error, over the keys the teacher has; 0 for none."""
    hits = lookup_triplet_vectors(
        predictions.withColumnRenamed("vec", "pred"), teacher, dim
    ).filter("hit")
    if mode == "cosine":
        value = 1.0 - F.avg(cosine("pred", "vec"))
    elif mode == "mse":
        gaps = F.zip_with("pred", "vec", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
        value = F.avg(F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v) / F.size("pred"))
    else:
        raise ValueError(f"unknown distillation metric: {mode}")
    return hits.agg(F.count("*").alias("n_hits"), F.coalesce(value, F.lit(0.0)).alias("value"))


def concat_path_vectors(paths: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """The component vectors of each path end to end.

    A dummy pathway contributes zeros; an all-zero (absent) path is all zeros.
    """
    columns = [c for c in QUAD if c in paths.columns]
    out = paths
    for c in columns:
        side = vectors.select(F.col("key").alias(c), F.col("vec").alias(f"_{c}"))
        out = out.join(side, c, "left")
    absent = F.lit(True)
    for c in columns:
        absent = absent & (F.col(c) == 0)
    parts = []
    for c in columns:
        blank = absent | (F.col(c) == DUMMY_PATHWAY) if c == "pathway" else absent
        parts.append(F.when(blank, zeros(dim)).otherwise(F.coalesce(f"_{c}", zeros(dim))))
    return out.select(*paths.columns, F.concat(*parts).alias("vec"))
