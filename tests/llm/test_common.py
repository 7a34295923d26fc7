"""The map of wanted keys, and counts of sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pathloom.llm import common, jaccard_join


def test_map_keeps_all_wanted_rows_and_few_others(spark):
    rows = spark.range(200_000).select((F.col("id") * 7 - 300_000).alias("k"), F.lit("wide").alias("text"))
    wanted = rows.filter("k % 100 = 0").select(F.col("k").alias("w"))
    kept = common.probably_in(rows, "k", wanted, "w")
    got = {r.k for r in kept.select("k").collect()}
    want = {r.w for r in wanted.collect()}
    assert want <= got and len(got) < len(want) + 20 and kept.columns == rows.columns
    assert common.probably_in(rows, "k", wanted.limit(0), "w").isEmpty()


def test_counts_never_rule_out_what_sets_share():
    draw = np.random.default_rng(12)
    ruled_out = 0
    for _ in range(300):
        n, m, k = (int(draw.integers(1, 6000)) for _ in range(3))
        common_part = draw.integers(0, 1 << 62, min(n, m, k)).astype(np.uint64)
        sets = [np.unique(np.concatenate([common_part, draw.integers(0, 1 << 62, x - len(common_part)).astype(np.uint64)])) for x in (n, m)]
        most, a, b = jaccard_join.most_shared(*(jaccard_join.set_counts(s) for s in sets))
        real = len(np.intersect1d(*sets))
        assert (a, b) == (len(sets[0]), len(sets[1])) and real <= most <= min(a, b)
        ruled_out += 100 * most < 80 * (a + b - most)
        assert 100 * real < 80 * (a + b - real) or 100 * most >= 80 * (a + b - most)
    assert ruled_out > 150
    assert jaccard_join.most_shared(jaccard_join.set_counts(np.empty(0, np.uint64)), jaccard_join.set_counts(np.empty(0, np.uint64))) == (0, 0, 0)
