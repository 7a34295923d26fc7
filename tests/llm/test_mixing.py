"""Mixing against earliest deadline first in plain Python, with few and with very many sources."""

from __future__ import annotations

from collections import Counter, defaultdict
from fractions import Fraction

import brute
import pytest
from pyspark.sql import functions as F

from pathloom.llm import mixing


def table(spark, sizes):
    """Documents of sources with the given sizes; the first has no name."""
    rows = [(name if i else None, n) for i, (name, n) in enumerate(sorted(sizes.items()))]
    listed = spark.createDataFrame(rows, "source string, n long")
    return listed.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n")))).select(
        F.monotonically_increasing_id().alias("doc_id"), "source")


def weights(spark, docs, frame):
    sizes = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    return {r.source: r for r in mixing.source_classes(sizes, frame=frame).collect()}


SIZES = {
    "few": {f"s{i}": 3 + 11 * i * i for i in range(12)},
    "equal": {f"s{i}": 40 for i in range(30)},
    "1000": {f"s{i}": 1 + (i * 7) % 5 for i in range(999)} | {"hot": 400},
    "1001": {f"s{i}": 1 + (i * 7) % 5 for i in range(1000)} | {"hot": 400},
    "20000": {f"s{i}": 1 + i % 3 for i in range(19_990)} | {f"t{i}": 60 + i for i in range(9)} | {"hot": 9000},
}


@pytest.mark.parametrize("name", SIZES)
def test_every_source_stays_within_a_block_of_its_weight(spark, name):
    docs = table(spark, SIZES[name])
    held = weights(spark, docs, mixing.FRAME)
    assert len(held) == len(SIZES[name]) and len({r["class"] for r in held.values()}) <= 76
    share = {s: Fraction(r.units, r.frame * r.members) for s, r in held.items()}
    assert sum(share.values()) == 1
    rows = mixing.mix_sources(docs, block_docs=1).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} and len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    order = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.slot):
        assert r.block == len(order[r.source]) and r.release <= r.slot < r.deadline
        order[r.source].append(r.slot)
    for s, slots in order.items():
        # the deviation is largest just before and just after a block of the source
        assert all(abs(n - share[s] * t) < 1 and abs(n + 1 - share[s] * (t + 1)) < 1 for n, t in enumerate(slots))
    sizes = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert max(len(slots) / sizes[s] for s, slots in order.items()) <= 2 * mixing.MOST_EPOCHS + 2


@pytest.mark.parametrize("name", ["few", "equal", "1001"])
def test_classes_run_by_earliest_deadline_and_members_take_turns(spark, name):
    docs = table(spark, SIZES[name])
    held = weights(spark, docs, 60)
    units = {r["class"]: r.units for r in held.values()}
    frame = sum(units.values())
    assert {r.frame for r in held.values()} == {frame}
    want = brute.edf(units, frame)
    members = defaultdict(list)
    for s, r in sorted(held.items(), key=lambda x: x[1].place):
        members[r["class"]].append(s)
    rows = sorted(mixing.mix_sources(docs, block_docs=1, frame=60).collect(), key=lambda r: r.slot)
    given = Counter()
    for r in rows:
        own = want[r.slot % frame]
        assert r.source == members[own][given[own] % len(members[own])]
        given[own] += 1


def test_weights_are_kept_at_every_number_of_sources(spark):
    """A source with 100 times the documents of another has about ten times its weight, among 20 sources and among 20,000.

    Weights are whole slots, one at least, so what is worth half a slot may get two.
    """
    for k in (20, 999, 1000, 20_000):
        sizes = {f"s{i}": 5 for i in range(k)} | {"large": 500}
        held = weights(spark, table(spark, sizes | {"a": 1}), mixing.FRAME)
        share = {s: r.units / r.frame / r.members for s, r in held.items()}
        assert 5 < share["large"] / share["s1"] < (20 if k <= 1000 else 50)


def test_no_task_holds_all_of_many_sources(spark):
    sizes = spark.range(5000).select(F.concat(F.lit("h"), "id").alias("source"), (F.col("id") + 1).alias("n_docs"))
    classes = mixing.source_classes(sizes).select("class", "units", "frame").distinct()
    assert classes.count() <= 76 and mixing.frame_schedule(classes).count() == mixing.FRAME
