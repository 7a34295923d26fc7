"""SimHash fingerprints and their links at a few differing bits, by vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import materialize
from .components import components

BITS = 64
SHINGLE = 4
SEED = 42
WITHIN = 4  # differing bits of a link
SAMPLE = 1_024  # fingerprints among which vantage points are chosen
TRIED = 64  # of them tried for one level
SHARD_ROWS = 4_096  # fingerprints at home in one block of a shard
CELLS = 1 << 20  # distances computed together
COPY_COST = 500  # distances that take the time of moving one copy of a fingerprint
#: (trees, bits of a mask) to choose from
LAYOUTS = ((4, 4), (4, 2), (2, 4), (2, 2))


def fingerprint(text: str | None) -> int:
    """64 bits, each 1 where it is set in over half the XXH64 of the text's shingles."""
    words = (text or "").encode().lower().split()  # both act on ASCII alone, as the word class does
    if not words:
        return 0
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - SHINGLE + 1)
    starts, ends, digest = starts[:n].tolist(), ends[-n:].tolist(), xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CELLS):
        part = zip(starts[at : at + CELLS], ends[at : at + CELLS], strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in part), np.dtype("<u8"))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(read, "doc_id bigint, fp bigint")


@dataclass(frozen=True)
class Trees:
    """Vantage-point trees over disjoint groups of bits.

    Fingerprints that differ in at most ``within`` bits differ in at most ``within // trees`` bits of one
    group, the radius of its tree. A level of a tree has a mask of bits and a
    vantage point, and a branch is the Hamming distance to it over the mask.
    By the triangle inequality two fingerprints differ in at least as many bits of the mask as their branches lie
    apart, and masks are disjoint, so these bounds add up: a search leaves out
    every branch with which the sum would pass the radius. Leaves are shards.
    """

    trees: int
    width: int
    vantage: tuple[tuple[int, ...], ...]
    within: int = WITHIN

    @property
    def levels(self) -> int:
        return BITS // self.trees // self.width

    @property
    def radius(self) -> int:
        return self.within // self.trees

    def masks(self, tree: int) -> list[np.uint64]:
        bits = [tree + self.trees * i for i in range(BITS // self.trees)]
        return [np.uint64(sum(1 << b for b in bits[k : k + self.width])) for k in range(0, len(bits), self.width)]

    def branches(self, fps: np.ndarray, tree: int) -> np.ndarray:
        """Distance to each level's vantage point (fingerprints x levels)."""
        return np.stack([
            np.bitwise_count((fps ^ np.uint64(v)) & m) for m, v in zip(self.masks(tree), self.vantage[tree], strict=True)
        ], axis=1).astype(np.int64)

    def moves(self) -> list[tuple[int, ...]]:
        """Differences of branches that the radius allows, one of each two opposite ones."""
        out = []
        for changed in range(1, self.radius + 1):
            steps = [s for s in product(range(-self.radius, self.radius + 1), repeat=changed) if 0 not in s and sum(map(abs, s)) <= self.radius]
            for at in combinations(range(self.levels), changed):
                for s in steps:
                    move = [0] * self.levels
                    for k, d in zip(at, s, strict=True):
                        move[k] = d
                    if s[-1] > 0:  # the last level counts most in a shard's number
                        out.append(tuple(move))
        return out

    def shards(self, fps: np.ndarray, visits: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(fingerprints, shard of each, whether it is its home) for homes and for boundary shards of higher number.

        Of two fingerprints within the bound, in some tree either both are at home in one shard, or one visits the other's.
        """
        base = self.width + 1
        place = base ** np.arange(self.levels, dtype=np.int64)
        for tree in range(self.trees):
            branch = self.branches(fps, tree)
            home = branch @ place + tree * base**self.levels
            yield fps, home, True
            for move in self.moves() if visits else ():
                changed = [k for k, d in enumerate(move) if d]
                there = branch[:, changed] + np.array([move[k] for k in changed])
                held = ((there >= 0) & (there <= self.width)).all(axis=1)
                yield fps[held], home[held] + int(np.dot(move, place)), False


def layout_cost(n: int, trees: int, width: int) -> float:
    """Work of a layout for n fingerprints of even bits: copies that move, and distances that are computed."""
    levels, radius = BITS // trees // width, WITHIN // trees
    share = [comb(width, d) / 2**width for d in range(width + 1)]
    apart = [sum(share[a] * share[b] for a in range(width + 1) for b in range(width + 1) if abs(a - b) == d) for d in range(radius + 1)]
    reached = [sum(s for a, s in enumerate(share) for b in range(width + 1) if abs(a - b) == d) for d in range(radius + 1)]
    def total(one: list[float]) -> float:
        sums = [1.0] + [0.0] * radius
        for _ in range(levels):
            sums = [sum(sums[k - d] * one[d] for d in range(k + 1)) for k in range(radius + 1)]
        return sum(sums)

    return trees * (COPY_COST * n * (1 + total(reached)) / 2 + n * n / 2 * total(apart))


def plant(classes: DataFrame, n: int) -> Trees:
    """The cheapest layout for n fingerprints, its vantage points chosen for the widest spread over a bounded sample."""
    sample = [r["fp"] for r in classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    return trees_for(np.array(sample, np.int64).view(np.uint64), *min(LAYOUTS, key=lambda x: layout_cost(n, *x)))


def trees_for(sample: np.ndarray, trees: int, width: int) -> Trees:
    bare = Trees(trees, width, ())

    def spread(v: np.uint64, mask: np.uint64) -> float:
        share = np.bincount(np.bitwise_count((sample ^ v) & mask), minlength=width + 1) / len(sample)
        return float(-(share[share > 0] * np.log(share[share > 0])).sum())

    return Trees(trees, width, tuple(
        tuple(int(max(sample[:TRIED], key=lambda v: spread(v, m))) for m in bare.masks(t)) for t in range(trees)
    ))


class Shard:
    """Links inside one block of a shard: its homes among themselves, and visitors with homes.

    All links of a shard may be quadratic in number; kept are links enough to join what they join: each
    linked visitor to one home, and each home to the first of those it is joined with.
    """

    def __init__(self, homes: np.ndarray, within: int = WITHIN):
        self.homes, self.within = homes, within
        self.label = np.arange(len(homes))

    def _near(self, others: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        step = max(1, CELLS // max(1, len(self.homes)))
        for at in range(0, len(others), step):
            yield at, np.bitwise_count(others[at : at + step, None] ^ self.homes[None, :]) <= self.within

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            one, two = self.label[a], self.label[b]
            apart = one != two
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def own(self) -> None:
        for at, near in self._near(self.homes):
            i, j = np.nonzero(near)
            self._join(i + at, j)

    def visit(self, visitors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(visitor, home) links; homes that one visitor is linked to are joined."""
        left, right = [visitors[:0]], [visitors[:0]]
        for at, near in self._near(visitors):
            linked = near.any(axis=1)
            first = near.argmax(axis=1)
            left.append(visitors[at : at + len(near)][linked])
            right.append(self.homes[first[linked]])
            i, j = np.nonzero(near)
            self._join(first[i], j)
        return np.concatenate(left), np.concatenate(right)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        joined = self.label != np.arange(len(self.homes))
        return self.homes[joined], self.homes[self.label[joined]]


def dealt(classes: DataFrame, trees: Trees, rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, block, home, fp): homes of a large shard in blocks, all else of the shard copied to each.

    A home also visits the higher blocks of its shard, so every pair of a shard meets once.
    """
    def deal(visits: bool) -> DataFrame:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fps = batch.column(0).to_numpy().view(np.uint64)
                for some, shard, home in trees.shards(fps, visits):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard), pa.array(np.full(len(some), home)), pa.array(some.view(np.int64))], names=["shard", "home", "fp"])

        return classes.select("fp").mapInArrow(place, "shard bigint, home boolean, fp bigint")

    placed = deal(True)
    large = deal(False).groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > rows).select(
        F.col("shard").alias("_s"), F.ceil(F.col("n") / rows).cast("bigint").alias("blocks")
    )
    large = materialize(large, "large")
    blocks = F.coalesce("blocks", F.lit(1).cast("bigint"))
    own = F.pmod(F.xxhash64("fp"), blocks)
    first = F.when(F.col("home"), own).otherwise(F.lit(0).cast("bigint"))
    spread = placed.join(large, F.col("shard") == F.col("_s"), "left").select(
        "shard", "home", "fp", own.alias("own"), F.explode(F.sequence(first, blocks - 1)).alias("block")
    )
    return spread.select("shard", "block", (F.col("home") & (F.col("own") == F.col("block"))).alias("home"), "fp")


def near_links(classes: DataFrame, trees: Trees, rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b) between fingerprints (fp) within the bound; components of these links are those of all."""
    within = trees.within

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[int, int] | None = None
        homes: list[np.ndarray] = []
        shard: Shard | None = None
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def opened() -> Shard:
            made = Shard(np.concatenate(homes) if homes else np.empty(0, np.uint64), within)
            made.own()
            return made

        def closed() -> None:
            if key is not None:
                found.append((shard or opened()).links())

        def batch_of_links() -> pa.RecordBatch:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            shards, blocks, home, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fps = fps.view(np.uint64)
            new = np.ones(len(fps), bool)
            new[1:] = (shards[1:] != shards[:-1]) | (blocks[1:] != blocks[:-1]) | (home[1:] != home[:-1])
            cuts = np.append(np.flatnonzero(new), len(fps)).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                if (own := (int(shards[a]), int(blocks[a]))) != key:
                    closed()
                    key, homes, shard = own, [], None
                if home[a]:
                    homes.append(fps[a:b])
                else:
                    shard = shard or opened()
                    if len(shard.homes):
                        found.append(shard.visit(fps[a:b]))
            if found:
                yield batch_of_links()
                found = []
        closed()
        if found:
            yield batch_of_links()

    met = dealt(classes, trees, rows).repartition("shard", "block").sortWithinPartitions("shard", "block", F.desc("home"))
    return met.mapInArrow(meet, "a bigint, b bigint").distinct()


def simhash_components(docs: DataFrame, rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; shingles are four words, repeats counted (fewer words:
    the whole sequence; none, like null and empty texts: fingerprint zero). Fingerprints link at
    ``WITHIN`` or fewer differing bits, zero like any other; ``component_id`` is the smallest doc_id reachable.
    A null id has a fingerprint and a component, and names it only if no id does (then null). Rows of equal id
    are linked by their fingerprints alone.

    Equal fingerprints are one class, so copies cost one row. The trees deal classes to shards; one task
    compares one block of a shard's homes with what visits it and reports links enough to join them.
    """
    prints = materialize(fingerprints(docs), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    n = classes.count()
    if not n:
        return prints.select("doc_id", F.lit("").alias("fingerprint"), F.col("doc_id").alias("component_id"))
    labels = materialize(components(materialize(near_links(classes, plant(classes, n), rows), "links")), "labels")
    named = materialize(
        classes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("label")), "named"
    )
    lowest = named.groupBy(F.col("label").alias("_l")).agg(F.min("rep").alias("component_id"))
    named = named.join(lowest, F.col("label") == F.col("_l")).select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(named, F.col("fp") == F.col("_fp"), "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
