"""Exact nearest vectors by angle, with groups around pivots that bounds rule out."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import materialize

BLOCK_ROWS = 8_192  # reference vectors in one block
CHUNK_ROWS = 16_384  # vectors of a house (blocks kept together) or of a chunk of queries
CHUNK_NUMBERS = 1 << 20  # numbers of these vectors at most, 8 MB
PARTITIONS = 64  # partitions of houses, and of chunks of queries; more where one would have many
CHUNKS_TOGETHER = 16  # houses or chunks of a partition at most
MOST_PIVOTS = 1_024
MOST_CELLS = 1 << 20  # numbers in the table of pivots
BINS = 1_024  # steps of the angle to a pivot
DIGITS = 12  # similarities that agree so far are equal
SLACK = 1e-6  # above the error of an angle computed from a cosine
CELLS = 1 << 18  # similarities computed together, so that they stay in the cache
SEVERAL = 1 << 13  # of these, as near as the best one, that are computed again one by one

ZERO_GROUP = -1  # group of zero vectors, whose similarity to any vector is 0


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


class Pivots:
    """A bounded sample of reference vectors; the driver and every task hold it."""

    def __init__(self, refs: DataFrame, n: int, dim: int):
        most = max(1, min(MOST_PIVOTS, MOST_CELLS // max(1, dim), int(n**0.5)))
        rows = refs.filter("not zero").select("row", "vec").orderBy(F.xxhash64("row"), "row").limit(most).collect()
        self.rows = np.array([r["row"] for r in rows], np.int64)
        self.vectors = np.array([r["vec"] for r in rows], float).reshape(len(rows), -1)

    def cosines(self, x: np.ndarray) -> np.ndarray:
        return x @ self.vectors.T


def place(refs: DataFrame, pivots: Pivots, block_rows: int) -> DataFrame:
    """(block, pivot, angle, row, key, vec): every reference vector in a block of bounded size.

    A group is what is nearest to a pivot. It is cut into shells by the angle to the
    pivot, along steps whose counts are summed first; a step with too many rows
    (copies of a vector, say) is dealt by hash to several blocks.
    """
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos = pivots.cosines(_matrix(batch.column(2)))
            at = cos.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at.astype(np.int32)), pa.array(_angle(cos[np.arange(len(at)), at]))],
                names=["row", "key", "vec", "pivot", "angle"])

    key = dict(refs.dtypes)["key"]
    near = refs.filter("not zero").select("row", "key", "vec").mapInArrow(
        group, f"row bigint, key {key}, vec array<double>, pivot int, angle double")
    near = materialize(near.withColumn("bin", F.floor(F.col("angle") * (BINS / 3.2)).cast("int")), "grouped")
    before = Window.partitionBy("pivot").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    # at most MOST_PIVOTS x BINS rows
    bins = near.groupBy("pivot", "bin").agg(F.count("*").alias("n")).select(
        F.col("pivot").alias("_p"), F.col("bin").alias("_b"),
        F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / block_rows).alias("shell"), F.ceil(F.col("n") / block_rows).alias("parts"),
    )
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("row"), F.col("parts")) + 1).otherwise(F.lit(0).cast("bigint"))
    number = F.shiftleft(F.col("pivot").cast("bigint"), 44).bitwiseOR(F.shiftleft("shell", 22)).bitwiseOR(part)
    placed = near.join(bins, (F.col("pivot") == F.col("_p")) & (F.col("bin") == F.col("_b")))
    return materialize(placed.select(number.alias("block"), "pivot", "angle", "row", "key", "vec"), "blocks")


def housed(placed: DataFrame, most: int) -> DataFrame:
    """The blocks in houses of about ``most`` vectors: ``packed`` rows."""
    sizes = placed.groupBy("block").agg(F.count("*").alias("n"))
    # as many rows as there are blocks
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    houses = materialize(sizes.select(
        F.col("block").alias("_b"), F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / most).alias("chunk")), "houses")
    n = houses.agg(F.count_distinct("chunk")).first()[0]
    return packed(placed.join(houses, F.col("block") == F.col("_b")).drop("_b"), n, ["block", "key"], "housed")


def bounded(queries: DataFrame, pivots: Pivots, itself: bool) -> DataFrame:
    """(row, vec, own, reach): the nearest pivot of a query, and the angle within which its nearest vector lies.

    ``queries`` has row, vec and best, the similarity seen so far or null. The pivots themselves are reference vectors and
    bound it too.
    """
    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            cos = pivots.cosines(_matrix(batch.column(1)))
            own = cos.argmax(axis=1)
            if itself:
                cos = np.where(rows[:, None] == pivots.rows[None, :], -1.0, cos)
            best = np.nan_to_num(batch.column(2).to_numpy(zero_copy_only=False).astype(float), nan=-1.0)
            reach = _angle(np.maximum(best, cos.max(axis=1))) + SLACK
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(own.astype(np.int32)), pa.array(reach)], names=["row", "vec", "own", "reach"])

    return queries.select("row", "vec", F.col("best").cast("double").alias("best")).mapInArrow(
        bounds, "row bigint, vec array<double>, own int, reach double")


_BYTES = {"vec": np.float64, "row": np.int64, "block": np.int64, "pivot": np.int32, "own": np.int32, "angle": np.float64, "reach": np.float64}


def packed(df: DataFrame, n: int, order: list[str], name: str) -> DataFrame:
    """One row per ``chunk`` of ``df``, its numbers as bytes and its keys as a list; written in ``n`` chunks, dealt evenly."""
    plain = [c for c in df.columns if c in _BYTES]
    keyed = "key" in df.columns
    schema = "chunk bigint, " + ", ".join(f"{c} binary" for c in plain) + (f", keys array<{dict(df.dtypes)['key']}>" if keyed else "")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(chunk: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            out = [pa.array([chunk], pa.int64())]
            for c in plain:
                column = pa.concat_arrays(whole[c].chunks)
                numbers = column.flatten() if c == "vec" else column
                out.append(pa.array([numbers.to_numpy(zero_copy_only=False).astype(_BYTES[c], copy=False).tobytes()], pa.binary()))
            if keyed:
                keys = pa.concat_arrays(whole["key"].chunks)
                out.append(pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys))
            return pa.RecordBatch.from_arrays(out, names=["chunk", *plain, *(["keys"] if keyed else [])])

        at, held = None, []
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a and chunk[a] != at:
                    if held:
                        yield one(at, held)
                    at, held = int(chunk[a]), []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield one(at, held)

    rows = df.select("chunk", *plain, *(["key"] if keyed else []))
    return materialize(rows.repartitionByRange(partitions_of(n), "chunk").sortWithinPartitions("chunk", *order).mapInArrow(pack, schema), name)


def partitions_of(n: int) -> int:
    """Partitions of ``n`` chunks."""
    return max(1, min(n, max(PARTITIONS, -(-n // CHUNKS_TOGETHER))))


def chunk_rows(n: int, dim: int) -> int:
    """Rows of a chunk of ``n`` vectors: at most what a task holds, and fewer so that there are several tasks."""
    return max(256, min(CHUNK_ROWS, CHUNK_NUMBERS // max(1, dim), max(4_096, n // 8)))


class House:
    """Blocks of reference vectors that a task holds together; inside a block they come in the order of keys."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, block: np.ndarray, pivot: np.ndarray, angle: np.ndarray, keys: pa.Array):
        self.rows, self.vectors, self.keys = rows, vectors, keys
        self.small = vectors.astype(np.float32)
        self.cuts = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
        self.pivot = pivot[self.cuts[:-1]]
        self.lo, self.hi = np.minimum.reduceat(angle, self.cuts[:-1]), np.maximum.reduceat(angle, self.cuts[:-1])
        order = pc.sort_indices(keys, null_placement="at_start").to_numpy()
        # equal keys have different ranks, which does no harm
        self.rank = np.empty(len(keys), np.int64)
        self.rank[order] = np.arange(len(keys))
        self.by_row = np.argsort(rows)

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Where each of ``rows`` stands, -1 if not here."""
        at = self.by_row[np.minimum(np.searchsorted(self.rows[self.by_row], rows), len(self.rows) - 1)]
        return np.where(self.rows[at] == rows, at, -1)

    def nearest(
        self, rows: np.ndarray, x: np.ndarray, own: np.ndarray, reach: np.ndarray, pivots: Pivots, itself: bool, nearest_only: bool
    ) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(best, place of the first that has it or -1, blocks visited, similarities computed) for some queries.

        A query visits the blocks whose shell reaches into its angles to the pivot: a vector within ``reach``
        has an angle to the pivot within that of the query's own. Similarities are computed
        with 32 bits, and again with 64 where that error leaves open whether they are the best.
        """
        error = np.float32((x.shape[1] + 4) * 2.0**-24 * 2)
        small = x.astype(np.float32)
        which, number = np.unique(self.pivot, return_inverse=True)
        angles = _angle(x @ pivots.vectors[which].T)
        best, at = np.full(len(x), -np.inf), np.full(len(x), -1)
        floor = (np.cos(np.minimum(reach, np.pi)) - error).astype(np.float32)
        mine = self.places(rows) if itself else np.full(len(x), -1)
        visits = pairs = 0

        def better(i: np.ndarray, place: np.ndarray, sims: np.ndarray) -> None:
            # of equal similarities the smallest key counts
            order = np.lexsort((self.rank[place], -sims, i))
            i, place, sims = i[order], place[order], sims[order]
            new = np.append(True, i[1:] != i[:-1])
            i, place, sims = i[new], place[new], sims[new]
            wins = (sims > best[i]) | ((sims == best[i]) & ((at[i] < 0) | (self.rank[place] < self.rank[at[i]])))
            best[i[wins]], at[i[wins]] = sims[wins], place[wins]
            floor[i] = np.maximum(floor[i], (best[i] - error).astype(np.float32))

        for b, (a, e) in enumerate(zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True)):
            angle = angles[:, number[b]]
            met = (angle - reach <= self.hi[b]) & (angle + reach >= self.lo[b])
            met &= (own == self.pivot[b]) if nearest_only else (own != self.pivot[b])
            who = np.flatnonzero(met)
            visits += len(who)
            pairs += len(who) * (e - a)
            step = max(1, CELLS // (e - a))
            for k in range(0, len(who), step):
                some = who[k : k + step]
                sims = small[some] @ self.small[a:e].T
                here = np.flatnonzero((mine[some] >= a) & (mine[some] < e))
                sims[here, mine[some][here] - a] = -2
                most = sims.max(axis=1)
                near = np.flatnonzero(most >= floor[some])
                if not len(near):
                    continue
                i, j = np.nonzero(sims[near] >= np.maximum(floor[some[near]], most[near] - error)[:, None])
                if len(i) <= SEVERAL:
                    i = some[near[i]]
                    better(i, a + j, np.round(np.einsum("ij,ij->i", x[i], self.vectors[a + j]), DIGITS))
                else:
                    full = np.round(x[some[near]] @ self.vectors[a:e].T, DIGITS)
                    full[sims[near] == -2] = -np.inf
                    j = full.argmax(axis=1)
                    better(some[near], a + j, full[np.arange(len(j)), j])
        return best, at, visits, pairs


def meet(queries: DataFrame, houses: DataFrame, pivots: Pivots, dim: int, key: str, itself: bool, nearest_only: bool, name: str) -> DataFrame:
    """(row, best, nearest) of what queries find in each house, and a row (visits, pairs) of each meeting.

    Every chunk of queries meets every house in some task; both are written tables of few large rows, so no vector is
    shuffled, however many blocks its query visits.
    """
    schema = f"row bigint, best double, nearest {key}, visits bigint, pairs bigint"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, House] | None = None
        for batch in batches:
            names = batch.schema.names
            for r in range(len(batch)):
                cell = {n: np.frombuffer(c.as_buffer(), _BYTES[n.removeprefix("q_")]) for n in names
                        if n.removeprefix("q_") in _BYTES for c in [batch.column(names.index(n))[r]]}
                number, keys = batch.column(names.index("chunk"))[r].as_py(), batch.column(names.index("keys"))[r].values
                if held is None or held[0] != number:
                    held = (number, House(cell["row"], cell["vec"].reshape(-1, dim), cell["block"], cell["pivot"], cell["angle"], keys))
                rows, x = cell["q_row"], cell["q_vec"].reshape(-1, dim)
                best, at, visits, pairs = held[1].nearest(rows, x, cell["q_own"], cell["q_reach"], pivots, itself, nearest_only)
                some = np.flatnonzero(at >= 0)
                null = pa.nulls(len(some), pa.int64())
                kind = held[1].keys.type
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([pa.array(rows[some]), pa.nulls(1, pa.int64())]), pa.concat_arrays([pa.array(best[some]), pa.nulls(1, pa.float64())]),
                     pa.concat_arrays([held[1].keys.take(pa.array(at[some])), pa.nulls(1, kind)]),
                     pa.concat_arrays([null, pa.array([visits])]), pa.concat_arrays([null, pa.array([pairs])])],
                    names=["row", "best", "nearest", "visits", "pairs"])

    asked = queries.select(*[F.col(c).alias(f"q_{c}") for c in ("row", "vec", "own", "reach")])
    # a pair of chunks is large, so few go to Python together
    with one_pair_a_batch(queries.sparkSession):
        return materialize(houses.crossJoin(asked).mapInArrow(compare, schema), name)


@contextmanager
def one_pair_a_batch(spark: SparkSession) -> Iterator[None]:
    """Pairs go to Python one by one, and partitions of chunks are read as they were written."""
    settings = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        # as much as any file, so that each is a partition
        "spark.sql.files.maxPartitionBytes": str(1 << 40), "spark.sql.files.openCostInBytes": str(1 << 40),
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _best_of(found: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("best")).alias("_less"), "nearest")).alias("_b")
    return found.groupBy("row").agg(best).select("row", (-F.col("_b._less")).alias("best"), F.col("_b.nearest").alias("nearest"))


def search(
    queries: DataFrame, refs: DataFrame | None, block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """((row, key, best, nearest), (visits, pairs) of each of two rounds) for unit vectors (key, vec).

    Zero vectors have similarity 0 to all. Chunks of queries meet houses of blocks in memory (``meet``). In two rounds a query visits blocks: first those of the pivot nearest to a query, as far as
    the pivots' own similarities allow anything as good there; then those of all other pivots, with the best
    similarity found by then as the bound. On the sphere
    angles obey the triangle inequality, so no block left out can hold a nearer vector.
    """
    def numbered(df: DataFrame, name: str) -> DataFrame:
        zero = ~F.exists("vec", lambda x: x != 0)
        return materialize(df.select(F.monotonically_increasing_id().alias("row"), "key", "vec", zero.alias("zero")), name)

    itself = refs is None
    asking = numbered(queries, "queries")
    refs = asking if itself else numbered(refs, "references")
    other = ~F.col("zero")
    seen = refs.agg(F.count_if(other).alias("n"), F.max(F.when(other, F.size("vec"))).alias("d"), F.count_if("zero").alias("zeros")).first()
    asking_zeros = seen["zeros"] if itself else asking.filter("zero").count()
    spark = queries.sparkSession
    key = dict(refs.dtypes)["key"]
    found = spark.createDataFrame([], f"row bigint, best double, nearest {key}")
    work = spark.createDataFrame([], "round int, visits bigint, pairs bigint")
    if seen["n"]:
        pivots = Pivots(refs, seen["n"], seen["d"])
        most = chunk_rows(seen["n"], seen["d"])
        houses = housed(place(refs, pivots, block_rows), most)
        plain = asking.filter("not zero").select("row", "vec")
        n = seen["n"] if itself else plain.count()
        chunks = max(1, -(-n // most))
        known = plain.withColumn("best", F.lit(None).cast("double"))
        for turn, nearest_only in enumerate((True, False)):
            asked = bounded(known, pivots, itself).withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
            met = meet(packed(asked, chunks, ["own"], "asked"), houses, pivots, seen["d"], key, itself, nearest_only, "met")
            work = work.unionByName(met.filter("visits is not null").agg(
                F.lit(turn).alias("round"), F.coalesce(F.sum("visits"), F.lit(0)).alias("visits"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")))
            some = _best_of(met.filter("visits is null").select("row", "best", "nearest"))
            if nearest_only:
                some = materialize(some, "best")
            found = found.unionByName(some)
            known = plain.join(some.select(F.col("row").alias("_r"), "best"), F.col("row") == F.col("_r"), "left").drop("_r")

    def lowest(of: DataFrame, k: int) -> list[tuple]:
        return [(r["key"], r["row"]) for r in of.select("key", "row").orderBy(F.asc_nulls_last("key"), "row").limit(k).collect()]

    # a zero vector is as near to all as any: its first other row; and the first zero vectors are near to all others
    def paired(of: DataFrame, firsts: list[tuple]) -> DataFrame:
        out = found.limit(0)
        for n, (name, row) in enumerate(firsts):
            wanted = of if not itself else of.filter(F.col("row") != row) if n == 0 else of.filter(F.col("row") == firsts[0][1])
            out = out.unionByName(wanted.select("row", F.lit(0.0).alias("best"), F.lit(name).cast(key).alias("nearest")))
        return out

    k = 2 if itself else 1
    if asking_zeros:
        found = found.unionByName(paired(asking.filter("zero"), lowest(refs, k)))
    if seen["zeros"]:
        found = found.unionByName(paired(asking.filter("not zero"), lowest(refs.filter("zero"), 1)))
    best = _best_of(found)
    return asking.select("row", "key").join(best.withColumnRenamed("row", "_r"), F.col("row") == F.col("_r")).select("row", "key", "best", "nearest"), work
