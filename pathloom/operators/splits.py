"""Exact, seed-stable splits without sorting or shuffling the rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import HASH_DIGITS, key_hash
from ..schema import SPLITS

_TOP_BITS = 12
_FINAL_ROWS = 20_000


def largest_remainder(total: int, fractions: Mapping[str, float]) -> dict[str, int]:
    """Whole sizes that add up to ``total``.

    Each name gets the whole part of its quota, and one more if its place in the
    order of remainders (ties: larger fraction, then earlier name) lies below what is left.
    """
    if total < 0 or min(fractions.values(), default=0) < 0 or not math.isclose(sum(fractions.values()), 1.0, abs_tol=1e-8):
        raise ValueError(f"need a total of at least 0 and fractions of 0 to 1 that sum to 1: {total}, {dict(fractions)}")
    quota = {name: math.modf(total * share) for name, share in fractions.items()}  # (remainder, whole part)
    left = total - sum(int(whole) for _, whole in quota.values())

    def place(name: str) -> int:
        rank = lambda n: (quota[n][0], fractions[n])
        names = list(fractions)
        return sum(rank(n) > rank(name) or (rank(n) == rank(name) and names.index(n) < names.index(name)) for n in names)

    return {name: int(whole) + (place(name) < left) for name, (_, whole) in quota.items()}


def truncated_sizes(total: int, train_ratio: float = 0.7, valid_ratio: float = 0.15) -> dict[str, int]:
    if not 0 < train_ratio < 1 or not 0 < valid_ratio < 1 or train_ratio + valid_ratio >= 1:
        raise ValueError(f"ratios must lie in (0, 1) and leave a test share: {train_ratio}, {valid_ratio}")
    train, valid = int(total * train_ratio), int(total * valid_ratio)
    return {"train": train, "valid": valid, "test": total - train - valid}


def _rows_at(df: DataFrame, keys: Sequence[str], seed: int, positions: Sequence[int]) -> dict[int, tuple]:
    """Rows (hash, keys...) at 0-based ranks in (hash, keys) order, by radix selection.

    Every pass returns at most 4096 counts per wanted rank to the driver; rows
    are fetched only once a hash prefix holds few of them.
    """
    hashed = df.select(key_hash(seed, *keys).alias("_h"), *keys)
    total_bits = 4 * HASH_DIGITS
    found: dict[int, tuple] = {}
    pending = {p: (0, p, 0) for p in positions}  # rank -> (prefix, rank inside it, prefix bits)
    while pending:
        bits = next(iter(pending.values()))[2]
        prefixes = sorted({prefix for prefix, _, _ in pending.values()})
        inside = hashed.filter(F.shiftright("_h", total_bits - bits).isin(prefixes)) if bits else hashed
        digit = F.shiftright("_h", total_bits - bits - _TOP_BITS)
        counts = {r["d"]: r["n"] for r in inside.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()}
        small: dict[int, list[tuple[int, int]]] = {}
        deeper = {}
        for rank, (prefix, offset, _) in pending.items():
            for d in sorted(x for x in counts if x >> _TOP_BITS == prefix or not bits):
                if offset < counts[d]:
                    last = bits + 2 * _TOP_BITS > total_bits
                    if counts[d] <= _FINAL_ROWS or last:
                        small.setdefault(d, []).append((rank, offset))
                    else:
                        deeper[rank] = (d, offset, bits + _TOP_BITS)
                    break
                offset -= counts[d]
        for d, wanted in small.items():
            head = inside.filter(digit == d).orderBy("_h", *keys).limit(max(o for _, o in wanted) + 1).collect()
            found.update({rank: tuple(head[o]) for rank, o in wanted})
        pending = deeper
    return found


def cut_column(df: DataFrame, keys: Sequence[str], sizes: Mapping[str, int], seed: int) -> Column:
    """Split label of a row: rows in (hash, keys) order are dealt out by ``sizes``.

    The label compares a row with at most three boundary rows, so assigning it
    moves no data. ``keys`` must identify the rows of ``df``.
    """
    total = sum(sizes.values())
    ends, at = [], 0
    for name, size in sizes.items():
        at += size
        ends.append((name, at))
    inner = sorted({end for _, end in ends if 0 < end < total})
    bounds = _rows_at(df, keys, seed, inner) if inner else {}
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    row = F.struct(key_hash(seed, *keys).alias("_h"), *[F.col(k) for k in keys])

    def before(bound: tuple) -> Column:
        lits = [F.lit(bound[0]).cast("bigint").alias("_h")]
        lits += [F.lit(v).cast(dtypes[k]).alias(k) for k, v in zip(keys, bound[1:], strict=True)]
        return row < F.struct(*lits)

    label = F.lit(None).cast("string")
    for name, end in reversed(ends):
        if end >= total:
            label = F.when(F.lit(end > 0), F.lit(name)) if sizes[name] else label
        elif end > 0:
            label = F.when(before(bounds[end]), F.lit(name)).otherwise(label)
    return label


def split_random(pairs: DataFrame, fractions: Mapping[str, float], seed: int) -> DataFrame:
    """Pairs dealt into splits of exact largest-remainder sizes."""
    sizes = largest_remainder(pairs.count(), {s: fractions.get(s, 0.0) for s in SPLITS})
    return pairs.withColumn("split", cut_column(pairs, ["drug", "disease"], sizes, seed))


def split_by_entity(pairs: DataFrame, entity: str, fractions: Mapping[str, float], seed: int) -> DataFrame:
    """Whole entities dealt into splits; a pair follows its drug or its disease."""
    if entity not in ("drug", "disease"):
        raise ValueError(f"entity must be 'drug' or 'disease': {entity}")
    entities = pairs.select(entity).distinct()
    sizes = largest_remainder(entities.count(), {s: fractions.get(s, 0.0) for s in SPLITS})
    return pairs.withColumn("split", cut_column(entities, [entity], sizes, seed))


def make_split(pairs: DataFrame, mode: str, fractions: Mapping[str, float], seed: int) -> DataFrame:
    if mode == "random":
        return split_random(pairs, fractions, seed)
    if mode in ("cross_drug", "cross_disease"):
        return split_by_entity(pairs, mode.removeprefix("cross_"), fractions, seed)
    raise ValueError(f"unknown split mode: {mode}")


def entity_splits(splits: DataFrame, entity: str) -> DataFrame:
    return splits.select("split", F.col(entity).alias("entity")).distinct()


def split_triplets(
    triplets: DataFrame, train_ratio: float = 0.7, valid_ratio: float = 0.15, seed: int = 0
) -> DataFrame:
    keys = [c for c in ("drug", "gene", "pathway", "disease") if c in triplets.columns]
    sizes = truncated_sizes(triplets.count(), train_ratio, valid_ratio)
    return triplets.withColumn("split", cut_column(triplets, keys, sizes, seed))


def negative_pools(mode: str, splits: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(drug pool, disease pool) allowed for training negatives; None is unrestricted."""
    train = splits.filter("split = 'train'")
    drugs = train.select("drug").distinct() if mode == "cross_drug" else None
    diseases = train.select("disease").distinct() if mode == "cross_disease" else None
    return drugs, diseases


def disjoint_violations(splits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur in more than one split."""
    return splits.groupBy(*keys).agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def split_summary(triplets: DataFrame) -> DataFrame:
    return triplets.groupBy("split").agg(
        F.count("*").alias("n_triplets"), F.count_distinct("drug", "disease").alias("n_pairs")
    )


def sample_k(df: DataFrame, keys: Sequence[str], k: int, seed: int) -> DataFrame:
    """Seeded uniform sample of ``k`` rows, those first in (hash, keys) order; ``keys`` must identify the rows.

    The last row of the sample is found by radix selection, so none is moved or sorted.
    """
    n = df.count()
    if k >= n:
        return df
    if k <= 0:
        return df.limit(0)
    return df.filter(cut_column(df, keys, {"in": k, "out": n - k}, seed) == "in")
