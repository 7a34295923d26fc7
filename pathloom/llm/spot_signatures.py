"""Document fingerprints from chains of content words after common words (SpotSigs)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import materialize
from .wordhash import Words, mix, run_hashes, slices_of, whole_hash

CHAIN = 3  # content words of a signature
ROWS_PER_BUCKET = 2_000
MOST_BUCKETS = 100_000

# Common words of English, German, French and Spanish that anchor signatures.
ANCHORS = (
    "a an and are as at be by can do for from had has have he her his in is it its not of on or said she that the "
    "their there they this to was we were which will with you "
    "aber als auch auf aus bei das dass dem den der des die ein eine einer es für ich im ist mit nicht sich sie sind "
    "so über um und uns von vor war wie wir zu zum "
    "au aux avec ce cette dans de du elle en est et il je la le les leur mais ne nous ont ou par pas pour qu que qui "
    "sa se ses son sur un une vous "
    "al como con del el ella era está esta este lo los las más muy no para pero por se si sin su sus también una y ya"
).split()

_anchors: dict[tuple[str, ...], np.ndarray] = {}


def _anchor_hashes(anchors: tuple[str, ...]) -> np.ndarray:
    if anchors not in _anchors:
        _anchors[anchors] = np.unique(Words(anchors, True, True).hashes)
    return _anchors[anchors]


def signature_sets(texts: list[str | None], anchors: tuple[str, ...] = tuple(ANCHORS), chain: int = CHAIN) -> list[np.ndarray]:
    """Distinct 32-bit signatures of each text, sorted.

    A signature is an anchor and the next ``chain`` words that are no anchors. A
    text without any gives one signature of all its words, one without words a
    signature of its bytes; null and empty texts give none.
    """
    common = _anchor_hashes(anchors)
    words = Words(texts, True, True)
    at = np.minimum(np.searchsorted(common, words.hashes), len(common) - 1)
    anchor = common[at] == words.hashes if len(common) else np.zeros(len(words.hashes), bool)
    content = np.flatnonzero(~anchor)
    chains = run_hashes(words.hashes[content], chain)
    spots = np.flatnonzero(anchor)
    follows = np.searchsorted(content, spots)
    owner = np.searchsorted(words.first, np.arange(len(words.hashes)), "right") - 1 if len(words.hashes) else content
    inside = follows + chain <= len(content)
    spots, follows = spots[inside], follows[inside]
    same = owner[content[follows + chain - 1]] == owner[spots] if len(spots) else np.zeros(0, bool)
    spots, follows = spots[same], follows[same]
    signs = (mix(chains[follows] ^ words.hashes[spots]) >> np.uint64(32)).astype(np.uint32)
    bounds = np.searchsorted(spots, words.first)
    out = []
    for i, text in enumerate(texts):
        a, b = words.first[i], words.first[i + 1]
        if bounds[i + 1] > bounds[i]:
            out.append(np.unique(signs[bounds[i] : bounds[i + 1]]))
        elif b > a:
            out.append(np.array([whole_hash(words.hashes[a:b]) >> np.uint64(32)], np.uint32))
        elif text:
            out.append(np.frombuffer(hashlib.sha256(text.encode()).digest()[:4], ">u4").astype(np.uint32))
        else:
            out.append(np.empty(0, np.uint32))
    return out


def as_text(signatures: np.ndarray) -> str:
    """Fingerprint: the sorted signatures, eight hexadecimal digits each."""
    return signatures.astype(">u4").tobytes().hex()


def length_partition(n: int, threshold: float) -> int:
    """Sets of partitions that differ by more than one cannot reach the threshold."""
    return -1 if n == 0 else int(np.floor(np.log(n) / -np.log(threshold) + 1e-9))


def pruned_jaccard(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets; 0 if their lengths alone keep it under the threshold.

    Two empty sets are alike (1), an empty and a filled one are not (0).
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    small, large = sorted((len(a), len(b)))
    if small < threshold * large or (threshold and abs(length_partition(small, threshold) - length_partition(large, threshold)) > 1):
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    like = shared / (len(a) + len(b) - shared)
    return like if like >= threshold else 0.0


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, next_text): the text of the next document by descending key; after the last, the first.

    Rows are cut into ranges of the key with near-equal counts, and each range
    also receives the first row of the next range, so neighbours meet in a window
    over one range and texts are shuffled once. Cut points (at most MOST_BUCKETS
    numbers) come from a quantile sketch over all keys; they decide where rows
    go, never which row is next. Equal keys are ordered by text, null keys come last.
    """
    keyed = docs.select(key, text, F.coalesce(F.col(key).cast("double"), F.lit(float("-inf"))).alias("_k"))
    n = docs.count()
    parts = max(1, min(MOST_BUCKETS, -(-n // ROWS_PER_BUCKET)))
    cuts = docs.select(F.col(key).cast("double").alias("_k")).approxQuantile(
        "_k", [i / parts for i in range(1, parts)], 1.0 / (4 * parts)) if parts > 1 and n else []
    marks = [float("-inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    bucket = Bucketizer(splits=marks, inputCol="_k", outputCol="_bucket", handleInvalid="error")
    ranged = bucket.transform(keyed)
    heads = bucket.transform(docs.select(F.coalesce(F.col(key).cast("double"), F.lit(float("-inf"))).alias("_k"))).groupBy(
        "_bucket").agg(F.max("_k").alias("_head"))
    up = Window.orderBy("_bucket")  # one row per range
    heads = heads.select(
        F.col("_bucket").alias("_own"), "_head",
        F.coalesce(F.lead("_bucket").over(up), F.min("_bucket").over(Window.partitionBy(F.lit(1)))).alias("_to"),
    )
    both = ranged.join(F.broadcast(heads), F.col("_bucket") == F.col("_own")).withColumn("_go", F.when(
        F.col("_k") == F.col("_head"),
        F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("c")), F.struct(F.col("_to").alias("b"), F.lit(True).alias("c"))),
    ).otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("c")))))
    dealt = both.select(key, text, F.explode("_go").alias("_g")).select(key, text, "_g.b", "_g.c")
    order = Window.partitionBy("b").orderBy("c", F.col(key).desc_nulls_last(), F.col(text).asc_nulls_first())
    return dealt.withColumn("next_text", F.lead(text).over(order)).filter(~F.col("c")).select(key, text, "next_text")


FINGERPRINTS = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and the likenesses asked for.

    Null text counts as empty; rows with equal ids are separate rows; a single
    document is its own next. Only ``doc_id`` and ``text`` are read.
    """
    names = [x.split()[0] for x in FINGERPRINTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            following = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in slices_of(texts):
                own = signature_sets(texts[a:b])
                edits = [edited_text(t, f) for t, f in zip(texts[a:b], following[a:b], strict=True)]
                edited = signature_sets(edits)
                # the next row's set is at hand unless the batch, slice or range ends here
                away = [i for i in range(a, b) if i + 1 >= b or following[i] != texts[i + 1]]
                extra = dict(zip(away, signature_sets([following[i] for i in away]), strict=True))
                rows = [
                    (ids[i], len(texts[i]), hashlib.sha256(e.encode()).hexdigest(), as_text(o), as_text(s),
                     pruned_jaccard(o, s), pruned_jaccard(o, extra[i] if i in extra else own[i - a + 1]))
                    for i, o, e, s in zip(range(a, b), own, edits, edited, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    paired = with_next(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    return paired.mapInArrow(fingerprints, FINGERPRINTS)


def signature_table(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, signs, n, part, items): the signature set of each row as bytes and list, its size and its partition by length."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices_of(texts):
                sets = signature_sets(texts[a:b])
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[a:b], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in sets], pa.binary()),
                    pa.array([len(x) for x in sets], pa.int32()), pa.array([length_partition(len(x), threshold) for x in sets], pa.int32()),
                    pa.array([x.tolist() for x in sets], pa.list_(pa.int64())),
                ], names=["doc_id", "signs", "n", "part", "items"])

    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return read.mapInArrow(sign, "doc_id bigint, signs binary, n int, part int, items array<bigint>")


def alike_documents(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, near_id, near): documents whose signature sets have a Jaccard likeness of ``threshold`` or more.

    Rows with equal sets are one class, named by its smallest id: every other row
    is paired with it (near = 1), and classes are paired by their names. So a
    group of copies gives as many pairs as members; near copies give all pairs.
    The index holds, by length partition and signature, the rarest signatures of
    each class, as many as two alike sets must share one of; a class meets those
    of its own partition and of the next, and pruned Jaccard decides. Null and
    empty texts are one class, rows with equal ids are separate rows, and rows
    with null ids are paired under null. The threshold lies between 0 and 1.
    """
    if not 0 < threshold < 1:
        raise ValueError(f"threshold {threshold} is not between 0 and 1")
    table = materialize(signature_table(docs, threshold), "signatures")
    classes = materialize(
        table.groupBy("signs").agg(F.min("doc_id").alias("name"), F.first("n").alias("n"), F.first("part").alias("part"), F.first("items").alias("items"))
        .withColumn("key", F.sha2("signs", 256)), "classes")
    items = classes.select("key", "n", "part", F.explode("items").alias("sign"))
    counts = items.groupBy("sign").agg(F.count("*").alias("_f"))
    rare = Window.partitionBy("key").orderBy("_f", "sign")
    index = materialize(
        items.join(counts, "sign").withColumn("_r", F.row_number().over(rare))
        .filter(F.col("_r") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)) + 1).select("key", "n", "part", "sign"), "index")
    probes = index.select(
        F.col("key").alias("a"), F.col("n").alias("_an"), F.col("part").alias("_ap"), "sign",
        F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("_to"),
    )
    held = index.select(F.col("key").alias("b"), F.col("n").alias("_bn"), F.col("part").alias("_to"), "sign")
    fits = F.least("_an", "_bn") >= F.lit(threshold) * F.greatest("_an", "_bn") - F.lit(1e-9)
    met = probes.join(held, ["_to", "sign"]).filter(fits & ((F.col("_ap") < F.col("_to")) | (F.col("a") < F.col("b")))).select("a", "b").distinct()
    one, two = (classes.select(F.col("key").alias(k), F.col("name").alias(f"_{k}_id"), F.col("signs").alias(f"_{k}_signs")) for k in "ab")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [pruned_jaccard(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), threshold)
                    for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.float64())], names=["x", "y", "near"])

    pairs = met.join(one, "a").join(two, "b").select("_a_id", "_b_id", "_a_signs", "_b_signs").mapInArrow(
        compare, "x bigint, y bigint, near double").filter("near > 0")
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    between = pairs.select(F.when(known, F.greatest("x", "y")).alias("doc_id"), F.least("x", "y").alias("near_id"), "near")
    # one row of each class stands for it: of equal smallest ids, all but one are copies
    named = table.join(classes.select("signs", "name"), "signs")
    first = F.col("doc_id").eqNullSafe(F.col("name"))
    extra = named.filter(first).groupBy("signs", "name").agg(F.count("*").alias("_n")).filter("_n > 1").select(
        F.col("name").alias("doc_id"), F.col("name").alias("near_id"), F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("_n")))).drop("col")
    copies = named.filter(~first).select("doc_id", F.col("name").alias("near_id")).unionByName(extra)
    return between.unionByName(copies.withColumn("near", F.lit(1.0)))
