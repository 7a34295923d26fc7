"""N-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import materialize
from .common import probably_in
from .components import components
from .wordhash import Words, mix, shingle_sets, slices_of

SHINGLE = 5
#: similarity as a fraction of integers, so that comparisons are exact
OVER, UNDER = 80, 100
CHUNK_TOKENS = 1 << 20  # tokens among which repeats are counted together
HOT_TOKENS = 200_000  # most tokens whose frequency every task knows, 3.2 MB
HOT_LEAST = 8
MOST_EXTRA = 2  # a prefix is lengthened by this many tokens at most
SPREAD = 64  # parts that the rows of one frequent token are dealt to
LEAST_BUCKETS = 256  # in which the tokens of a set are counted

_SETS = "doc_id bigint, n bigint, d1 bigint, d2 bigint, token bigint, hits bigint"
_INDEX = "token bigint, d1 bigint, n int, pos int, ell int, hot boolean"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def set_digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes: equal sets, equal digests."""
    one = np.bitwise_xor.reduce(mix(tokens ^ np.uint64(0x1234567))) if len(tokens) else np.uint64(0)
    two = np.add.reduce(mix(tokens * np.uint64(3) + np.uint64(1))) if len(tokens) else np.uint64(0)
    both = _signed(mix(np.array([one, two ^ np.uint64(len(tokens))], np.uint64)))
    return int(both[0]), int(both[1])


def document_sets(docs: DataFrame) -> DataFrame:
    """One table of two kinds of rows: documents (doc_id, n, d1, d2) and frequent tokens (token, hits).

    Tokens are counted among the distinct sets of a chunk, and those met at least
    twice are reported. Every token that occurs in more sets than there are chunks is reported.
    """
    names = [x.split()[0] for x in _SETS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def frequent() -> pa.RecordBatch:
            tokens, hits = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            twice = hits >= 2
            empty = pa.nulls(int(twice.sum()), pa.int64())
            return pa.RecordBatch.from_arrays(
                [empty, empty, empty, empty, pa.array(_signed(tokens[twice])), pa.array(hits[twice].astype(np.int64))], names=names)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices_of(texts):
                rows = []
                for doc_id, tokens in zip(ids[a:b], shingle_sets(Words(texts[a:b], True), SHINGLE), strict=True):
                    d1, d2 = set_digest(tokens)
                    rows.append((doc_id, len(tokens), d1, d2))
                    if (d1, d2) not in seen:
                        seen.add((d1, d2))
                        held.append(tokens)
                        size += len(tokens)
                    if size >= CHUNK_TOKENS:
                        yield frequent()
                        held, size, seen = [], 0, set()
                empty = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), empty, empty], names=names)
        if held:
            yield frequent()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(read, _SETS)


def hot_tokens(rows: DataFrame, most: int = HOT_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, counts) of the most frequent tokens, sorted by token; at most ``most``.

    The least count that qualifies comes from a table of counts, so that no task
    sorts the tokens. Which tokens qualify changes the work, not the result.
    """
    counts = materialize(
        rows.filter("token is not null").groupBy("token").agg(F.sum("hits").alias("hits")).filter(F.col("hits") >= HOT_LEAST), "hot"
    )
    level = F.least(F.col("hits"), F.lit(1_000_000))
    sizes = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = HOT_LEAST, 0
    for hits, n in sizes:
        total += n
        if total > most:
            least = hits + 1
            break
    held = counts.filter(F.col("hits") >= least).toPandas()
    order = np.argsort(held["token"].to_numpy().view(np.uint64)) if len(held) else np.empty(0, np.int64)
    return held["token"].to_numpy(np.int64).view(np.uint64)[order], held["hits"].to_numpy(np.int64)[order]


def least_overlap(n: int) -> int:
    """Tokens that a set of n shares at least with any set it is linked to."""
    return -(-OVER * n // UNDER)


def prefix_rows(tokens: np.ndarray, hot: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """(prefix tokens in order, ell, their counts): rare tokens first, then frequent ones by count.

    The estimated candidate cost of a set is the sum of the known counts in its
    plain prefix. The costlier, the longer the prefix: with ell - 1 tokens more,
    any linked pair shares at least min(ell, ell') tokens of both prefixes.
    """
    if len(hot):
        at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        count = np.where(hot[at] == tokens, counts[at], 0)
    else:
        count = np.zeros(len(tokens), np.int64)
    order = np.lexsort((tokens, count))
    need = least_overlap(len(tokens))
    plain = len(tokens) - need + 1
    cost = int(count[order[:plain]].sum())
    ell = min(1 + min(MOST_EXTRA, int(np.log2(1 + cost)) // 4), need)
    chosen = order[: plain + ell - 1]
    return tokens[chosen], ell, count[chosen]


def prefix_index(docs: DataFrame, hot: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(token, d1, n, pos, ell, hot) for the prefix tokens of every set; a task reports equal sets once."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, counts))
    names = [x.split()[0] for x in _INDEX.split(", ")]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, counts = shared.value
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices_of(texts):
                columns: list[list[np.ndarray]] = [[] for _ in names]
                for tokens in shingle_sets(Words(texts[a:b], True), SHINGLE):
                    d1, d2 = set_digest(tokens)
                    if not len(tokens) or (d1, d2) in seen:
                        continue
                    seen.add((d1, d2))
                    prefix, ell, count = prefix_rows(tokens, hot, counts)
                    k = len(prefix)
                    row = (_signed(prefix), np.full(k, d1), np.full(k, len(tokens), np.int32), np.arange(k, dtype=np.int32),
                           np.full(k, ell, np.int32), count > 0)
                    for column, values in zip(columns, row, strict=True):
                        column.append(values)
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=names)

    return docs.select("text").mapInArrow(index, _INDEX)


def largest_partner() -> Column:
    """Largest set that a row's set can be linked to if this token is among the first ell they share.

    At most ell - 1 + n - pos tokens are then shared, and a link needs
    OVER / (OVER + UNDER) of both sizes together.
    """
    shared = F.col("n") - F.col("pos") + F.col("ell") - 1
    return F.floor(shared * (OVER + UNDER) / OVER).cast("int") - F.col("n")


def _useful(rows: DataFrame) -> DataFrame:
    """Keep rows with a possible partner in their token's group, which has columns lo and reach."""
    return rows.filter((F.col("partner") >= F.col("lo")) & (F.col("reach") >= F.col("n")))


def shared_index(index: DataFrame) -> DataFrame:
    """Index rows that can belong to a link: their token is in two sets at least, and sizes allow it.

    Rows of rare tokens meet in one shuffle. Rows of frequent tokens are dealt
    to SPREAD parts and kept; their groups are judged by combined counts.
    """
    part = F.when(F.col("hot"), F.pmod("d1", F.lit(SPREAD)).cast("int")).otherwise(0)
    rows = index.withColumn("part", part).repartition("token", "part").withColumn("partner", largest_partner())
    group = Window.partitionBy("token", "part")
    first = F.row_number().over(Window.partitionBy("token", "part", "d1").orderBy("n"))
    sides = {"least": F.min("d1").over(group), "most": F.max("d1").over(group), "lo": F.min("n").over(group), "reach": F.max("partner").over(group)}
    kept = rows.withColumns(sides).filter(F.col("hot") | (F.col("least") != F.col("most"))).withColumn("again", first).filter("again = 1")
    kept = materialize(kept.select(*_columns(), "hot", "partner", "lo", "reach"), "index")
    rare = _useful(kept.filter(~F.col("hot"))).select(*_columns(), "partner")
    hot = kept.filter("hot").drop("lo", "reach")
    stats = hot.groupBy(F.col("token").alias("_t")).agg(
        F.min("d1").alias("least"), F.max("d1").alias("most"), F.min("n").alias("lo"), F.max("partner").alias("reach")
    ).filter(F.col("least") != F.col("most"))
    return rare.unionByName(_useful(hot.join(stats, F.col("token") == F.col("_t"))).select(*_columns(), "partner"))


def _columns() -> list[str]:
    return ["token", "d1", "n", "pos", "ell"]


def _pairs(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """(a, b) from rows l and r that meet in a token, with at least min(ell, ell') tokens shared."""
    fits = (F.col("l.partner") >= F.col("r.n")) & (F.col("r.partner") >= F.col("l.n"))
    met = left.alias("l").join(right.alias("r"), (F.col("l.token") == F.col("r.token")) & condition & fits)
    return met.groupBy(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b")).agg(
        F.count("*").alias("shared"), F.min(F.least("l.ell", "r.ell")).alias("needed")
    ).filter(F.col("shared") >= F.col("needed")).select("a", "b")


def set_counts(tokens: np.ndarray) -> bytes | None:
    """How many tokens of a set fall into each of a power of two of buckets, about eight to one; None if one holds over 255."""
    size = LEAST_BUCKETS
    while 8 * size < len(tokens):
        size *= 2
    counts = np.bincount((mix(tokens ^ np.uint64(0x5BD1E995)) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else None


def most_shared(one: bytes, two: bytes) -> tuple[int, int, int]:
    """(largest possible intersection, sizes) of two sets by their counts: no bucket shares more than its smaller count."""
    a, b = (np.frombuffer(x, np.uint8).astype(np.int64) for x in (one, two))
    while len(a) > len(b):
        a = a.reshape(2, -1).sum(axis=0)
    while len(b) > len(a):
        b = b.reshape(2, -1).sum(axis=0)
    return int(np.minimum(a, b).sum()), int(a.sum()), int(b.sum())


def possible(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) that may reach the similarity by the counts of their sets; none that does is dropped.

    Counts move in about a tenth of the bytes of texts, and sets that share a passage and no more are told apart by them.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices_of(texts):
                made = [set_counts(s) for s in shingle_sets(Words(texts[a:b], True), SHINGLE)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(made, pa.binary())], names=["rep", "counts"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for i, (one, two) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if one is None or two is None:
                    held.append(i)
                    continue
                common, n, m = most_shared(one, two)
                if UNDER * common >= OVER * (n + m - common):
                    held.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(held, pa.int64())) for c in (0, 1)], names=["a", "b"])

    needed = materialize(pairs.select(F.explode(F.array("a", "b")).alias("_rep")).distinct(), "needed")
    own = probably_in(docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text"), "rep", needed, "_rep")
    # rows of equal id may differ in text: every pairing of theirs is judged
    counts = materialize(own.mapInArrow(count, "rep bigint, counts binary").join(needed, F.col("rep") == F.col("_rep"), "left_semi"), "counts")
    one = counts.select(F.col("rep").alias("a"), F.col("counts").alias("ca"))
    two = counts.select(F.col("rep").alias("b"), F.col("counts").alias("cb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ca", "cb").mapInArrow(judge, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of representatives whose sets reach the similarity.

    Only texts of documents in a pair are moved and joined, and sets are made of them
    again where they meet: texts move in half the bytes of their sets.
    """
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for lo, hi in slices_of([x + y for x, y in zip(left, right, strict=True)]):
                texts = list(dict.fromkeys([*left[lo:hi], *right[lo:hi]]))
                sets = dict(zip(texts, shingle_sets(Words(texts, True), SHINGLE), strict=True))
                held = []
                for i in range(lo, hi):
                    one, two = sets[left[i]], sets[right[i]]
                    common = len(np.intersect1d(one, two, assume_unique=True))
                    if UNDER * common >= OVER * (len(one) + len(two) - common):
                        held.append(i)
                if held:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([a[i] for i in held], pa.int64()), pa.array([b[i] for i in held], pa.int64())], names=["a", "b"])

    pairs = materialize(possible(pairs, docs), "possible")
    needed = materialize(pairs.select(F.explode(F.array("a", "b")).alias("_rep")).distinct(), "needed")
    texts = probably_in(docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text"), "rep", needed, "_rep")
    texts = materialize(texts.join(needed, F.col("rep") == F.col("_rep"), "left_semi"), "texts")
    one = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(alike, "a bigint, b bigint")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Sets are the distinct five-word shingles of lower-cased words (a shorter text
    is one shingle, a text without words none). Two documents are linked when
    100 x intersection >= 80 x union; ``component_id`` is the smallest doc_id
    reachable by links. Null text, like an empty one, is linked with nothing and
    is its own component; so is a null doc_id, whose document keeps null there
    unless a copy has an id. Rows with equal ids are judged one by one where
    their texts agree; where they differ the id's links are those of any of them.

    Equal sets are one class, represented by its smallest id, and only classes are compared.
    Frequent tokens stand last in the common order, so that they enter a prefix
    only where a text has little else. Candidates are found in two steps. First
    every row of a token meets the row that stands furthest front in its set, and
    verified links give components. Then rows of a token in different components
    meet, each outside the token's largest component with all others. So a
    group of copies costs as many pairs as it has members, and no link between
    different components is missed.
    """
    rows = materialize(document_sets(docs), "sets")
    own = rows.filter("n is not null").select("doc_id", "n", "d1", "d2")
    classes = materialize(
        own.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")).filter("rep is not null"), "classes"
    )
    tokens, counts = hot_tokens(rows)
    index = shared_index(prefix_index(docs, tokens, counts))
    keys = classes.select("rep", F.col("d1").alias("_d"), F.col("n").alias("_n"))
    index = materialize(
        index.join(keys, (F.col("d1") == F.col("_d")) & (F.col("n") == F.col("_n"))).select("token", "rep", "n", "pos", "ell", "partner"),
        "prefixes",
    )

    front = F.struct((F.col("pos") - F.col("ell")).alias("at"), F.col("rep").alias("p"), F.col("n"), F.col("ell"), F.col("partner"))
    pivots = index.groupBy("token").agg(F.min(front).alias("x")).select("token", F.col("x.p").alias("rep"), "x.n", "x.ell", "x.partner")
    stars = materialize(_pairs(index, pivots, F.col("l.rep") != F.col("r.rep")), "stars")
    links = materialize(verified(stars, docs), "links")
    first = materialize(components(links), "labels")

    labelled = index.join(first.withColumnRenamed("node", "_node"), F.col("rep") == F.col("_node"), "left").withColumn(
        "comp", F.coalesce("component", "rep")
    ).drop("_node", "component")
    sizes = labelled.groupBy("token", "comp").agg(F.count("*").alias("k"))
    main = sizes.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("x"), F.count("*").alias("c")).filter("c > 1").select(
        F.col("token").alias("_t"), F.col("x.comp").alias("main")
    )
    mixed = materialize(labelled.join(main, F.col("token") == F.col("_t")).drop("_t"), "mixed")
    minor = mixed.filter(F.col("comp") != F.col("main"))
    apart = (F.col("l.comp") != F.col("r.comp")) & ((F.col("r.comp") == F.col("r.main")) | (F.col("l.rep") < F.col("r.rep")))
    crossed = materialize(_pairs(minor, mixed, apart).join(stars, ["a", "b"], "left_anti"), "crossed")
    more = verified(crossed, docs)
    label = F.coalesce("component", "x")
    joined = more.select(F.col("a").alias("x"), "b").join(first, F.col("x") == F.col("node"), "left").select(label.alias("a"), F.col("b").alias("x"))
    joined = joined.join(first, F.col("x") == F.col("node"), "left").select("a", label.alias("b"))
    second = materialize(components(joined), "labels")

    named = classes.join(first, F.col("rep") == F.col("node"), "left").select("d1", "d2", "n", "rep", F.coalesce("component", "rep").alias("c1"))
    named = named.join(second, F.col("c1") == F.col("node"), "left").select(
        F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.col("n").alias("_n"), F.coalesce("component", "c1").alias("_c")
    )
    same = (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & (F.col("n") == F.col("_n"))
    return own.join(named, same, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("_c", "doc_id").alias("component_id")
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one whose id names it.

    Of rows with equal id and text one stays; documents without an id stay
    unless a copy has one.
    """
    found = jaccard_components(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    no_id = F.lit((1 << 63) - 1)
    found = found.select(F.coalesce("doc_id", no_id).alias("_keep")).distinct()
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("bigint"), no_id), "_text": F.xxhash64("text")})
    kept = keyed.join(found, F.col("_id") == F.col("_keep"), "left_semi")
    return kept.dropDuplicates(["_id", "_text"]).select(*docs.columns)
