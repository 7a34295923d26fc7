"""Best-fit packing of token sequences, bulk-synchronous over runs of equal sizes."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import materialize
from .common import number_in_groups
from .hashing import unit

CACHE = 60_000  # words held per Python worker, about 35 MB
TEXTS = 256  # texts of a batch that are Python strings at a time
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class ByteEncoder(dict):
    """Ids of a word that follows a space, as little-endian 32-bit numbers.

    The pre-tokeniser starts a new token at every space before a non-space, so
    the ids of a text are those of its parts in turn. Words come from a bounded
    memory; new ones are merged by the rank form of the same vocabulary, which
    holds the same merges. Texts with a special string, or with characters for
    which two versions of Unicode tables could differ, go to the library whole.
    """

    def __init__(self, json_path: str, ranks_path: str, held: int = CACHE):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.merge = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        special = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.rare = re.compile("|".join([*special, "[^\\x00-\\u024f]"]))
        self.spaced = re.compile(" \\s")
        self.starts = re.compile(" (?=\\S)")
        self.held = held

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.merge(" " + word)).tobytes()
        if len(self) < self.held:
            self[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.rare.search(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        parts = self.starts.split(text) if self.spaced.search(text) else text.split(" ")
        head = array("I", self.merge(parts[0])).tobytes() if parts[0] else b""
        if not parts[0] and len(parts) > 1:
            return b"".join(map(self.__getitem__, parts[1:]))
        return head + b"".join(map(self.__getitem__, parts[1:]))


_encoders: dict[str, ByteEncoder] = {}


def encoder(json_path: str, ranks_path: str) -> ByteEncoder:
    if json_path not in _encoders:
        _encoders[json_path] = ByteEncoder(json_path, ranks_path)
    return _encoders[json_path]


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be short of the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of every document.

    A document is its ids and ``end_id``; null or empty text is ``end_id`` alone.
    """
    end = array("I", [end_id]).tobytes()
    schema = T._parse_datatype_string(PIECES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = encoder(json_path, ranks_path)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids = memoryview(held.ids(text) + end)
                    for k, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                        row = (doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))
                        for column, value in zip(columns, row, strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(cut, schema)


def sweep_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first_rank, n, first_bin, offset): where n pieces of a length go.

    Pieces and gaps are kept as runs of equal size: at most ``capacity`` sizes,
    whatever the number of pieces. A round sweeps sizes upwards: each gap takes
    its predecessor, the largest waiting piece that fits, which is the best fit
    of that piece among the gaps left; where more pieces than gaps meet, ranks
    decide, and where a gap run is outnumbered its gaps take several at once.
    Then the gaps shrink, and the next round begins. When no piece fits a gap,
    as many empty sequences open as the rest needs at least.
    """
    waiting = {size: n for size, n in counts.items() if n}
    rank = dict.fromkeys(waiting, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    plan: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def place(size: int, n: int, first_bin: int, gap: int) -> None:
        plan.append((size, rank[size], n, first_bin, capacity - gap))
        rank[size] += n
        waiting[size] -= n

    for size in sorted(waiting, reverse=True):
        if 2 * size > capacity:  # no two of these share a sequence
            n = waiting[size]
            place(size, n, bins, capacity)
            if size < capacity:
                gaps.setdefault(capacity - size, []).append((bins, n))
            bins += n
    while any(waiting.values()):
        moved = False
        left: dict[int, list[tuple[int, int]]] = {}
        stack: list[int] = []
        for size in sorted({s for s, n in waiting.items() if n} | set(gaps)):
            if waiting.get(size):
                stack.append(size)
            for first, n in gaps.get(size, []):
                while n and stack:
                    best = stack[-1]
                    if waiting[best] >= n:
                        k = min(size // best, waiting[best] // n)
                        for i in range(k):
                            place(best, n, first, size - i * best)
                        if size > k * best:
                            left.setdefault(size - k * best, []).append((first, n))
                        n = 0
                    else:
                        m = waiting[best]
                        place(best, m, first, size)
                        if size > best:
                            left.setdefault(size - best, []).append((first, m))
                        first, n = first + m, n - m
                    moved = True
                    if not waiting[best]:
                        stack.pop()
                if n:
                    left.setdefault(size, []).append((first, n))
        gaps = left
        if not moved:
            rest = sum(s * n for s, n in waiting.items())
            n = -(-rest // capacity)
            gaps.setdefault(capacity, []).append((bins, n))
            bins += n
    return plan


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` from 1 to capacity.

    Every row gets a place, repeated rows one each. ``pieces`` is read three
    times: pass a written table. The driver sees one count per length (at most
    ``capacity`` of them) and makes a plan whose size depends on the number of
    sizes and rounds alone, not on the number of pieces. Pieces are ranked within
    their length in slices, so a length that most pieces share is no hot group.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(
        sweep_plan(counts, capacity) or [(0, 0, 0, 0, 0)],
        "_length bigint, _rank bigint, _n bigint, _bin bigint, offset bigint",
    )
    order = unit("pack", "doc_id", "piece")
    ranked = number_in_groups(pieces, "length", order, ["doc_id", "piece", "ids_crc32"], "_at")
    here = (F.col("length") == F.col("_length")) & (F.col("_at") >= F.col("_rank")) & (F.col("_at") < F.col("_rank") + F.col("_n"))
    return ranked.join(F.broadcast(plan), here).select(
        *pieces.columns, (F.col("_bin") + F.col("_at") - F.col("_rank")).alias("sequence_id"), "offset"
    )


def pack_documents(
    spark: SparkSession, docs: DataFrame, json_path: str, ranks_path: str, end_id: int = 2, capacity: int = 1024
) -> DataFrame:
    """Pieces of all documents with their places; see ``token_pieces`` and ``pack``."""
    return pack(spark, materialize(token_pieces(docs, json_path, ranks_path, end_id, capacity), "pieces"), capacity)
