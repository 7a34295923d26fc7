"""Substring dedup: recurring passages found again by sharded Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import materialize
from .wordhash import Words, run_hashes, slices_of

WINDOW = 50  # words of a passage at least
PHRASE = 12  # words of a phrase; every window has one phrase that stands for it
SHARD_WORDS = 400_000  # words of the passages of one automaton, about 20 MB
PIECE = 50_000  # words of a document whose passages go to one shard together
READ_WORDS = 4_000_000  # words that one compiled automaton reads
SENT = 1 << 22  # words of stretches that are sent on together
READ_TOGETHER = 1 << 16  # words of stretches that an automaton reads in one go
NO_ID = (1 << 63) - 1  # stands for a null doc_id, which is smaller than none

# t of a phrase's row is the text's key where the id is null, else 0, so that documents without an id stay apart
_FIRST = "doc_id bigint, t bigint, n_words bigint, sha string, phrase bigint"
_PASSAGE = "first bigint, piece int, n_words int, words binary, phrases array<bigint>"
_STRETCH = "shard int, doc_id bigint, t bigint, n_words int, places array<int>, words binary"
_STREAM = ["shard", "part", "kind", "doc_id", "t", "places", "words"]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _lowest(phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest, place of the first such) of the phrases inside each window, by doubling."""
    low, at, k, width = phrases, np.arange(len(phrases)), 1, WINDOW - PHRASE + 1
    while k < width:
        s = min(k, width - k)
        first = low[:-s] <= low[s:]
        low, at = np.where(first, low[:-s], low[s:]), np.where(first, at[:-s], at[s:])
        k += s
    return low, at


def window_phrases(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase hashes, per window the place of its phrase): the first of the smallest hashes inside.

    Equal windows have equal phrases, and neighbours mostly share one.
    """
    phrases = run_hashes(hashes, PHRASE)
    return phrases, _lowest(phrases)[1]


def _smallest(words: Words) -> np.ndarray:
    """From each word of a slice of texts on the phrase of the window that begins there."""
    low, k, width = run_hashes(words.hashes, PHRASE), 1, WINDOW - PHRASE + 1
    while k < width:
        s = min(k, width - k)
        low = np.minimum(low[:-s], low[s:])
        k += s
    return low


def _phrase_runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, phrase, first window, windows) of each run of windows of a text that have the same phrase."""
    many = np.maximum(np.diff(words.first) - WINDOW + 1, 0)
    owner = np.repeat(np.arange(len(many)), many)
    start = np.arange(len(owner)) + np.repeat(words.first[:-1] - np.cumsum(many) + many, many)
    phrase = _smallest(words)[start] if len(start) else np.empty(0, np.uint64)
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (phrase[1:] != phrase[:-1])
    at = np.flatnonzero(new)
    return owner[at], phrase[at], start[at], np.diff(np.append(at, len(owner)))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which ``values`` are in ``known``, which is sorted."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def _unsigned(lists: pa.ListArray) -> np.ndarray:
    """The numbers of all lists, each once, sorted."""
    return np.unique(lists.flatten().to_numpy().view(np.uint64))


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list, Words]]:
    texts = batch.column(column).to_pylist()
    for a, b in slices_of(texts):
        yield a, b, texts, Words(texts[a:b], False)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, t, text) with an id for null and a key of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text")
    )


def document_phrases(keyed: DataFrame) -> DataFrame:
    """Per document a row (doc_id, t, n_words, sha of its words) and a row (doc_id, phrase) for each phrase."""
    names = [x.split()[0] for x in _FIRST.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, texts, words in _texts(batch, 2):
                own = [(ids[i], keys[i], hashlib.sha256(b" ".join(texts[i].encode().split())).hexdigest()) for i in range(a, b)]
                columns = [pa.array(c, t) for c, t in zip(zip(*own, strict=True), [pa.int64(), pa.int64(), pa.string()], strict=True)]
                columns.insert(2, pa.array(np.diff(words.first)))
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(own), pa.int64())], names=names)
                text, phrase, _, _ = _phrase_runs(words)
                order = np.lexsort((phrase, text))
                text, phrase = text[order], phrase[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (phrase[1:] != phrase[:-1])
                if len(text):
                    owner = np.array(ids[a:b], np.int64)
                    key = np.where(owner == NO_ID, np.array(keys[a:b], np.int64), 0)
                    at = text[new]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(owner[at]), pa.array(key[at]), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.string()),
                         pa.array(_signed(phrase[new]))], names=names)

    return keyed.mapInArrow(read, _FIRST)


def candidate_windows(texts: DataFrame) -> DataFrame:
    """(window, doc_id) of the windows whose phrase is among the document's recurring ``phrases``."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shared = batch.column(0).to_numpy(), batch.column(2)
            for a, b, _, words in _texts(batch, 1):
                # a phrase recurs for all texts that have it, so those of the slice are looked up together
                text, phrase, start, many = _phrase_runs(words)
                known = _among(phrase, _unsigned(shared.slice(a, b - a)))
                text, start, many = text[known], start[known], many[known]
                if len(text):
                    at = np.arange(many.sum()) + np.repeat(start - np.cumsum(many) + many, many)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_signed(run_hashes(words.hashes, WINDOW)[at])), pa.array(np.repeat(ids[a:b][text], many))],
                        names=["window", "doc_id"])

    return texts.select("doc_id", "text", "phrases").mapInArrow(read, "window bigint, doc_id bigint")


def confirmed_passages(texts: DataFrame) -> DataFrame:
    """(first, piece, n_words, words, phrases) of the maximal runs of a document's confirmed ``windows``.

    A run is cut where it passes a multiple of PIECE, the parts sharing all but one word of a window, so none is longer than that.
    """
    names = [x.split()[0] for x in _PASSAGE.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, confirmed = batch.column(0).to_pylist(), batch.column(2)
            for a, b, _, words in _texts(batch, 1):
                rows, all_windows, all_phrases = [], run_hashes(words.hashes, WINDOW), _smallest(words)
                for i in range(a, b):
                    lo, hi = words.first[i - a], max(words.first[i - a], words.first[i - a + 1] - WINDOW + 1)
                    hashes, phrases = words.hashes[lo : words.first[i - a + 1]], all_phrases[lo:hi]
                    here = np.flatnonzero(_among(all_windows[lo:hi], np.sort(confirmed[i].values.to_numpy().view(np.uint64))))
                    for run in np.split(here, np.flatnonzero((np.diff(here) > 1) | (np.diff(here // PIECE) > 0)) + 1) if len(here) else []:
                        passage = hashes[run[0] : run[-1] + WINDOW]
                        rows.append((ids[i], int(run[0]) // PIECE, len(passage), passage.tobytes(), _signed(np.unique(phrases[run[0] : run[-1] + 1])).tolist()))
                if rows:
                    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return texts.select("doc_id", "text", "windows").mapInArrow(read, _PASSAGE)


class PassageAutomaton:
    """Finds every occurrence of the phrases of some passages, and the passages' windows around them."""

    def __init__(self, passages: list[tuple[int, np.ndarray]]):
        import ahocorasick

        self.known = np.unique(np.concatenate([p for _, p in passages])) if passages else np.empty(0, np.uint64)
        self.width = max(1, -(-len(self.known).bit_length() // 5))
        # known words begin with the bits of a slot from slots[bits] on
        self.shift = np.uint64(64 - max(1, len(self.known).bit_length()))
        self.slots = np.searchsorted(self.known >> self.shift, np.arange((1 << 64 - int(self.shift)) + 1, dtype=np.uint64))
        self.automaton = ahocorasick.Automaton()
        windows, firsts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for first, passage in passages:
            symbols = self.symbols(passage)
            _, at = window_phrases(passage)
            for offset in np.unique(at).tolist():
                self.automaton.add_word(symbols[offset * self.width : (offset + PHRASE) * self.width], True)
            windows.append(run_hashes(passage, WINDOW))
            firsts.append(np.full(len(windows[-1]), first, np.int64))
        self.empty = not len(self.automaton)
        self.automaton.make_automaton()
        order = np.argsort(all_windows := np.concatenate(windows))
        self.windows, self.firsts = all_windows[order], np.concatenate(firsts)[order]

    def symbols(self, hashes: np.ndarray) -> str:
        """Each word's number among the known words as ``width`` symbols, 0 for words of no passage.

        Nodes have 32 branches at most that way, and as a word's first symbol has
        letters of its own, matches begin at words.
        """
        slot = (hashes >> self.shift).view(np.int64)
        at, end, numbers = self.slots[slot], self.slots[slot + 1], np.zeros(len(hashes), np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            here = self.known[at[left]] == hashes[left]
            numbers[left[here]] = at[left[here]] + 1
            left = left[~here]
            at[left] += 1
            left = left[at[left] < end[left]]
        shifts = np.arange(self.width - 1, -1, -1) * 5
        digits = (numbers[:, None] >> shifts & 31) + np.where(shifts == shifts[0], 64, 96)
        return digits.astype(np.uint8).tobytes().decode("ascii")

    def covered(self, doc_id: int | np.ndarray, hashes: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges covered by windows that also start in a document with a smaller id than ``doc_id``, or than that of the word.

        A window can be one of a passage only around an occurrence of a phrase;
        it is one if its hash is.
        """
        n = len(hashes) - WINDOW + 1
        if self.empty or n < 1:
            return []
        ends = [end for end, _ in self.automaton.iter(self.symbols(hashes))]
        if not ends:
            return []
        starts = np.array(ends, np.int64) // self.width - PHRASE + 1
        near = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(near, np.maximum(starts + PHRASE - WINDOW, 0), 1)
        np.add.at(near, starts + 1, -1)
        around = np.flatnonzero(np.cumsum(near)[:n] > 0)
        found = run_hashes(hashes, WINDOW)[around]
        at = np.minimum(np.searchsorted(self.windows, found), len(self.windows) - 1)
        own = doc_id[around] if isinstance(doc_id, np.ndarray) else doc_id
        here = around[(self.windows[at] == found) & (self.firsts[at] < own)]
        runs = np.split(here, np.flatnonzero(np.diff(here) > WINDOW) + 1) if len(here) else []
        return [(int(run[0]), int(run[-1]) + WINDOW) for run in runs]


def stretches(texts: DataFrame) -> DataFrame:
    """(shard, doc_id, t, n_words, places, words): what a document sends to each of its ``shards``.

    These are the words of the windows whose phrase is one of the shard's, as stretches with a word between that is none; ``places`` has
    start and length of each stretch. ``phrases`` and ``shards`` of a document belong together place by place.
    """
    names = [x.split()[0] for x in _STRETCH.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary()]
    between = np.zeros(1, np.uint64)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, _, words in _texts(batch, 2):
                rows, held = [], 0
                text, phrase, start, many = _phrase_runs(words)
                cuts = np.searchsorted(text, np.arange(b - a + 1)).tolist()
                for i in range(a, b):
                    of = slice(cuts[i - a], cuts[i - a + 1])
                    asked, shards = (batch.column(c)[i].values.to_numpy() for c in (3, 4))
                    order = np.lexsort((asked.view(np.uint64), shards))
                    asked, shards = asked.view(np.uint64)[order], shards[order]
                    for some in np.split(np.arange(len(shards)), np.flatnonzero(np.diff(shards)) + 1):
                        here = _among(phrase[of], asked[some])
                        first = start[of][here]
                        if not len(first):
                            continue
                        last = first + many[of][here] + WINDOW - 1
                        new = np.flatnonzero(np.append(True, first[1:] > last[:-1]))
                        first, last = first[new], last[np.append(new[1:] - 1, len(last) - 1)]
                        parts = [x for f, e in zip(first.tolist(), last.tolist(), strict=True) for x in (words.hashes[f:e], between)][:-1]
                        sent = np.concatenate(parts)
                        places = np.stack([first - words.first[i - a], last - first], 1).ravel().tolist()
                        rows.append((int(shards[some[0]]), ids[i], keys[i], len(sent), places, sent.tobytes()))
                        held += len(sent)
                        if held > SENT:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return texts.select("doc_id", "t", "text", "phrases", "shards").mapInArrow(read, _STRETCH)


def placed_spans(spans: list[tuple[int, int]], places: np.ndarray) -> list[int]:
    """Start and end of each of ``spans``, found in stretches with one word between, as places in the document."""
    starts, lengths = places[::2], places[1::2]
    begins = np.cumsum(lengths + 1) - lengths - 1
    shift = starts - begins
    return [x + int(shift[k]) for span in spans for k in [np.searchsorted(begins, span[0], "right") - 1] for x in span]


def read_together(automaton: PassageAutomaton, ids: list[int], stretches: list[np.ndarray]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(number, ranges) of the rows of stretches that have covered words; the rows are read in one go, with a word between that is none."""
    begins = np.cumsum([0] + [len(h) + 1 for h in stretches])
    hashes = np.zeros(begins[-1], np.uint64)
    for h, a in zip(stretches, begins.tolist(), strict=False):
        hashes[a : a + len(h)] = h
    spans = np.array(automaton.covered(np.repeat(np.array(ids, np.int64), np.diff(begins)), hashes), np.int64).reshape(-1, 2)
    owner = np.searchsorted(begins, spans[:, 0], "right") - 1
    spans -= begins[owner][:, None]
    for some in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1) if len(owner) else []:
        yield int(owner[some[0]]), list(map(tuple, spans[some].tolist()))


def located(stream: DataFrame) -> DataFrame:
    """(doc_id, t, spans) from rows sorted by (shard, part, kind): passages, then the stretches to read."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, passages, automaton = None, [], None
        for batch in batches:
            shard, part, kind, ids, keys = (batch.column(i).to_pylist() for i in range(5))
            places, words = batch.column(5), batch.column(6)
            rows, some, held = [], [], 0
            for i in range(len(batch)):
                if (shard[i], part[i]) != at:
                    at, passages, automaton = (shard[i], part[i]), [], None
                hashes = np.frombuffer(words[i].as_buffer(), np.uint64)
                if kind[i] == 0:
                    passages.append((ids[i], hashes.copy()))
                    continue
                if automaton is None:
                    automaton = PassageAutomaton(passages)
                some.append((i, hashes))
                held += len(hashes)
                if held > READ_TOGETHER or i + 1 == len(batch) or (shard[i + 1], part[i + 1]) != at:
                    for k, spans in read_together(automaton, [ids[r] for r, _ in some], [h for _, h in some]):
                        row = some[k][0]
                        rows.append((ids[row], keys[row], placed_spans(spans, places[row].values.to_numpy().astype(np.int64))))
                    some, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.list_(pa.int32())], strict=True)],
                    names=["doc_id", "t", "spans"])

    return stream.select(*_STREAM).mapInArrow(read, "doc_id bigint, t bigint, spans array<int>")


def cut_texts(texts: DataFrame) -> DataFrame:
    """(doc_id, t, n_removed, sha, kept) of texts whose word ranges ``spans`` go."""
    names = ["doc_id", "t", "n_removed", "sha", "kept"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, spans = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            rows = []
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = text.encode().split()
                keep = np.ones(len(words), bool)
                for a, b in zip(spans[i][::2], spans[i][1::2], strict=True):
                    keep[a:b] = False
                kept = b" ".join([words[k] for k in np.flatnonzero(keep).tolist()])
                rows.append((ids[i], keys[i], int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return texts.select("doc_id", "t", "text", "spans").mapInArrow(read, "doc_id bigint, t bigint, n_removed bigint, sha string, kept string")


def remove_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digest, cut): per document (doc_id, n_words, n_removed, kept_sha256), and the texts that lost words.

    Words are separated by `[\\x20\\x09-\\x0D]`. Each word goes that is covered by
    a window of WINDOW consecutive words whose sequence also starts in a document
    with a smaller doc_id; windows are judged on the input. Null text has no
    words; a null doc_id counts as larger than all; rows with equal ids never
    remove from each other, repeated rows are treated alike and all returned.

    1. Every window is stood for by one of its phrases; phrases in one document
       alone are dropped, which leaves the shared text.
    2. Windows around the others are confirmed: hashes that occur in two documents,
       each with the smallest id. Runs of them in that document are the passages.
    3. Passages are dealt to shards of bounded size, those of a document together but for very
       long ones, and each shard becomes one automaton over its phrases. To the shards that hold one of its phrases a
       document sends the stretches around them, not its text; a shard that reads many words is compiled in several parts.
       The windows around each occurrence are compared with those of the passages.
    """
    keyed = _keyed(docs)
    rows = materialize(document_phrases(keyed), "phrases")
    own = rows.filter("phrase is null").select("doc_id", "t", "n_words", "sha")
    phrases = rows.filter("phrase is not null").select("phrase", "doc_id", "t")
    shared = phrases.groupBy(F.col("phrase").alias("_p")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    held = materialize(phrases.join(shared.select("_p"), F.col("phrase") == F.col("_p")).select("phrase", "doc_id", "t"), "shared")
    wanted = held.groupBy(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).agg(F.collect_set("phrase").alias("phrases"))
    own_key = F.when(F.col("doc_id") == NO_ID, F.col("t")).otherwise(F.lit(0))
    texts = materialize(
        keyed.join(wanted, (F.col("doc_id") == F.col("_d")) & (own_key == F.col("_t"))).select("doc_id", "t", "text", "phrases"), "texts")

    windows = candidate_windows(texts).groupBy("window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    firsts = windows.groupBy(F.col("lo").alias("_d")).agg(F.collect_list("window").alias("windows"))
    passages = confirmed_passages(texts.select("doc_id", "text").join(firsts, F.col("doc_id") == F.col("_d")).select("doc_id", "text", "windows"))
    passages = materialize(passages, "passages")
    total = passages.agg(F.sum("n_words")).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    dealt = passages.withColumn("shard", F.pmod(F.xxhash64("first", "piece"), F.lit(shards)).cast("int"))

    places = dealt.select("shard", "first", F.explode("phrases").alias("_p")).groupBy("_p", "shard").agg(F.min("first").alias("lo"))
    asked = held.join(places, (F.col("phrase") == F.col("_p")) & (F.col("doc_id") > F.col("lo")))
    routes = asked.groupBy(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).agg(F.collect_list(F.struct("phrase", "shard")).alias("routes"))
    once = texts.select("doc_id", "t", "text").dropDuplicates(["doc_id", "t"])
    sending = once.join(routes, (F.col("doc_id") == F.col("_d")) & (own_key == F.col("_t"))).select(
        "doc_id", "t", "text", F.col("routes.phrase").alias("phrases"), F.col("routes.shard").alias("shards"))
    sent = materialize(stretches(sending), "stretches")
    parts = sent.groupBy("shard").agg(F.ceil(F.sum(F.col("n_words").cast("bigint")) / READ_WORDS).cast("int").alias("parts"))
    parts = materialize(parts, "parts")
    none = F.lit(None)
    sources = dealt.join(parts, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"),
        F.col("first").alias("doc_id"), none.cast("bigint").alias("t"), none.cast("array<int>").alias("places"), "words",
    )
    readers = sent.join(parts, "shard").select(
        "shard", F.pmod(F.xxhash64("doc_id", "t"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"),
        "doc_id", "t", "places", "words",
    )
    stream = sources.unionByName(readers).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
    spans = located(stream).groupBy(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    found = texts.select("doc_id", "t", "text").dropDuplicates(["doc_id", "t"]).join(spans, (F.col("doc_id") == F.col("_d")) & (F.col("t") == F.col("_t")))
    cut = materialize(cut_texts(found), "cut")
    changed = cut.select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "n_removed", F.col("sha").alias("_sha"))
    digest = own.join(changed, (F.col("doc_id") == F.col("_d")) & (F.col("t") == F.col("_t")), "left").select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_words",
        F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("_sha", "sha").alias("kept_sha256"),
    )
    return digest, cut.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_removed", F.col("kept").alias("text"))
