"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import materialize
from .hashing import unit

UNKNOWN = "und"
ORDERS = (1, 2, 3)
PROFILE = 400  # n-grams of a profile
SAMPLE = 2000  # documents per language that a profile is learned from
_LETTERS_END = 0x32400  # no letters beyond
_CHUNK = 1 << 20
_tables: list[np.ndarray] = []


def _lower_letters() -> np.ndarray:
    """Per code point: the lower-case letter it stands for, or 0."""
    if not _tables:
        table = np.zeros(_LETTERS_END, np.int64)
        for i in range(_LETTERS_END):
            c = chr(i)
            if unicodedata.category(c)[0] == "L":
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _tables.append(table)
    return _tables[0]


def _letters(text: str) -> np.ndarray:
    """Letters of a text, runs of anything else as one 0, a 0 at both ends."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    table = _lower_letters()
    out = np.zeros(len(points) + 2, np.int64)
    inside = points < len(table)
    out[1:-1][inside] = table[points[inside]]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the n-grams of a text, words being padded by 0. Long texts are summed in parts."""
    letters = _letters(text)
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, len(letters), _CHUNK):
        part = letters[at : at + _CHUNK + max(ORDERS) - 1]
        found = []
        for n in ORDERS:
            starts = min(_CHUNK, len(part) - n + 1)
            if starts <= 0:
                continue
            code = part[:starts].copy()
            whole = code != 0 if n == 1 else np.ones(starts, bool)
            for j in range(1, n):
                step = part[j : j + starts]
                code = code << 21 | step
                if j < n - 1:
                    whole &= step != 0
            if n == 2:
                whole &= (part[:starts] != 0) | (part[1 : 1 + starts] != 0)
            found.append(code[whole] << 2 | n)
        new, n_new = np.unique(np.concatenate(found), return_counts=True) if found else (codes[:0], counts[:0])
        if len(codes):
            new, back = np.unique(np.concatenate([codes, new]), return_inverse=True)
            n_new = np.bincount(back, np.concatenate([counts, n_new])).astype(np.int64)
        codes, counts = new, n_new
    return codes, counts


def top_grams(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes in order; ties by code."""
    if len(codes) > 2 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        held = counts >= least
        codes, counts = codes[held], counts[held]
    return codes[np.lexsort((codes, -counts))[:size]]


@dataclass(frozen=True)
class Profiles:
    """Ranks of n-grams per language: ``ranks[v, l]`` for code ``codes[v]``, PROFILE where absent."""

    languages: tuple[str, ...]
    codes: np.ndarray
    ranks: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        codes, counts = gram_counts(text)
        if not len(codes):
            return UNKNOWN, 0.0
        top = top_grams(codes, counts, PROFILE)
        at = np.minimum(np.searchsorted(self.codes, top), max(len(self.codes) - 1, 0))
        known = self.codes[at] == top if len(self.codes) else np.zeros(len(top), bool)
        away = np.full((len(top), len(self.languages)), PROFILE, np.int64)
        away[known] = np.abs(self.ranks[at[known]] - np.flatnonzero(known)[:, None])
        away[known] = np.where(self.ranks[at[known]] == PROFILE, PROFILE, away[known])
        distance = away.sum(0)
        best = int(np.argmin(distance))
        return self.languages[best], 1.0 - float(distance[best]) / (PROFILE * len(top))


def chosen_documents(labelled: DataFrame, sample: int) -> DataFrame:
    """(doc_id, lang): the ``sample`` documents of each language with the smallest keyed hashes, ties by id.

    A language with many documents is cut first by a bound on the hash that about twice as many pass,
    raised should that once not be enough, so no task orders more than a few times ``sample`` documents of one.
    """
    keyed = labelled.select("doc_id", "lang", unit("profile", "doc_id").alias("_u"))
    sizes = materialize(keyed.groupBy(F.col("lang").alias("_l")).agg(F.count("*").alias("_n")), "sizes")
    below, share = None, 2.0
    while True:
        bounded = keyed.join(sizes, F.col("lang") == F.col("_l")).filter(F.col("_u") * F.col("_n") <= share * sample)
        below = materialize(bounded.select("doc_id", "lang", "_u"), "bounded")
        held = below.groupBy(F.col("lang").alias("_h")).agg(F.count("*").alias("_k"))
        short = sizes.join(held, F.col("_l") == F.col("_h"), "left").filter(F.coalesce("_k", F.lit(0)) < F.least("_n", F.lit(sample)))
        if short.isEmpty():
            break
        share *= 2
    order = Window.partitionBy("lang").orderBy("_u", "doc_id")
    return below.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= sample).select("doc_id", "lang")


def learn_profiles(docs: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles from at most ``sample`` documents of each language, chosen by a keyed hash.

    Only ``text`` and non-null ``lang`` are learned from. The choice reads ids and
    languages alone; counts are summed on the executors, PROFILE n-grams per
    language reach the driver. Equal counts are ordered by n-gram code.
    """
    labelled = docs.filter(F.col("lang").isNotNull())
    chosen = materialize(chosen_documents(labelled, sample).distinct(), "sample")  # its size decides whether texts are moved to join it
    texts = labelled.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    by.setdefault(lang, []).append(gram_counts(text))
            for lang, found in by.items():
                codes, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                n = np.bincount(back, np.concatenate([k for _, k in found]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "code", "n"])

    counts = texts.select("lang", "text").mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(
        F.sum("n").alias("n"))
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = counts.withColumn("rank", F.row_number().over(by_count) - 1).filter(F.col("rank") < PROFILE).collect()
    languages = tuple(sorted({r["lang"] for r in rows}))
    codes = np.array(sorted({r["code"] for r in rows}), np.int64)
    ranks = np.full((len(codes), len(languages)), PROFILE, np.int64)
    for r in rows:
        ranks[np.searchsorted(codes, r["code"]), languages.index(r["lang"])] = r["rank"]
    return Profiles(languages, codes, ranks)


def identify_languages(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (1 - out-of-place distance / largest possible distance).

    Null, empty or letterless text is `und` with score 0. Equal distances go to
    the first language in order. Rows are neither moved nor dropped; added names
    replace equal ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # at most PROFILE x languages ranks

    @F.pandas_udf("lang_pred string, score double")
    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([shared.value.predict(t) for t in part], columns=["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, predicted(F.col(text)).alias("_p")).select(*kept, "_p.lang_pred", "_p.score")
