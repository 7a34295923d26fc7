"""Per-row featurisers and text encoders as distributed, accounted jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_missing_smiles, is_missing_text
from .tables import status_counts

VECTOR_SCHEMA = "key string, vec array<float>, status string"


def fingerprint_job(df: DataFrame, featurize: Callable[[str], Sequence[float] | None], dim: int) -> DataFrame:
    """(key, vec, status) from (key, smiles): zeros where missing or not parsable.

    ``featurize`` is a user function that returns None for invalid input.
    """
    asked = df.select(F.col("key").cast("string").alias("key"), "smiles", is_missing_smiles("smiles").alias("_missing"))
    blank = [0.0] * dim

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vecs, status = [], []
            for smiles, missing in zip(pdf["smiles"], pdf["_missing"], strict=True):
                vec = None if missing else featurize(smiles)
                status.append("missing" if missing else "invalid" if vec is None else "ok")
                vecs.append(blank if vec is None else [float(x) for x in vec])
            yield pd.DataFrame({"key": pdf["key"], "vec": vecs, "status": status})

    return asked.mapInPandas(run, VECTOR_SCHEMA)


def encode_text_job(
    df: DataFrame, make_encoder: Callable[[], Callable[[list[str]], Sequence]], dim: int, batch_size: int = 32
) -> DataFrame:
    """(key, vec, status) from (key, text).

    ``make_encoder`` runs once per task and returns a batch encoder. A batch
    that fails is retried item by item; an item that fails, or has no text,
    gets zeros.
    """
    asked = df.select(F.col("key").cast("string").alias("key"), "text", is_missing_text("text").alias("_missing"))
    blank = [0.0] * dim

    def encode(encoder, texts: list[str]) -> list[tuple[list[float], str]]:
        try:
            return [([float(x) for x in v], "ok") for v in encoder(texts)]
        except Exception:  # a model may reject any single text
            if len(texts) == 1:
                return [(blank, "failed")]
            return [(vec, "retried" if s == "ok" else s) for t in texts for vec, s in encode(encoder, [t])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for pdf in batches:
            results: list[tuple[list[float], str]] = [(blank, "missing")] * len(pdf)
            present = [i for i, gone in enumerate(pdf["_missing"]) if not gone]
            texts = pdf["text"].tolist()
            for at in range(0, len(present), batch_size):
                part = present[at : at + batch_size]
                for i, result in zip(part, encode(encoder, [texts[i] for i in part]), strict=True):
                    results[i] = result
            yield pd.DataFrame(
                {"key": pdf["key"], "vec": [v for v, _ in results], "status": [s for _, s in results]}
            )

    return asked.mapInPandas(run, VECTOR_SCHEMA)


def build_run_stats(results: DataFrame) -> DataFrame:
    """Total, successes and each kind of zero filling of a finished job."""
    status = F.col("status")
    return status_counts(
        results,
        {
            "success": status.isin("ok", "retried"),
            "zero_filled": ~status.isin("ok", "retried"),
            "missing": status == "missing",
            "invalid": status == "invalid",
            "failed": status == "failed",
            "retried": status == "retried",
        },
    )
