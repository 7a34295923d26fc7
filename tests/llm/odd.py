"""Odd tables: nulls, empty and long texts, copies, near copies, repeated rows, clashing names."""

from __future__ import annotations

import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq


def odd_documents(with_null_ids: bool):
    """Nulls, empty and long texts, copies, near copies, repeated rows."""
    draw = random.Random(7)
    vocabulary = [a + b for a in ("ba", "de", "fi", "go", "lu", "the", "of", "na") for b in ("", "r", "st", "ne", "m")]
    prose = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    base, shared = prose(300).split(), prose(70)
    texts = [None, "", " ", "\n\n", "\x0b\f", "###", "12345", "a", "A b", "the of and", "x" * 70_000, "word " * 30_000]
    texts += [" ".join(base)] * 3 + [" ".join(base).upper()]
    for k in range(12):  # near copies of several distances
        edited = list(base)
        for _ in range(1 + k % 6):
            edited[draw.randrange(len(edited))] = f"edit{draw.randrange(10**6)}"
        texts.append(" ".join(edited))
    texts += [f"{prose(40)}\n{shared}\n{prose(30)}" for _ in range(5)]
    texts += [f"{prose(60)}\nsame footer line here\n\tà côté  été über naïve 日本語 ﬁ\u3000x\u200b\x00y <s> <|endoftext|> ▁ {prose(20)}\n" for _ in range(14)]
    texts += [prose(n) for n in (4, 5, 6, 49, 50, 51, 99, 100, 101, 2000)] * 2
    rows = [
        {"doc_id": 3 * i + 5, "text": t, "lang": draw.choice(["en", "de", None, "fr"]), "source": draw.choice(["s0", "s0", "s1", None, "s2"]),
         "n_chars": None if t is None else len(t)}
        for i, t in enumerate(texts)
    ]
    if with_null_ids:
        rows += [dict(rows[13]), dict(rows[13]), {**rows[20], "doc_id": None}, {**rows[14], "doc_id": None}, {**rows[1], "doc_id": None}]
    draw.shuffle(rows)
    return rows


SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
CLASHES = ("n_words", "slot", "kept", "length", "offset", "phrase", "token", "n", "part", "rule", "host", "n_lines", "score")


def odd_embeddings(with_null_ids: bool):
    """Short, long and null vectors, odd components, ties, repeated rows; null ids on demand."""
    draw = random.Random(11)
    near = lambda c: [x + draw.uniform(-0.04, 0.04) for x in c]
    centres = [[draw.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    vectors = [near(draw.choice(centres)) for _ in range(120)]
    vectors += [None, [], [0.0] * 63, [0.0] * 65, [0.0] * 64, [1.0] * 64, [-1.0] * 64, [0.0] * 64]
    for odd in (None, float("nan"), float("inf"), float("-inf"), 3e38):
        vectors.append([*vectors[0][:40], odd, *vectors[0][41:]])
    vectors += [[300.0, *[0.0] * 63], [-300.0, *[0.0] * 63]]
    rows = [{"vec_id": 5 * i + 2, "embedding": v, "label": None} for i, v in enumerate(vectors)]
    if with_null_ids:
        rows += [dict(rows[3]), dict(rows[3]), {**rows[7], "vec_id": None}, {**rows[9], "vec_id": None}, {**rows[12], "vec_id": rows[3]["vec_id"]}]
    draw.shuffle(rows)
    return rows


def write_tables(folder: Path, documents, pages=(), labels=(), clashes=False, embeddings=()):
    schema = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])
    table = pa.Table.from_pylist(list(embeddings), schema)
    if clashes:
        for name in ("cluster", "key", "v", "distance", "n"):
            table = table.append_column(name, pa.array(["extra"] * len(table), pa.string()))
    pq.write_table(table, folder / "embeddings.parquet", row_group_size=20)
    table = pa.Table.from_pylist(list(documents), SCHEMA)
    if clashes:
        for name in CLASHES:
            table = table.append_column(name, pa.array(["extra"] * len(table), pa.string()))
    pq.write_table(table, folder / "documents.parquet", row_group_size=20)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])
    pq.write_table(pa.Table.from_pylist(list(pages), schema), folder / "pages.parquet")
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
    pq.write_table(pa.Table.from_pylist(list(labels), schema), folder / "labels.parquet")
    return str(folder)


URLS = [
    None, "", "no scheme", "http://", "https://NET/x", "http://a.example.net/en/1?q=1", "http://a.example.net/en", "http://example.com/de/", "HTTP://Sub.Example.COM/de/x#f",
    "ftp://org/fr/", "http://x.org/fr/1", "http://notnet/x", "http://casino-win.example.org/a", "http://m.casino-win.example.org/b.html?page=2&ref=x",
    "http://example.org?x://y", "http://example.org#a://b/c", "x://é.example.org/Ünï", "http://good.example.org/a", "http://good.example.org/a",
]
