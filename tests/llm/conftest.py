from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from odd import URLS, odd_documents, odd_embeddings, write_tables  # noqa: E402


@pytest.fixture(scope="session")
def odd_dir(tmp_path_factory):
    pages = [{"page_id": i if i % 7 else None, "url": u, "html": None} for i, u in enumerate(URLS * 4)]
    labels = [{"doc_id": i, "quality": None if i % 5 == 0 else 1, "toxic": int("casino" in (u or ""))} for i, u in enumerate(URLS * 4) if i % 3]
    return write_tables(tmp_path_factory.mktemp("odd"), odd_documents(True), pages, labels, clashes=True, embeddings=odd_embeddings(True))


@pytest.fixture(scope="session")
def plain_dir(tmp_path_factory):
    pages = [{"page_id": i, "url": u, "html": ""} for i, u in enumerate(URLS * 4)]
    labels = [{"doc_id": i, "quality": 1, "toxic": int("casino" in (u or ""))} for i, u in enumerate(URLS * 4) if i % 3]
    return write_tables(tmp_path_factory.mktemp("plain"), odd_documents(False), pages, labels, embeddings=odd_embeddings(False))


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("empty"), [])
