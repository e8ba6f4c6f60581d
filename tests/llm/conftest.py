from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(texts, source="s", lang="en"):
    return [(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"w{i % 977}" for i in range(60000))
    base = [
        (1, "the same text", "en", "a", 3), (1, "the same text", "en", "a", 3), (2, "the same text", None, "a", None), (3, None, "en", None, None), (4, "", None, "b", 0), (None, "lost", "en", "b", 1),
        (None, None, None, None, None), (5, long, "en", "a", len(long)), (6, long + " end", "de", "a", 1), (7, " \t\n", "en", "c", 3), (8, "é 😀 ünï x", "fr", "c", 9), (9, "one", "en", "c", 3), (4, "other text of a repeated id", "en", "b", 1),
    ]
    extra = "size long, n long, sha string, cid long, score double, token string"
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 0.5, "t") for r in base], f"{DOCS}, {extra}")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
