from __future__ import annotations

import pytest

CLASHING = "id long, key string, size int, row string, chunk long, bucket int, h string, rep long, z double, found int, part int, place int"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def messy_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 997}x{i % 31}" for i in range(30_000))
    plain = "the quick brown fox jumps over the lazy dog and runs away into the dark green forest again"
    return [
        (1, plain, "en", "a", 10),
        (1, plain, "en", "a", 10),  # repeated
        (2, plain, "en", "b", None),
        (3, None, "en", "a", 0),
        (4, "", None, "b", 0),
        (5, "   \n\t ", "fr", None, 6),
        (6, long, "en", "c", len(long)),
        (7, long + " tail", "en", None, len(long) + 5),
        (8, "Été à l'école 中文 😀 naïve", None, "a", 24),
        (9, "one", "en", "c", 3),
        (None, plain, "en", None, 10),
        (None, None, None, None, None),
        (10, "\u0000 odd   ***", "de", "b", 9),
    ]


@pytest.fixture(scope="session")
def messy(spark):
    extra = (5, "k", 1, "r", 2, 3, "h", 4, 0.5, 6, 7, 8)
    return spark.createDataFrame([r + extra for r in messy_rows()], f"{DOCUMENT}, {CLASHING}").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], f"{DOCUMENT}, {CLASHING}")


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
