from __future__ import annotations

import pytest
from pyspark.sql import DataFrame

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and river stone house green light water under over train paper cloud seven blue door window garden table".split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ing", "s"]) + str(rng.randint(0, 40)) for _ in range(n))


def odd_rows() -> list[tuple]:
    """NULLs in every column, empty and long texts, ties, repeated rows, near copies and a hot source."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed")
    rows = [
        (1, base, "en", "a", 1),
        (2, near, "en", "a", 1),
        (3, base, "en", "b", 1),
        (4, "", "en", "b", 0),
        (5, None, "en", None, None),
        (6, "12 34 -- 5", None, "a", 3),
        (7, "one two", "fr", "c", 7),
        (7, "one two three", "fr", "c", 9),
        (8, "same row\nsame row\n\n  Same   ROW  ", "fr", "c", 8),
        (8, "same row\nsame row\n\n  Same   ROW  ", "fr", "c", 8),
        (None, prose(2, 30), "de", "a", None),
        (9, prose(3, 4000), "de", None, 20),
        (10, " \t\n ", "de", "a", 3),
        (11, "été où ñandú 中文 🙂 naïve", None, "z", 4),
    ]
    return rows + [(100 + i, prose(50 + i, 40 + i), ("en", "fr", "de")[i % 3], "a", i) for i in range(24)]


@pytest.fixture(scope="session")
def docs(spark) -> DataFrame:
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def none(spark) -> DataFrame:
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Write a DataFrame as a table folder that a registered query can read."""

    def write(df: DataFrame, name: str = "documents") -> str:
        path = tmp_path_factory.mktemp("tables")
        df.write.parquet(str(path / f"{name}.parquet"))
        return str(path)

    return write
