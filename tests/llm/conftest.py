import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Columns whose names operators use inside, of other types.
CLASHING = {"words": "int", "fp": "string", "shard": "string", "grp": "string", "pos": "string", "row": "string", "digest": "int", "__digest": "int", "kept": "int", "at": "int", "start": "string", "n_lines": "string", "id": "string", "runs": "int", "bin": "string", "key": "string", "rate": "string"}


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    words = ["".join(r2.choice("abcdefghijklmnoprstuvw") for _ in range(r2.randint(2, 9))) for r2 in [random.Random(i) for i in range(vocabulary)]]
    out = [r.choice(words) for _ in range(n)]
    for i in range(9, n, 13):
        out[i] += ".\n"
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, or from (doc_id, text) pairs."""

    def build(rows, lang="en", source="a"):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in rows], SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd(spark, make):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and clashing extra columns."""
    from pyspark.sql import functions as F

    long = prose(1, 30_000)
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 3), (None, prose(2, 80), "en", "a", 9), (None, None, None, None, None), (4, long, "en", "a", None), (5, prose(2, 80), "en", "b", 9), (5, prose(2, 80), "en", "b", 9), (6, "x", "en", "b", 1), (7, "Ünïcödé \U0001f600 " * 40, "fr", "b", 2), (8, prose(3, 90), "xx", "c", 3), (9, prose(3, 90), "xx", "c", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in CLASHING.items()})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def text_of():
    return prose
