import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("id", T.LongType())])

EN = "the house of river and stone with morning light over quiet fields where people walk slowly toward market".split()
DE = "der garten und das wasser mit einem schönen stück über straße für mädchen welche täglich größer werden".split()


def prose(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text[, lang[, source]]) with further columns whose names clash with results."""

    def make(rows):
        full = []
        for r in rows:
            i, t, lang, source = (*r, *[None] * (4 - len(r)))
            full.append((i, t, lang, source, len(t or ""), "mine", -1))
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, short, non-ASCII, very long and repeated texts."""
    rng = random.Random(3)
    long = prose(rng, EN, 30_000)
    return [None, "", "  \t\n ", "one", "two words", "Ünïcödé ß 日本語 😀", "12345 !!!", long, long, "x" * 1500, prose(rng, EN, 200), prose(rng, DE, 200)]
