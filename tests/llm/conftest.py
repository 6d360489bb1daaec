import random

import pytest
from pyspark.sql import functions as F

CLASH = ["score", "h", "size", "kept", "print", "rep", "v", "w", "key", "votes", "n_words", "text_", "copies", "class_id", "predicted", "target", "f",
    "mult", "cell", "toxic_", "shard", "part"]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n, words=WORDS):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, clashing columns."""
    rows = [
        (1, prose(1, 120), "en", "a"), (2, prose(1, 120), "en", "a"), (3, None, "en", None), (4, "", None, "b"), (5, " \t\n ", "de", "b"),
        (6, prose(6, 40_000), "fr", "a"), (7, prose(7, 60), None, "c"), (7, prose(7, 60), None, "c"), (None, prose(8, 70), "en", "a"),
            (None, None, None, None), (9, "x", "en", "c"), (10, "a" * 50_000, "en", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, None, None), (2, 1, 0), (None, 0, 1), (9, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
