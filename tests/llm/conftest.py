import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing column names."""
    long_text = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 1),
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 1),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (None, "no id here at all but words enough to count", "en", None, 3),
        (None, None, None, None, None),
        (4, long_text, "en", "b", 7),
        (5, "alpha beta gamma delta epsilon zeta", "en", "b", 1),
        (6, " \n\t \n", "en", "a", 5),
        (7, "ÄÖÜ ß line\nÄÖÜ ß line\n|#*", "de", "b", 5),
    ]
    docs = spark.createDataFrame(rows, DOC)
    from pyspark.sql import functions as F

    for name in ("size", "target", "length", "part", "host", "kept", "score", "id", "key", "piece", "start", "n", "path", "rule", "grade"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOC)


def made_up(n, seed=0, words=60, vocabulary=300):
    rng = random.Random(seed)
    return [" ".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") + str(rng.randrange(vocabulary)) for _ in range(rng.randrange(5, words))) for _ in range(n)]


@pytest.fixture
def texts():
    return made_up
