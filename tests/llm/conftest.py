import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

# Null ids and texts, empty and blank ones, repeated rows and ids, ties, a very long text, no spaces.
ODD = [
    (1, "The cat sat on the mat and looked at the dog."),
    (1, "The cat sat on the mat and looked at the dog."),
    (2, "The cat sat  on the\tmat and looked at the dog."),
    (3, None),
    (4, ""),
    (5, " \n "),
    (None, "A row without an id, mail a.b@mail.example.com now."),
    (None, "A row without an id, mail a.b@mail.example.com now."),
    (7, "word " * 40_000),
    (8, "x" * 20_000),
    (9, "é日本🙂 ½ don't <|endoftext|> <s> \x00 1234567812345670"),
    (9, "another text under the id nine"),
    (-5, "Licensed under the Apache License, Version 2.0."),
]


def documents(spark, rows):
    """A documents table with columns whose names the operators use themselves."""
    full = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows]
    docs = spark.createDataFrame(full, SCHEMA)
    names = ["hash", "score", "part", "range", "copy", "uid", "members", "words", "base", "bin"]
    names += ["__origin", "__mark", "marked_id", "found", "Kept_Id", "own_mark", "place"]
    return docs.withColumns({name: F.lit("mine") for name in names})


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def sample(spark):
    from tests.conftest import SF_DIR

    return spark.read.parquet(f"{SF_DIR}/documents.parquet")
