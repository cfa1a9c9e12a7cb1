import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text[, lang[, source]])"""
        return spark.createDataFrame([(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def words():
    def make(seed, n, vocabulary=3000):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))

    return make
