import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

FOLDER = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """A frame of documents from texts, or from (id, text) pairs; rows may repeat and hold nulls."""

    def frame(texts, schema=DOCUMENTS):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        kinds = T._parse_datatype_string(schema)
        return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], kinds).repartition(4)

    return frame


@pytest.fixture
def clash(spark):
    """A table with a column for every name that an operator might use for itself."""

    def add(df):
        from pyspark.sql import functions as F

        names = ["id", "row", "n", "sig", "key", "kept", "size", "length", "rank", "shard", "free", "start", "_t", "_key", "_k", "_id", "spans", "chunks", "a.b"]
        return df.select("*", *[F.lit("x").alias(name) for name in names])

    return add
