from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def documents(spark):
    """Build a documents table from texts, or from (id, text[, lang, source]) rows."""

    def build(rows, parts: int = 3):
        full = []
        for k, r in enumerate(rows):
            r = (k, r) if r is None or isinstance(r, str) else tuple(r)
            r = r + ("en", "src0")[len(r) - 2:]
            full.append((r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1])))
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return build
