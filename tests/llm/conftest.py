import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("score", T.DoubleType())])


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns whose names the operators use inside."""
    rng = random.Random(3)
    words = [rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice("xyz") for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(80)
    near = base.replace(base.split()[40], "changed", 1)
    rows = [(1, None), (2, ""), (3, "  \n"), (4, base), (5, base.upper()), (6, near), (6, near), (7, text(20_000)), (8, "one"), (9, "ONE"), (10, "two words"), (None, base), (None, None), (11, text(30)), (12, "é ü ￿ 😀 \t x"), (13, base + "\n" + text(3))]
    return spark.createDataFrame([(i, t, "k", 0.5) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
