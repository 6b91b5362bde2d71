import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("row_key", T.StringType()), ("score", T.StringType()))])


def words(rng, n):
    return [rng.choice("ba be bi bo bu da de di do du fa fe fi fo fu ga ge".split()) + rng.choice("lo mo no ro so to".split()) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and long texts, copies, near copies, shared passages, repeated rows and ids."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 60))
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "two words"), (5, "Ünïcode ß 日本 😀 text")]
    base = words(rng, 120)
    rows += [(10 + i, " ".join(base)) for i in range(4)]
    for i in range(12):
        near = list(base)
        for _ in range(i):
            near[rng.randrange(len(near))] = f"x{rng.random()}"
        rows.append((20 + i, " ".join(near)))
    rows += [(40 + i, " ".join(words(rng, 30)) + " " + passage + " " + " ".join(words(rng, 30))) for i in range(5)]
    rows += [(50, " ".join(words(rng, 3000))), (51, "ab " * 2000), (52, "z" * 5000), (None, passage), (None, None)]
    rows += [(60, " ".join(words(rng, 50)))] * 3 + [(61, "same id, first text"), (61, "same id, second text")]
    rows += [(100 + i, " ".join(words(rng, rng.randrange(1, 200)))) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "clash", "clash") for i, t in corpus], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
