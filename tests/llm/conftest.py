import os
import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("driver test data not present")
    return SF


def some_words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows with copies, near copies, nulls, empties, long texts, repeated rows."""
    rng = random.Random(5)
    base = [" ".join(some_words(rng, rng.randrange(1, 120))) for _ in range(40)]
    line = "This Very Same Boilerplate Line is everywhere"
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[3]) for i in range(5)]                                # exact copies
    rows += [(120 + i, base[4].replace("w1", "W1", 1) + " tail" * i) for i in range(4)]  # near copies
    rows += [(140 + i, f"{base[i]}\n  {line.upper() if i % 2 else line}\t\n{base[i + 1]}") for i in range(6)]
    rows += [(160, None), (161, ""), (162, " \n\t "), (163, "é" * 30 + "\nÉÉ"), (164, "a"), (165, "a b")]
    rows += [(170, " ".join(some_words(rng, 6000))), (171, "x" * 50_000), (172, "\n" * 300)]
    rows += [(0, base[0]), (100, base[3])]                                        # repeated rows
    rows += [(180 + i, "short\nline thirty characters long xx\nshort") for i in range(3)]
    return rows


SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


#: Extra columns whose names operators might use themselves.
CLASHES = ["fp", "row", "score", "hash", "shard", "n", "items", "token", "h1", "component", "salt", "words", "id",
           "pos", "n_words", "n_lines", "kept", "spans"]


@pytest.fixture(scope="session")
def wide(docs):
    from pyspark.sql import functions as F
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
