import random

import pytest

ODD = [(None, None), (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, "Ünïcode — ßtraße naïve   x")]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, repeated rows and columns whose names the operators use inside."""
    rows = [(i, t, "x", 1.0, None) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, _id string, fp double, count int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


@pytest.fixture(scope="session")
def words():
    r = random.Random(5)
    pool = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(300)]
    return lambda n, seed: [random.Random(seed).choice(pool) for _ in range(n)] if n < 2 else [x for rr in [random.Random(seed)] for x in rr.choices(pool, k=n)]
