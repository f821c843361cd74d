import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, spans string, s1 long, row string, TEXT string, __x int, __key string, __may boolean, c1 string, more string"


def frame(spark, pairs):
    """Documents with extra columns whose names clash with the operators' own, in upper and lower case too."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), 1, "k", "s", 2, "r", "T", 3, "y", False, "c", "m") for i, t in pairs], SCHEMA)


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, "three little words"), (7, "three little words"), (7, "three little words"),
    (8, "x" * 30_000), (9, "a b " * 20_000), (10, "é ü 한가 İSTANBUL ½ \x1c end"), (11, "<|endoftext|> it's don't 'll"),
]


@pytest.fixture
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def prose():
    """Families of near copies at all distances, exact copies, and unrelated texts with a common line."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(r.choice(words) for _ in range(12))
    out, doc = [], 0
    for family in range(12):
        base = [r.choice(words) for _ in range(r.choice([4, 30, 60, 120, 240]))]
        for _ in range(r.choice([1, 2, 5, 14])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                own[r.randrange(len(own))] = r.choice(words)
            out.append((doc * 7 % 1009, " ".join(own)))
            doc += 1
    for _ in range(40):
        out.append((doc * 7 % 1009, line + "\n" + " ".join(r.choice(words) for _ in range(r.randrange(1, 40)))))
        doc += 1
    return out
