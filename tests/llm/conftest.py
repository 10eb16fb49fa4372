import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, fp long, bucket int, shard int, row string, page_id string"


def corpus():
    """(doc_id, text): nulls, empty and very long texts, ties, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(60)
    docs = [(0, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, "One"), (4, "one two"), (5, "ONE TWO three"), (6, "one two three")]
    docs += [(10 + i, text(80)) for i in range(12)]
    docs += [(30 + i, docs[8][1]) for i in range(6)]
    docs += [(40 + i, docs[9][1] + f" tail{i}") for i in range(6)]
    docs += [(50 + i, text(20) + " " + passage + "\n" + text(20)) for i in range(6)]
    docs += [(60, text(9000)), (61, "x" * 5000), (62, "é" * 40 + " ß 日本語 \U0001f600 \x85 \xa0a"), (63, "lo\nlo\nlo\n\n \nlo lo lo lo lo lo"), (64, "a, b; c! <|endoftext|> don't  I'LL\r\nx\ty ")]
    docs += [(70, docs[20][1]), (70, docs[20][1]), (None, text(70)), (None, passage + " end"), (None, None), (2**40, text(50)), (-5, text(50) + " " + passage)]
    return docs


@pytest.fixture(scope="session")
def docs():
    return corpus()


@pytest.fixture(scope="session")
def frame(spark, docs):
    """The corpus with further columns whose names the operators use themselves."""
    rows = [(i, t, "en", "host%d" % (n % 3) if n % 7 else None, len(t or ""), "w", 1, 2, 3, "r", "p") for n, (i, t) in enumerate(docs)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def multiset():
    return lambda rows: sorted(map(tuple, rows), key=repr)
