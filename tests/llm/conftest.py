"""Fixtures with awkward rows: nulls, empty and long texts, copies, clashing columns."""

import random

import pytest


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "alpha", "beta", "Gamma", "Δx", "ñu", "it,", "end."]) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(3)
    shared, out = words(rng, 40), []
    for k in range(40):
        body = words(rng, rng.choice([3, 12, 30, 120]))
        out.append((k, f"{body}\n{shared if k % 3 == 0 else words(rng, 9)}\n{words(rng, 5)}"))
    copies = [(100 + k, out[6][1]) for k in range(30)]
    near = [(200 + k, out[9][1] + f" tail{k}") for k in range(8)]
    odd = [(300, None), (301, ""), (302, " \t\n "), (303, "x" * 70_000), (304, words(rng, 3000)), (305, "12 !! 34"), (None, out[6][1])]
    return out + copies + near + odd


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "src1", len(t or ""), "clash", True) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, row boolean")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
