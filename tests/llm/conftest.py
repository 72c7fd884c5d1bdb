import random

import pytest

DOCS = "doc_id long, text string, lang string, id long, fp string"


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, nulls and runs."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    passages = [" ".join(rnd.choice(words) for _ in range(rnd.randint(30, 70))) for _ in range(6)]
    rows = []
    for i in range(160):
        parts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))]
        if rnd.random() < 0.4:
            parts.insert(rnd.randint(0, 1), rnd.choice(passages))
        if rnd.random() < 0.05:
            parts.append("ab" * rnd.randint(90, 200))
        rows.append((i, rnd.choice(["\n", " ", "\r\n"]).join(parts)))
    for i in range(160, 230):                           # copies and near copies
        text = rows[rnd.randint(0, 8)][1].split(" ")
        for _ in range(rnd.randint(0, 2)):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        rows.append((i, " ".join(text)))
    return [*rows, (230, None), (231, ""), (232, "x" * 5000), (233, "\n\n"), (234, "Ünï é"), (None, passages[0]),
            (rows[3][0], rows[3][1])]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With clashing extra columns."""
    return spark.createDataFrame([(i, t, None, 7, "x") for i, t in corpus], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


class Sets:
    """Union-find for the brute-force versions."""

    def __init__(self, n):
        self.p = list(range(n))

    def root(self, x):
        while self.p[x] != x:
            self.p[x] = self.p[self.p[x]]
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.p[max(a, b)] = min(a, b)


@pytest.fixture
def sets():
    return Sets
