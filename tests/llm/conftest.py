import random

import pytest

DOCS = "doc_id long, text string, source string, n_tokens string, start string, size string, rule string"


def rows_of(texts, sources=None):
    """Documents with extra columns whose names clash with results."""
    return [(k, t, (sources or {}).get(k, f"s{k % 3}"), "x", "y", "z", "w") for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    def make(texts, sources=None, ids=None):
        rows = rows_of(texts, sources)
        if ids:
            rows = [(i, *r[1:]) for i, r in zip(ids, rows, strict=True)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    rng = random.Random(5)
    pool = ["the", "Café", "don't", "x1", "  ", "\n", "\t", " ", "　", "a.b", "<|endoftext|>", "naïve,", "漢字", "\U0001f600", "ß", "é", "\x00"]
    texts = [None, "", " ", "a", "<|startoftext|>", "\x1c \x1d"]
    texts += ["".join(rng.choices(pool, k=rng.randint(1, 25))) for _ in range(150)]
    texts += ["word " * 6000, "a" * 5000]
    return texts + texts[10:20]
