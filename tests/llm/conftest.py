import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows of the shape of documents; further columns by name."""

    def make(rows, extra=""):
        full = [(i, t, *rest) if rest else (i, t, "en", "s", len(t or "")) for i, t, *rest in rows]
        return spark.createDataFrame(full, COLUMNS + extra)

    return make


@pytest.fixture(scope="session")
def prose():
    """prose(seed, n): n invented words."""

    def make(seed, n, syllables=("ka", "lo", "mi", "ren", "tu", "sha", "bo", "ve")):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))

    return make
