import random

import pytest

SYLLABLES = "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no".split()


def prose(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, part string, band int, `key` string, word string, base string, found int"


@pytest.fixture
def docs(spark):
    """Make a documents table, with extra columns whose names the operators use themselves."""

    def make(texts: dict | list, langs=None, sources=None):
        rows = list(texts.items()) if isinstance(texts, dict) else texts
        return spark.createDataFrame([(i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, f"src{(i or 0) % 3}"), len(t or ""), "x", "y", 1, "k", "w", "b", 2) for i, t in rows], SCHEMA)

    return make
