import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "size long, target double, kept boolean, stays int, component_id long, score string, rank int, name string"


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and blank texts, a very long text, copies, repeated
    rows, and columns named like results."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["Élan", "über", "<|endoftext|>", "áb", "日本", "it's."]
    base = sentence(rng, 120, words)
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (3, " \n\t ", "en", "a", 4),
        (4, base, "en", "a", 1),
        (5, base, "en", "b", 1),
        (5, base, "en", "b", 1),
        (6, base.upper(), None, None, None),
        (None, base, None, None, None),
        (None, None, None, None, None),
        (7, sentence(rng, 60_000, words), "de", "b", 5),
        (8, "x" * 200_000, "de", None, 5),
        (9, "one two", "en", "a", 7),
        (10, "12 34 !!", "en", "c", 8),
        (11, "line one here\nline one here\n\nline one here", "en", "c", 8),
    ]
    rows += [(20 + i, sentence(rng, 30 + 3 * i, words), "en", f"s{i % 4}", i) for i in range(40)]
    extra = (1, 2.0, None, 3, 4, "s", 5, "n")
    return spark.createDataFrame([(*r, *extra) for r in rows], f"{SCHEMA}, {CLASHING}")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
