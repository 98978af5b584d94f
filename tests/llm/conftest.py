import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_tables import table, words  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, ties, repeated rows, nulls, empty and very long ones; a third of them one group."""
    rng = random.Random(5)
    base, out = words(rng, 120), []
    for i in range(30):
        out.append((i, words(rng, rng.choice([1, 2, 3, 4, 30, 200])), f"s{i % 4}"))
    for i in range(30, 50):
        w = base.split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        out.append((i, " ".join(w), "s0"))
    out += [(50 + i, base, "s0") for i in range(5)]
    out += [(60, None, None), (61, "", "s1"), (62, " \t\n ", "s1"), (63, words(rng, 20_000), "s2"), (64, "A  b\tC", "s2"), (65, "ab c", "s2"), (66, "é É ñ 日本語  x", "s3")]
    out += [(67, "same row", "s3")] * 3 + [(None, "no id", "s3"), (None, "no id either", None), (None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return table(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return table(spark, [])
