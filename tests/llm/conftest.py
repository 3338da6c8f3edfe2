from __future__ import annotations

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


@pytest.fixture(scope="session")
def texts():
    """Awkward documents: (doc_id, text, source, and columns whose names clash with those of operators)."""
    draw = random.Random(3)
    prose = lambda n: " ".join(draw.choice(WORDS) for _ in range(n))
    base = prose(60)
    rows = [(i, prose(draw.randint(1, 80)), f"s{i % 4}") for i in range(40)]
    rows += [(100, base, "s0"), (101, base, "s0"), (102, base.upper(), "s1"), (103, base + " end", "s1")]
    rows += [(200, None, "s2"), (201, "", "s2"), (202, " \t\n ", None), (None, prose(20), None), (None, None, "s3")]
    rows += [(300, prose(30_000), "s1"), (301, "x" * 50_000, "s3"), (302, "dup row", "s0"), (302, "dup row", "s0")]
    rows += [(303, "日本 テキスト 🙂 ▁mark  two", "s0"), (304, "<|endoftext|> a<|endoftext|>", "s2")]
    return [(*r, 1, 2, 3, "k", 4) for r in rows]


SCHEMA = "doc_id long, text string, source string, score int, key int, size int, extra string, slot int"


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(texts, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
