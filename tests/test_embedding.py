"""Embeddings: right on long and odd texts, with work that grows with the vector and not with its square."""

from __future__ import annotations

import hashlib
import math
import time
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.operators import embed


def test_length_of_a_vector_is_worked_out_once(spark):
    row = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda x: x.cast("double")).alias("v"))
    start = time.time()
    unit = row.select(embed.normalised(F.col("v")).alias("u")).first()["u"]
    assert time.time() - start < 15
    assert math.isclose(sum(x * x for x in unit), 1.0) and len(unit) == 40_000


def test_weights_count_the_tokens_of_each_bucket(spark):
    texts = {1: " ".join(f"w{i}" for i in range(300)), 2: "", 3: None, 4: "one", 5: "a b a B"}
    found = {}
    rows = spark.createDataFrame(list(texts.items()), "id int, text string")
    for r in embed.hashing_weights(rows, "id", 8).collect():
        found.setdefault(r["id"], {})[r["bucket"]] = r["weight"]
    tokens = {1: {"w", *[f"w{i}" for i in range(300)], *map(str, range(300))}, 4: {"one"}, 5: {"a", "b"}}
    for key, words in tokens.items():
        counts = Counter(int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "little") % 8 for w in words)
        size = math.sqrt(sum(n * n for n in counts.values()))
        assert found[key].keys() == counts.keys() and all(math.isclose(found[key][b], n / size) for b, n in counts.items())
    assert found.keys() == tokens.keys()
    dense = {r["id"]: r["embedding"] for r in embed.hashing_embeddings(rows, "id", 8).collect()}
    assert dense[2] == [0.0] * 8 and all(dense[1][b] == w for b, w in found[1].items())
