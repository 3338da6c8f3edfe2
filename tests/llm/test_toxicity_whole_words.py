"""Toxic terms far inside long words."""

from __future__ import annotations

import pytest

from corpusloom.llm import toxicity


@pytest.mark.parametrize("filler", ["x", "日本", "well-", "a\u00a0b"])
def test_a_term_at_the_end_of_a_long_word_counts(spark, filler):
    token = (filler * 10_000)[:10_000]
    rows = [(1, token + "vilewort"), (2, token), (3, "vilewort")]
    model = toxicity.Model({b"lewor": 5.0}, [1.0, 9.0])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.rejected for r in toxicity.graded_documents(docs, model).collect()}
    assert got == {1: True, 2: False, 3: True}
    assert [r.doc_id for r in toxicity.without_toxic(docs, model).collect()] == [2]


def test_long_words_are_learned_whole_and_not_remembered(spark):
    token = "x" * 10_000
    rows = [(token + "vilewort" if i % 2 else token, i % 2) for i in range(20)]
    found = toxicity.selected(spark.createDataFrame(rows, "text string, toxic int"))
    assert b"ewort" in {bytes(r.feature) for r in found.collect()}
    memo = toxicity._Uses({b"ewort": 0})
    assert memo[token.encode() + b"vilewort"] == (0,) and memo[b"vilewort"] == (0,)
    assert list(memo) == [b"vilewort"]
