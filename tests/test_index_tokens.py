"""An index for one batch of queries: tokens cut in Arrow, and only asked ones kept."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import words as W
from corpusloom.operators import textindex

TEXTS = ["getUserById HTTPServer2 abc", "", "abc", "Abc-ABC_aB12 é9aé İK k", "  ", "x", "ABCd 007bond 7 fooBARbaz", "ends1", "2starts ſ \x00a\nb"]


def _by_row(texts):
    tokens, row, code = W.code_token_pairs(texts)
    out = [set() for _ in range(len(texts))]
    for r, c in zip(row.tolist(), code.tolist(), strict=True):
        out[r].add(tokens[c].as_py())
    assert sum(map(len, out)) == len(row)
    return out


def test_words_cut_in_arrow_are_code_tokens(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", X.code_tokens(F.col("t")).alias("ts"))
    want = [set(r["ts"]) for r in sorted(frame.collect())]
    assert _by_row(pa.array(TEXTS)) == want
    assert _by_row(pa.array(["zz", *TEXTS, "q"]).slice(1, len(TEXTS))) == want
    assert _by_row(pa.array([], pa.string())) == [] and _by_row(pa.array(["", ""])) == [set(), set()]


def test_slices_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(W, "SLICE_BYTES", 10)
    got = list(W.text_slices([pa.array(["a" * 8, "b" * 30, "", "c", "d" * 9]), pa.array(["x", "", "", "y", ""])]))
    assert [i for a, b in got for i in range(a, b)] == list(range(5)) and len(got) > 2


def test_segments_hold_asked_tokens_only(spark):
    rows = [(i, f"r{i % 3}" if i % 4 else None, f"p{i}", 1, " ".join(f"w{i}x{j}" for j in range(50)) + " common", None) for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id long, repo_id string, path string, start_line int, content string, symbol string")
    for tokens in (X.code_tokens, X.indexed_tokens):
        for asked, repos in (([("r1", "common"), ("r1", "none")], {"r1"}), ([(None, "common"), ("r2", "none")], {None, "r0", "r1", "r2"})):
            asked = spark.createDataFrame(asked, "repo_id string, token string")
            got = textindex.segments(chunks, tokens, asked=asked).collect()
            whole = textindex.segments(chunks, tokens).collect()
            summed = [{}, {}]
            for into, index in zip(summed, (got, whole), strict=True):
                for r in index:
                    if r["token"] is None:
                        into[r["repo_id"]] = into.get(r["repo_id"], 0) + sum(r["content"])
            assert summed[0] == summed[1] and set(summed[0]) == {None, "r0", "r1", "r2"}
            assert {r["repo_id"] for r in got if r["token"] == "common"} == repos
            # Each of 40 chunks has 50 words of its own and their parts; hardly one passes that isn't asked.
            assert len([r for r in got if r["token"] is not None]) < len([r for r in whole if r["token"] is not None]) / 10
