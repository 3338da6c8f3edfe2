"""Keyword search on a stored index against scores worked out for every chunk."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from corpusloom.functions import text as X
from corpusloom.operators import search, textindex

WORDS = "get_value parseJSON httpServer alpha beta gamma delta v2 HTTPError the of x1y2 Read_me".split()
CHUNKS = "chunk_id string, repo_id string, path string, start_line int, content string, symbol string"
BOOST = (1.0, 3.0, 2.0)


def parts(word):
    return [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+", word)]


def query_words(text):
    words = re.findall("[A-Za-z0-9]+", text or "")
    return {w.lower() for w in words} | {p for w in words for p in parts(w)}


def index_words(text):
    words = re.findall("[A-Za-z0-9_]+", text or "")
    mixed = [w for w in words if re.search("_|[a-z][A-Z]|[A-Z][A-Z][a-z]|[A-Za-z][0-9]|[0-9][A-Za-z]", w)]
    return [w.lower() for w in words] + [p for w in mixed for p in parts(w)]


def rows():
    draw = random.Random(11)
    some = lambda n: " ".join(draw.choice(WORDS) for _ in range(n))
    out = []
    for i in range(180):
        repo = draw.choice(["a", "a", "a", "b", None, ""])
        symbol = draw.choice([None, "", draw.choice(WORDS)])
        out.append((f"c{i}", repo, f"dir{i % 5}/{draw.choice(WORDS)}.py", i % 7, draw.choice([None, "", some(draw.randint(1, 40))]), symbol))
    return out


QUERIES = [(1, "a", "parse the JSON value"), (2, None, "gamma delta http server"), (3, "b", "of"), (4, "", "beta x1y2"), (5, "none", "alpha"), (6, "a", ""), (7, None, "v2 Read_me the"), (8, "a", None)]


def slow(kind, k):
    chunks = rows()
    lists = {r[0]: [index_words(t) if kind == "bm25" else sorted(query_words(t)) for t in (r[4], r[5], r[2])] for r in chunks}
    docs, total, df = Counter(), Counter(), Counter()
    for r in chunks:
        for f, ts in enumerate(lists[r[0]]):
            docs[r[1], f] += bool(ts)
            total[r[1], f] += len(ts)
            for t in set(ts):
                df[r[1], f, t] += 1
    out = []
    for query, repo, text in QUERIES:
        hits = []
        for r in chunks:
            if repo is not None and r[1] != repo:
                continue
            score = 0.0
            for f, ts in enumerate(lists[r[0]]):
                for t in query_words(text) & set(ts):
                    if kind == "overlap":
                        score += BOOST[f]
                        continue
                    idf = math.log(1 + (docs[r[1], f] - df[r[1], f, t] + 0.5) / (df[r[1], f, t] + 0.5))
                    n, mean = ts.count(t), total[r[1], f] / docs[r[1], f]
                    score += BOOST[f] * idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ts) / mean))
            if round(score, 6) > 0:
                hits.append((-round(score, 6), r[2], r[3], r[0]))
        out += [(query, rank, h[3], -h[0]) for rank, h in enumerate(sorted(hits)[:k], 1)]
    return out


@pytest.mark.parametrize("kind,first", [("overlap", 1), ("overlap", 16), ("bm25", 1), ("bm25", 16)])
def test_stored_index_against_every_chunk(spark, tmp_path, kind, first):
    tokens = X.code_tokens if kind == "overlap" else X.indexed_tokens
    chunks = spark.createDataFrame(rows(), CHUNKS).repartition(3)
    path = str(tmp_path / "index")
    textindex.write_index(chunks.where("start_line < 4"), path, tokens, size=16)
    index = textindex.write_index(chunks.where("start_line >= 4"), path, tokens, add=True, size=16)
    assert index.lengths.selectExpr("sum(size(at))").first()[0] == 180
    asked = spark.createDataFrame(QUERIES, "query_id long, repo_id string, text string")
    out = textindex.search(asked, textindex.open_index(spark, path), 5, kind, first_units=first).collect()
    got = sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in out)
    want = slow(kind, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-6)


def test_units_that_cannot_reach_the_top_are_left_out(spark, tmp_path, monkeypatch):
    many = [(f"c{i}", "a", f"p{i:04}", 1, "common " * (1 + i % 3) + ("rare " * 5 if i < 20 else ""), None) for i in range(400)]
    index = textindex.write_index(spark.createDataFrame(many, CHUNKS).coalesce(1), str(tmp_path / "i"), size=20)
    asked = spark.createDataFrame([(1, "a", "rare common")], "query_id long, repo_id string, text string")
    seen = []
    real = textindex._saved

    def watched(df, name):
        out = real(df, name)
        if name == "later-units":
            seen.append(out.count())
        return out

    monkeypatch.setattr(textindex, "_saved", watched)
    out = textindex.search(asked, index, 5, "bm25", first_units=1).collect()
    assert {int(r.chunk_id[1:]) < 20 for r in out} == {True} and len(out) == 5
    assert seen == [0]


def test_search_takes_rows_or_an_index_and_empty_inputs(spark):
    chunks = spark.createDataFrame(rows(), CHUNKS)
    asked = spark.createDataFrame(QUERIES, "query_id long, repo_id string, text string")
    by_rows = sorted(map(tuple, search.overlap_search(asked, chunks, 5).collect()))
    assert [(r[0], r[-1], r[1]) for r in sorted(by_rows, key=lambda r: (r[0], r[-1]))] == [w[:3] for w in slow("overlap", 5)]
    assert search.bm25_search(asked.limit(0), chunks).count() == 0
    assert search.bm25_search(asked, chunks.limit(0)).count() == 0


def test_a_segment_is_bounded_by_its_tokens(spark):
    rows = [(i, "r", f"p{i:02}", 1, " ".join(f"w{j}" for j in range(50 if i % 7 else 400)), "") for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id long, repo_id string, path string, start_line int, content string, symbol string").coalesce(1)
    index = textindex.segments(chunks, X.indexed_tokens, most=300)
    held = index.where("token IS NULL").selectExpr("aggregate(content, 0, (a, x) -> a + x) + aggregate(path, 0, (a, x) -> a + x) AS words", "size(at) AS n").collect()
    assert sum(r["n"] for r in held) == 40 and all(r["words"] <= 300 or r["n"] == 1 or r["words"] <= 300 + 401 for r in held) and len(held) > 8
