"""Vector search on a stored index against the cosines of all rows."""

from __future__ import annotations

import numpy as np
import pytest

from corpusloom.operators import search, vectorindex

CHUNKS = "chunk_id string, repo_id string, embedding array<double>"
QUERIES = "query_id long, repo_id string, vector array<double>"


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(5)
    middles = draw.standard_normal((9, 12)) * 2
    out = [(f"c{i:04}", "ab"[i % 7 == 0], (middles[i % 9] + draw.standard_normal(12)).tolist()) for i in range(900)]
    out += [("z1", "a", [0.0] * 12), ("n1", "a", None), ("e1", "a", []), ("r1", None, [1.0] * 12), ("t1", "b", out[0][2]), ("t2", "b", out[0][2])]
    asked = [(i, "ab"[i % 3 == 0], (middles[i % 9] + draw.standard_normal(12)).tolist()) for i in range(40)]
    return out, [*asked, (90, "a", [0.0] * 12), (91, None, [1.0] * 12), (92, "none", [1.0] * 12), (93, "a", None), (94, "b", out[0][2])]


def slow(chunks, queries, k):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    out = []
    for q, repo, v in queries:
        if repo is None or not v:
            continue
        hits = sorted((-round(float(unit(v) @ unit(x)), 9) + 0.0, c) for c, r, x in chunks if r == repo and x)
        out += [(q, rank, c) for rank, (_, c) in enumerate(hits[:k], 1)]
    return out


@pytest.mark.parametrize("first", [1, 50])
def test_exact_search_against_all_rows(spark, tmp_path, rows, first):
    chunks, queries = spark.createDataFrame(rows[0], CHUNKS).repartition(3), spark.createDataFrame(rows[1], QUERIES)
    vectorindex.write_index(chunks, str(tmp_path / "v"))
    index = vectorindex.open_index(spark, str(tmp_path / "v"))
    assert index.vectors.count() == 903 and index.cells.where("repo_id = 'a'").count() > 20
    out = vectorindex.search(queries, index, 7, first_cells=first).collect()
    assert sorted((r.query_id, r.rank, r.chunk_id) for r in out) == slow(*rows, 7)


def test_cells_out_of_reach_are_not_measured(spark, rows):
    near = [(f"c{i}", "a", [1.0, i / 1e4, 0.0]) for i in range(200)] + [(f"d{i}", "a", [0.0, i / 1e4, 1.0]) for i in range(200)]
    index = vectorindex.write_index(spark.createDataFrame(near, CHUNKS))
    asked = spark.createDataFrame([(1, "a", [1.0, 0.0, 0.0])], QUERIES)
    units = vectorindex._units(asked.withColumnRenamed("vector", "unit"), index.cells)
    assert units.where("bound >= 0.9").count() < 0.7 * units.count()
    out = vectorindex.search(asked, index, 3, first_cells=2).orderBy("rank").collect()
    assert [r.chunk_id for r in out] == ["c0", "c1", "c2"]


def test_probe_lists_reach_nine_tenths(spark, rows):
    chunks, queries = spark.createDataFrame(rows[0], CHUNKS), spark.createDataFrame(rows[1][:40], QUERIES)
    index = vectorindex.write_index(chunks)
    found = {(r.query_id, r.chunk_id) for r in search.approximate_search(queries, index, 10, probes=8).collect()}
    want = {(q, c) for q, _, c in slow(rows[0], rows[1][:40], 10)}
    assert len(found & want) >= 0.9 * len(want)
    assert len({(r.query_id, r.chunk_id) for r in search.approximate_search(queries, index, 10, probes=1).collect()} & want) < len(want)


def test_empty_inputs(spark, rows):
    chunks, queries = spark.createDataFrame(rows[0], CHUNKS), spark.createDataFrame(rows[1], QUERIES)
    assert search.vector_search(queries, chunks.limit(0), 5).count() == 0
    assert search.vector_search(queries.limit(0), chunks, 5).count() == 0
