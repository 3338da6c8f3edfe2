"""What grows with the input is neither broadcast nor sent many times."""

from __future__ import annotations

from test_suggestions import distance

from corpusloom.functions import text as X
from corpusloom.operators import nearest, refs, search, textindex


def test_search_in_an_index_broadcasts_nothing_that_grows_with_it(spark, tmp_path, monkeypatch):
    rows = [(i, f"r{i % 3}" if i % 5 else None, f"p{i:02}", 1, f"alpha w{i} v{i % 4}", None) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id long, repo_id string, path string, start_line int, content string, symbol string")
    asked = spark.createDataFrame([(1, None, "alpha w7"), (2, "r1", "v2 none"), (3, None, "w11 w11 v3")], "query_id int, repo_id string, text string")
    for kind, tokens in ((search.overlap_search, X.code_tokens), (search.bm25_search, X.indexed_tokens)):
        index = textindex.write_index(chunks, str(tmp_path / kind.__name__), tokens, size=7)
        out = {}
        for most in (100_000, 0):
            monkeypatch.setattr(textindex, "SENT_TOKENS", most)
            found = kind(asked, index, 4)
            plan = found._jdf.queryExecution().sparkPlan().toString()
            # Only the distinct asked tokens may be sent, and not if there are too many.
            sent = [line for line in plan.splitlines() if "Broadcast" in line]
            assert len(sent) == (1 if most else 0) and all("LeftSemi" in line for line in sent), sent
            out[most] = sorted(tuple(r) for r in found.collect())
        assert out[0] == out[100_000] and [r[1] for r in out[0] if r[0] == 1 and r[-1] == 1] == [7]


def test_words_are_sent_once_per_large_block_of_asked_ones(spark, monkeypatch):
    monkeypatch.setattr(nearest, "WORDS", 25)
    monkeypatch.setattr(nearest, "ASKED", 8)
    monkeypatch.setattr(nearest, "GROUP_WORDS", 60, raising=False)
    monkeypatch.setattr(nearest, "GROUP_ASKED", 40, raising=False)
    monkeypatch.setattr(nearest, "GROUPS", 1, raising=False)
    kind = type(spark.range(1))
    sent, old = [], kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda df, *a: sent.append(df) or old(df, *a))
    names = [f"{k}_{i}" for i in range(40) for k in ("top", "Top", "model", "run")]
    rows = lambda values: spark.createDataFrame([("r", v) for v in values] + [("s", "only"), (None, "x")], "repo_id string, name string")
    found = refs.similar_symbols(rows([n.replace("e", "") for n in names]), rows(names), 3, 2)
    got = {}
    for r in found.collect():
        got.setdefault((r["repo_id"], r["asked"]), []).append((r["rank"], r["distance"], r["name"]))
    assert got.pop(("s", "only")) == [(1, 0, "only")]
    for n in names:
        asked = n.replace("e", "")
        near = sorted((d, w) for w in set(names) if (d := distance(asked.lower(), w.lower())) <= 2)[:3]
        assert sorted(got["r", asked]) == [(i, d, w) for i, (d, w) in enumerate(near, 1)]
    # 120 words in lower case, and as many asked ones: 2 blocks and some 4, not 5 and 15.
    words = next(df for df in sent if "word" in df.columns).where("repo_id = 'r'")
    assert words.count() <= 120 * 6 and words.select("_words_no").distinct().count() <= 2
