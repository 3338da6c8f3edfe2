"""Words within some changes of another: all that brute force finds, and nothing else."""

from __future__ import annotations

import random

import numpy as np
import pytest

from corpusloom.operators import nearest, refs


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(draw: random.Random, word: str, times: int) -> str:
    for _ in range(times):
        at = draw.randrange(len(word) + 1)
        word = word[:at] + draw.choice(["", "a", "é", "/"]) + word[at + draw.randrange(2) :]
    return word


@pytest.mark.parametrize("edits", [0, 1, 3])
def test_within_edits_equals_brute_force(spark, edits):
    draw = random.Random(edits)
    words = ["", "a", "ab", "src/app/main.py", "long/" * 40] + ["".join(draw.choices("ab/é", k=draw.randrange(14))) for _ in range(150)]
    asked = ["", "b", "z" * 30] + [changed(draw, w, draw.randrange(5)) for w in words for _ in range(2)]
    rows = lambda values, name: spark.createDataFrame([("r", v) for v in values] + [("other", "ab"), (None, "a"), ("r", None)], f"repo_id string, {name} string")
    found = refs.within_edits(rows(asked, "asked"), rows(words, "word"), edits).collect()
    want = {("r", a, w, distance(a, w)) for a in set(asked) for w in set(words) if distance(a, w) <= edits} | {("other", "ab", "ab", 0)}
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_three_letters_wrong_in_files_and_symbols(spark):
    files = spark.createDataFrame([("r", "src/payment_service.py"), ("r", "lib/Payment_Service.py"), ("r", "src/other.py")], "repo_id string, path string")
    lost = spark.createDataFrame([("r", "src/paiment_servise.pi")], "repo_id string, path string")
    assert [r["path"] for r in refs.suggestions(lost, files, edits=3).orderBy("rank").collect()] == ["src/payment_service.py", "lib/Payment_Service.py"]
    assert refs.suggestions(lost, files).count() == 0
    symbols = spark.createDataFrame([("r", "loadSettings"), ("r", "LoadSettings"), ("r", "save")], "repo_id string, name string")
    asked = spark.createDataFrame([("r", "lodSetings")], "repo_id string, name string")
    found = refs.similar_symbols(asked, symbols).orderBy("rank").collect()
    assert [(r["name"], r["distance"]) for r in found] == [("LoadSettings", 2), ("loadSettings", 2)]


def test_trie_finds_what_brute_force_finds():
    draw = random.Random(7)
    words = ["", "ab"] + [f"src/pkg{i % 3}/mod_{i}.py" for i in range(150)] + ["".join(draw.choices("ab/é", k=draw.randrange(9))) for _ in range(60)]
    asked = sorted({changed(draw, w, draw.randrange(4)) for w in words[::4]})
    trie = nearest.Trie(words)
    for edits, k in ((2, None), (3, 2), (None, 3)):
        order = np.arange(len(trie.words))[::-1]
        got = trie.within(asked, edits) if k is None else trie.nearest(asked, edits, k, order)
        want = set()
        for a in asked:
            near = sorted((distance(a, w), -i, w) for i, w in enumerate(trie.words) if edits is None or distance(a, w) <= edits)
            want |= {(a, w, d) for d, _, w in near[:k]}
        rows = [(asked[i], trie.words[j], int(d)) for i, j, d in zip(*got)]
        assert len(rows) == len(want) and set(rows) == want


def test_words_and_asked_ones_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "WORDS", 20)
    monkeypatch.setattr(nearest, "ASKED", 7)
    monkeypatch.setattr(nearest, "PAIRS", 50)
    words = [f"dir/mod_{i}.py" for i in range(90)]
    asked = [w.replace("o", "0") for w in words[::3]]
    rows = lambda values, name: spark.createDataFrame([("r", v) for v in values], f"repo_id string, {name} string")
    found = refs.within_edits(rows(asked, "asked"), rows(words, "word"), 2).collect()
    want = {("r", a, w, distance(a, w)) for a in asked for w in words if distance(a, w) <= 2}
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_frequent_base_name_makes_no_row_per_pair(spark, monkeypatch):
    """300 files of one name, each asked for: their nearest paths, without a row for each of 90,000 pairs."""
    paths = [f"web/c{i}/index.ts" for i in range(300)]
    files = spark.createDataFrame([("r", p) for p in [*paths, paths[0]]], "repo_id string, path string")
    lost = spark.createDataFrame([("r", p.replace("index", "xindex")) for p in paths] + [("r", "zz/index.ts")], "repo_id string, path string")
    out = refs.suggestions(lost, files)
    got = {}
    for r in out.collect():
        got.setdefault(r["asked"], []).append((r["distance"], r["path"]))
    for asked in ("web/c0/xindex.ts", "web/c17/xindex.ts", "web/c299/xindex.ts", "zz/index.ts"):
        assert sorted(got[asked]) == sorted((distance(asked, p), p) for p in [*paths, paths[0]])[:3]
    assert len(got) == 301
    sizes = []
    monkeypatch.setattr(refs, "top_k", lambda df, *rest: sizes.append(df.count()) or df)
    refs.suggestions(lost, files)
    assert sizes[0] < 90_000 / 3
