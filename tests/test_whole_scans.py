"""Grep and run scripts leave nothing out by default."""

from __future__ import annotations

import json

from corpusloom import fixed
from corpusloom.operators import manifests, tools


def test_grep_reads_the_whole_repository(spark):
    files = [("r", "a", "x" * 31_000_000), ("r", "b", "a hit")]
    found = tools.grep(spark.createDataFrame(files, "repo_id string, path string, text string"), "hit").collect()
    assert [(r.path, r.line) for r in found] == [("b", "a hit")]


def test_run_scripts_are_whole(spark):
    text = json.dumps({"scripts": {f"s{i:03}": "c" * 300 for i in range(60)}})
    rows = spark.createDataFrame([("r", "package.json", text)], "repo_id string, path string, text string")
    got = manifests.run_scripts(rows).collect()
    assert len(got) == 60 and {len(r.command) for r in got} == {300}
    assert sorted(r.position for r in got) == list(range(1, 61))
    few = manifests.run_scripts(rows, npm_scripts=fixed.MAX_NPM_SCRIPTS, max_scripts=5, command_chars=7).collect()
    assert len(few) == 5 and {len(r.command) for r in few} == {7}
