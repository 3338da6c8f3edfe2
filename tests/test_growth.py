"""Work that grows with the input: joins don't multiply what a result shows a few rows of."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import graph, ops, refs


def _spied(monkeypatch, module, name):
    """Frames that ``module.name`` returned."""
    made, old = [], getattr(module, name)

    def spy(*args, **kw):
        made.append(old(*args, **kw))
        return made[-1]

    monkeypatch.setattr(module, name, spy)
    return made


def test_symbol_lookup_meets_only_the_first_definitions(spark, monkeypatch):
    n = 300
    made = _spied(monkeypatch, refs, "salted_join")
    symbols = [("r", f"f{i:03}", name, kind, i, i + 1, parent) for i in range(n) for name, kind, parent in (("run", "method", f"M{i}"), ("Run", "function", None))]
    symbols = spark.createDataFrame(symbols, "repo_id string, path string, name string, kind string, start_line int, end_line int, parent string")
    asked = [(i, "r", f"M{i}.run") for i in range(n)] + [(n + i, "r", "run") for i in range(n)] + [(2 * n, "r", "RUN"), (2 * n + 1, "r", "no.Run"), (None, "r", "run"), (None, "r", "M7.run")]
    out = refs.symbol_lookup(spark.createDataFrame(asked, "request_id long, repo_id string, name string"), symbols, 3).collect()
    assert sum(df.count() for df in made) <= 3 * 3 * len(asked)
    got = {}
    for r in out:
        got.setdefault(r["request_id"], []).append((r["rank"], r["name"], r["path"], r["exact"]))
    assert all(got[i] == [(1, "run", f"f{i:03}", True)] for i in range(n))
    assert all(sorted(got[n + i]) == [(k + 1, "run", f"f00{k}", True) for k in range(3)] for i in range(n))
    assert sorted(got[2 * n]) == [(k + 1, "Run", f"f00{k}", False) for k in range(3)] == sorted(got[2 * n + 1])
    assert sorted(got[None]) == [(k + 1, "run", f"f00{k}", True) for k in range(3)]


def test_sweep_never_broadcasts_repositories(spark):
    jobs = spark.range(20).selectExpr("id AS job_id", "id % 3 AS repo_id", "'running' AS status", "CAST(NULL AS TIMESTAMP) AS heartbeat_at", "CAST(NULL AS TIMESTAMP) AS started_at", "TIMESTAMP '2000-01-01 00:00:00' AS created_at")
    repos = spark.range(2).selectExpr("id AS repo_id", "IF(id = 0, 'ready', 'failed') AS status")
    out = ops.swept_jobs(jobs, repos, F.expr("TIMESTAMP '2000-01-02 00:00:00'"))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["repo_id"], r["status"]) for r in out.collect()} == {(0, "done"), (1, "failed"), (2, "failed")}


def test_dependency_report_counts_importers_of_a_directory_once(spark, monkeypatch):
    n = 40
    files = [f"g/f{i:02}.go" for i in range(n)] + ["h/x.go"]
    edges = [("r", s, "g", False) for s in files] + [("r", "h/x.go", "g/f00.go", False), ("r", "i/y.go", "g/f00.go", False), ("r", "h/x.go", "fmt", True), ("r", "h/x.go", "g", False)]
    edges = spark.createDataFrame(edges, "repo_id string, src string, dst string, external boolean")
    targets = [("r", f, True) for f in files] + [("r", "g", False), ("r", "g/f00.go", False), ("r", "none", True), (None, "g/f00.go", True)]
    targets = spark.createDataFrame(targets, "repo_id string, module string, is_file boolean")
    whole = {}
    for r in graph.dependencies_of(targets, edges).collect():
        whole.setdefault((r["repo_id"], r["module"], r["relation"]), []).append(r["path"])
    made = _spied(monkeypatch, graph, "salted_join")
    got = graph.dependency_report(targets, edges, 5).collect()
    assert max(df.count() for df in made) < 4 * n
    assert len(got) == targets.count()
    for r in got:
        users = sorted(whole.get((r["repo_id"], r["module"], "users"), []))
        assert r["report"].endswith(f"\nImported by ({len(users)}): {', '.join(users[:5]) or 'nothing'}")


def test_mentions_cut_a_text_into_lines_before_the_join(spark, monkeypatch):
    seen, old = [], refs.skewed_join
    monkeypatch.setattr(refs, "skewed_join", lambda big, small, *a, **k: seen.append(small.dtypes) or old(big, small, *a, **k))
    texts = spark.createDataFrame([("r", "a", "x\r\nLOAD ΟΔΟΣ\nİ\n"), ("r", "b", None)], "repo_id string, path string, text string")
    claims = [("r", "a", 4, 4, "load"), ("r", "a", 5, None, "load"), ("r", "a", 1, 1, "ΟΔΟΣ"), ("r", "b", 1, 1, "x"), ("r", "c", 1, 1, "x"), ("r", "a", None, 1, "x")]
    claims = spark.createDataFrame(claims, "repo_id string, path string, start_line int, end_line int, name string")
    out = {(r["path"], r["start_line"]): r["mentioned"] for r in refs.with_mentions(claims, texts).collect()}
    assert out.pop(("a", 1)) is not None
    assert out == {("a", 4): True, ("a", 5): False, ("b", 1): None, ("c", 1): None, ("a", None): None}
    assert ("_lines", "array<string>") in seen[0]


def test_importers_of_a_directory_are_joined_last(spark):
    n = 30
    files = [f"g/f{i:02}.go" for i in range(n)]
    edges = [("r", s, "g", False) for s in [*files, "h/x.go"]] + [("r", "h/x.go", "g/f00.go", False), ("r", "i/y.go", "g/f00.go", False), ("r", "h/x.go", "fmt", True), ("r", None, "g", False)]
    targets = [("r", f, True) for f in files] + [("r", files[0], True), ("r", "g", False), ("r", "g/f00.go", False), ("r", "g/f00.go/z", False), (None, "g/f01.go", True)]
    out = graph.dependencies_of(
        spark.createDataFrame(targets, "repo_id string, module string, is_file boolean"), spark.createDataFrame(edges, "repo_id string, src string, dst string, external boolean")
    )
    top = out._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert top.startswith("Union"), top
    want = {(f, "internal", "g") for f in files} | {(f, "users", s) for f in files for s in [*files, "h/x.go"] if s != f}
    want |= {("g/f00.go", "users", "i/y.go"), ("g", "users", "h/x.go"), ("g", "users", "i/y.go")}
    got = [(r["module"], r["relation"], r["path"]) for r in out.collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_compaction_sorts_and_stores_no_texts(spark, monkeypatch):
    seen, old = [], ops.running_sum
    monkeypatch.setattr(ops, "running_sum", lambda df, *a: seen.append(df.columns) or old(df, *a))
    rows = [(1, i, "tool", f"{i}" * 1000) for i in range(6)] + [(1, 9, "user", "u" * 5000), (1, None, "tool", "n" * 700), (1, None, "user", "v" * 700), (2, 1, "tool", "x" * 900), (2, 2, "tool", None), (None, 1, "tool", "y" * 9000)]
    rows += [(3, 1, "tool", "a" * 1000), (3, 1, "tool", "b" * 1000), (3, 2, "tool", "c" * 2500), (3, 2, "user", "d"), (3, 3, "tool", "e" * 10), (3, 4, "tool", "f" * 10)]
    out = ops.compacted(spark.createDataFrame(rows, "thread_id int, pos int, role string, text string"), 4000).collect()
    assert all("text" not in columns for columns in seen) and seen
    got = sorted((r["thread_id"], -1 if r["pos"] is None else r["pos"], r["role"], len(r["text"] or ""), (r["text"] or "")[:1], r["shortened"]) for r in out)
    note = 400 + len(ops.fixed.OLD_OUTPUT_NOTE)
    assert [g[1:] for g in got if g[0] == 1] == [(-1, "tool", note, "n", True), (-1, "user", 700, "v", False)] + [(i, "tool", note, str(i), True) for i in range(3)] + [(i, "tool", 1000, str(i), False) for i in (3, 4, 5)] + [(9, "user", 5000, "u", False)]
    assert [g[1:] for g in got if g[0] == 2] == [(1, "tool", 900, "x", False), (2, "tool", 0, "", False)]
    assert [(g[1], g[2], g[4], g[5]) for g in got if g[0] == 3] == [(1, "tool", "a", True), (1, "tool", "b", True), (2, "tool", "c", False), (2, "user", "d", False), (3, "tool", "e", False), (4, "tool", "f", False)]
    assert len(got) == 17


def test_first_rows_read_only_the_columns_that_are_kept(spark):
    rows = spark.createDataFrame([(1, 5, None, "b"), (1, 3, None, "a"), (1, None, 7, "n"), (2, 4, 8, "c")], "k int, pos int, wide int, name string")
    out = refs.first_seen(rows, ["k"])
    plan = out.select("k", "name")._jdf.queryExecution().optimizedPlan().toString()
    assert "wide" not in plan.split("LogicalRDD")[0]
    assert {tuple(r) for r in out.collect()} == {(1, None, 7, "n"), (2, 4, 8, "c")}


def test_script_specifiers_have_one_key_for_all_extensions(spark):
    from corpusloom import fixed

    files = ["a/m.tsx", "a/m.js", "a/m.d.ts", "a/n.ts", "a/n.js", "a/o/index.jsx", "a/o/index.ts", "a/p", "a/p.ts", "a/q.css", "a/r.cjs/index.mjs", "a/index.ts", "a/x.js.ts", "a/x.ts"]
    asked = ["./m", "./m.js", "./m.d", "./n.js", "./n.mjs", "./o", "./o/index", "./p", "./q.css", "./q", "./r.cjs", ".", "./x.js", "./z"]
    rows = [("r", "js", "a", m, 0, "") for m in asked]
    signatures = spark.createDataFrame(rows, "repo_id string, family string, base string, module string, level int, names string")
    frame = spark.createDataFrame([("r", f) for f in files], "repo_id string, path string")
    modules = spark.createDataFrame([("r", "example.com/r")], "repo_id string, go_module string")
    got = {r["module"]: r["hit"]["target"] for r in graph.resolved_signatures(signatures, frame, modules).collect()}
    want = {}
    for m in asked:
        t = "a" if m == "." else "a" + m[1:]
        name = t.rsplit("/", 1)[-1]
        stem = t.rsplit(".", 1)[0]
        swapped = [stem + e for e in fixed.JS_RESOLVE_EXTENSIONS] if any(name.endswith(e) for e in fixed.JS_SOURCE_EXTENSIONS) else []
        hit = [c for c in [t, *swapped, *[t + e for e in fixed.JS_RESOLVE_EXTENSIONS], *[t + "/index" + e for e in fixed.JS_RESOLVE_EXTENSIONS]] if c in files]
        if hit:
            want[m] = hit[0]
    assert got == want and len(want) > 9
    counted = spark.createDataFrame([("a/m.js",)], "t string").select(F.size(graph.js_candidates(F.col("t"))).alias("n"))
    assert counted.first()["n"] == 4


def test_compound_words_are_found_in_one_step_each(spark):
    import re

    from corpusloom.functions import text as X

    frame = spark.createDataFrame([("aB ABc ABC Abc abc 12 a1 1a _x __ A_ AB1 HTTPServer é_aB aé1 fooBar2Baz",), ("",), (" - ",), (None,)], "t string")
    got = [r[0] for r in frame.select(X.indexed_tokens(F.col("t"))).collect()]
    assert got[1:] == [[], [], None]
    words = re.findall("[A-Za-z0-9_]+", frame.first()["t"])
    mixed = [w for w in words if re.search("_|[a-z][A-Z]|[A-Z][A-Z][a-z]|[A-Za-z][0-9]|[0-9][A-Za-z]", w)]
    assert got[0] == [w.lower() for w in words + re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", " ".join(mixed), re.ASCII)]
    assert "(?=[A-Za-z0-9_]*?" not in X._COMPOUND_WORD
