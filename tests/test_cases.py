"""Small hand-worked cases and brute-force properties per operator."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.functions import text as X
from corpusloom.operators import chunk, files, graph, ops, refs, search, stats, tools
from corpusloom.scale import previous_value, running_sum, salted_join
from corpusloom.sources import stores, trees


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# --- files ------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("path", "language"),
    [("x.tsx", "tsx"), ("x.jsx", "javascript"), ("Dockerfile.prod", "dockerfile"), ("weird.xyz", "text"), ("a/Makefile", "makefile")],
)
def test_language(spark, path, language):
    assert one(spark, files.language(F.lit(path))) == language


def test_noisy_tree(spark):
    rows = [
        ("app/main.py", "print(1)"), ("node_modules/a/x.js", "x"), ("node_modules/b.js", "x"), ("vendor/lib/v.py", "x"),
        ("package-lock.json", "{}"), ("logo.png", "x"), ("blob.txt", "a\x00b"), ("lib.min.js", "x"), ("wide.js", "v=1;" * 400),
        ("empty.py", ""), ("dist/out.js", "x"), ("secret.log", "x"), ("tmp/a.txt", "x"),
    ]
    df = spark.createDataFrame([("r", p, len(t), False, t) for p, t in rows], "repo_id string, path string, size bigint, is_symlink boolean, text string")
    df = df.unionByName(spark.createDataFrame([("r", "big.py", 720_000, False, "x")], df.schema))
    rules = spark.createDataFrame([("r", "", 0, "*.log"), ("r", "", 1, "tmp/")], "repo_id string, dir string, ordinal int, pattern string")
    result = files.classified(df, rules, max_bytes=500_000)
    counts = {r["reason"]: r["skipped"] for r in files.skip_histogram(result).collect()}
    assert counts == {"ignored_dir": 2, "vendored": 1, "lockfile": 1, "binary": 2, "minified": 2, "empty": 1, "gitignored": 2, "too_large": 1}
    assert [r["path"] for r in files.too_large_paths(result).collect()] == ["big.py"]
    assert [r["path"] for r in files.kept_files(df, rules, max_bytes=500_000).collect()] == ["app/main.py"]
    assert "big.py" in [r["path"] for r in files.kept_files(df, rules).collect()]


def test_rules_of_a_folder_hold_below_it_only(spark):
    paths = ["out.log", "srv/out.log", "srv/deep/er/out.log", "srv/kept.log", "srv/cache/page.txt", "cache/page.txt"]
    df = spark.createDataFrame([("r", p) for p in paths] + [("other", "srv/out.log")], "repo_id string, path string")
    rules = spark.createDataFrame([("r", "srv", 0, "*.log"), ("r", "srv", 1, "!kept.log"), ("r", "srv", 2, "cache/")], "repo_id string, dir string, ordinal int, pattern string")
    got = {(r["repo_id"], r["path"]) for r in files.ignored_files(df, rules).collect()}
    assert got == {("r", "srv/out.log"), ("r", "srv/deep/er/out.log"), ("r", "srv/cache/page.txt")}


def test_language_shares(spark):
    df = spark.createDataFrame([("r", "python", 1, 300, 1), ("r", "go", 1, 100, 1), ("r", "markdown", 1, 900, 1)], "repo_id string, language string, files bigint, bytes bigint, lines bigint")
    assert {r["language"]: r["percent"] for r in stats.language_shares(df).collect()} == {"python": 75.0, "go": 25.0}


# --- chunks -----------------------------------------------------------------------------------


def _chunks(spark, text, symbols=None, limits=chunk.ChunkLimits()):
    df = spark.createDataFrame([("r", "f", "text", text, symbols)], f"repo_id string, path string, language string, text string, symbols array<{chunk.SYMBOL}>")
    return sorted(chunk.chunked(df, limits).collect(), key=lambda r: (r["start_line"], r["end_line"]))


def test_line_windows(spark):
    got = [(r["start_line"], r["end_line"]) for r in _chunks(spark, "\n".join(f"l{i}" for i in range(1, 201)))]
    assert got == [(1, 80), (66, 145), (131, 200)]


def test_long_lines_are_bounded(spark):
    got = _chunks(spark, "\n".join("x" * 2000 for _ in range(10)))
    assert all(len(r["content"]) <= 6000 for r in got) and got[-1]["end_line"] == 10


def test_large_class(spark):
    lines = ["class Big:"] + [f"line {i}" for i in range(220)]
    members = [("m%d" % i, "method", 2 + 22 * i, 23 + 22 * i, "Big") for i in range(10)]
    got = _chunks(spark, "\n".join(lines), [("Big", "class", 1, 221, None), *members])
    assert [r["symbol"] for r in got] == ["Big"] + [f"Big.m{i}" for i in range(10)]
    assert (got[0]["start_line"], got[0]["end_line"]) == (1, 1)


def test_chunks_hold_every_line_within_limits(spark):
    rng = random.Random(5)
    lim = chunk.ChunkLimits(max_lines=7, max_chars=60, split_overlap=2, window=6, window_overlap=2)
    rows = []
    for n in range(60):
        lines = ["" if rng.random() < 0.2 else "x" * rng.randint(1, 30) for _ in range(rng.randint(1, 40))]
        lines[-1] = "end"
        symbols = []
        for i in range(rng.randint(0, 4)):
            a = rng.randint(1, len(lines))
            b = rng.randint(a, len(lines))
            symbols.append((f"S{i}", "class", a, b, None))
            for j in range(rng.randint(0, 3)):
                s = rng.randint(a, b)
                symbols.append((f"m{j}", "method", s, rng.randint(s, b), f"S{i}"))
        rows.append(("r", f"f{n}", "text", "\n".join(lines), symbols))
    df = spark.createDataFrame(rows, f"repo_id string, path string, language string, text string, symbols array<{chunk.SYMBOL}>")
    chunks = chunk.chunked(df, lim).collect()
    for _, path, _, text, listed in rows:
        lines, mine = text.split("\n"), sorted((r for r in chunks if r["path"] == path), key=lambda r: (r["start_line"], r["end_line"]))
        spans = [(r["start_line"], r["end_line"]) for r in mine]
        assert all(1 <= a <= b <= len(lines) and b - a < lim.max_lines for a, b in spans)
        # One line may be longer than a chunk; more lines may not.
        assert all(a == b or len("\n".join(lines[a - 1 : b])) <= lim.max_chars for a, b in spans)
        held = {n for a, b in spans for n in range(a, b + 1)}
        assert {n for n, line in enumerate(lines, 1) if line.strip()} <= held
        names = {s[0] for s in listed} | {f"{s[4]}.{s[0]}" for s in listed if s[4]}
        assert all(r["symbol"] is None or r["symbol"].split(" (part ")[0] in names for r in mine)
        parts = [re.search(r" \(part (\d+)/(\d+)\)$", r["symbol"] or "") for r in mine]
        assert all(p is None or 1 <= int(p[1]) <= int(p[2]) for p in parts)


# --- graph ------------------------------------------------------------------------------------


def _edges(spark, paths, found, go=()):
    file_rows = spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string")
    ref_rows = spark.createDataFrame([("r", *f) for f in found], "repo_id string, path string, language string, module string, level int, names array<string>")
    modules = spark.createDataFrame([("r", g) for g in go], "repo_id string, go_module string")
    return {(e["src"], e["dst"], e["external"]) for e in graph.build_edges(ref_rows, file_rows, modules).collect()}


def test_dots_climb_one_folder_each(spark):
    paths = ["one/peer.py", "one/two/peer.py", "one/two/three/peer.py", "one/two/three/__init__.py", "one/two/three/mod.py", "one/two/api.py"]
    asked = [("one/two/three/mod.py", "python", "peer", level, []) for level in (1, 2, 3)]
    assert _edges(spark, paths, asked) == {("one/two/three/mod.py", p, False) for p in paths[:3]}
    assert _edges(spark, paths, [("one/two/api.py", "python", "", 1, [name]) for name in ("three", "peer")]) == {
        ("one/two/api.py", "one/two/three/__init__.py", False), ("one/two/api.py", "one/two/peer.py", False)}


def test_paths_up_and_down_and_module_prefixes(spark):
    paths = ["web/ui/list.tsx", "web/ui/panel/index.js", "web/shared/format.ts", "cmd/run.go", "pkg/queue/ring.go", "pkg/queue/heap.go"]
    got = _edges(
        spark, paths,
        [("web/ui/list.tsx", "tsx", "../shared/format", 0, []), ("web/ui/list.tsx", "tsx", "./panel", 0, []), ("web/ui/list.tsx", "tsx", "@kit/icons", 0, []),
         ("cmd/run.go", "go", "corp.dev/tool/pkg/queue", 0, []), ("cmd/run.go", "go", "corp.dev/toolbox", 0, [])],
        ["corp.dev/tool"],
    )
    inside = {(s, d) for s, d, external in got if not external}
    assert inside == {("web/ui/list.tsx", "web/shared/format.ts"), ("web/ui/list.tsx", "web/ui/panel/index.js"), ("cmd/run.go", "pkg/queue")}
    assert {s for s, _, external in got if external} == {"web/ui/list.tsx", "cmd/run.go"}


def test_longest_prefix_owner(spark):
    df = spark.createDataFrame([("r", p) for p in ("src/api/routes.py", "src/db/models.py", "main.py", "README.md")], "repo_id string, path string")
    mods = spark.createDataFrame([("r", "src", 0, "src/"), ("r", "api", 1, "src/api/"), ("r", "main", 2, "main.py")], "repo_id string, module_id string, ord int, owned string")
    assert {r["path"]: r["module_id"] for r in graph.owners(df, mods).collect()} == {
        "src/api/routes.py": "api", "src/db/models.py": "src", "main.py": "main", "README.md": None}


def test_directory_imports_fall_back_to_files(spark):
    edges = spark.createDataFrame([("r", "lib/a.js", "lib/b.js", False), ("r", "lib/a.js", "lib/c.js", False)], "repo_id string, src string, dst string, external boolean")
    assert {(r["src"], r["dst"]) for r in graph.directory_imports(edges).collect()} == {("lib/a.js", "lib/b.js"), ("lib/a.js", "lib/c.js")}


# --- references -------------------------------------------------------------------------------


def test_clamped_ranges_lie_inside_the_file(spark):
    """Every pair of lines: put in order and cut at the file's end; nothing is left of one that starts behind it."""
    rows = [(a, b, n) for n in (3, 7) for a in range(1, 10) for b in range(1, 10) if (a, b) != (1, 1)]
    df = spark.createDataFrame(rows, "a int, b int, n int")
    for r in df.select("a", "b", "n", refs.clamped(F.col("a"), F.col("b"), F.col("n")).alias("got")).collect():
        low, high = sorted((r.a, r.b))
        assert (tuple(r.got) if r.got else None) == ((low, min(high, r.n)) if low <= r.n else None)


@pytest.mark.parametrize(
    ("raw", "path"),
    [("./app/main.py", "app/main.py"), ("`app/main.py`", "app/main.py"), ("APP/Main.py", "app/main.py"), ("main.py", "app/main.py"),
     ("demo/app/main.py", "app/main.py"), ("app/main.py:12-20", "app/main.py"), ("app/main.py#L5", "app/main.py"), ("nope.py", None)],
)
def test_resolution_ladder(spark, raw, path):
    index = spark.createDataFrame([("r", "app/main.py", 30), ("r", "lib/util.py", 10)], "repo_id string, path string, line_count int")
    claim = spark.createDataFrame([("r", "octo/demo", raw)], "repo_id string, repo_name string, raw string")
    assert refs.resolved(claim, index).first()["path"] == path


def test_derived_edges_and_umbrella_modules(spark):
    paths = ["game/board.go", "game/score.go", "net/lobby.go", "disk/save.go", "start.go"]
    index = spark.createDataFrame([("g", p, 9) for p in paths], "repo_id string, path string, line_count int")
    pairs = spark.createDataFrame(
        [("g", "start.go", "net/lobby.go", 2), ("g", "net/lobby.go", "game/board.go", 4), ("g", "game/score.go", "disk/save.go", 1)],
        "repo_id string, src string, dst string, imports bigint",
    )
    mods = spark.createDataFrame(
        [("g", 1, "Network", "Lobby", "core", ["net", "net/gone.go"]), ("g", 2, "rules", "Rules", "core", ["game/"]), ("g", 3, "saves", "Saves", "data", ["disk/save.go"]),
         ("g", 4, "cloud", "Cloud", "external", []), ("g", 5, "rules", "Boot", "entry", ["start.go"])],
        "repo_id string, ord int, id string, name string, kind string, paths array<string>",
    )
    said = spark.createDataFrame([("g", 1, "network", "cloud", "syncs"), ("g", 2, "rules", "elsewhere", "x")], "repo_id string, ord int, source string, target string, label string")
    modules, links = refs.architecture(mods, said, index, pairs)
    assert sorted(r["module_id"] for r in modules.collect()) == ["cloud", "network", "rules", "rules_2", "saves"]
    got = {(r["source"], r["target"]): (r["derived"], r["imports"]) for r in links.collect()}
    assert got == {("network", "cloud"): (False, 0), ("network", "rules"): (True, 4), ("rules", "saves"): (True, 1), ("rules_2", "network"): (True, 2)}


# --- search -----------------------------------------------------------------------------------


def test_tokens_and_overlap(spark):
    assert set(one(spark, X.code_tokens(F.lit("getUserById")))) == {"get", "user", "by", "id", "getuserbyid"}
    chunks = spark.createDataFrame([(1, "r", "a.py", 1, 9, "def getUserById", None), (2, "q", "a.py", 1, 9, "user by id", None), (3, "r", "b.py", 1, 9, "nothing", None)],
                                   "chunk_id bigint, repo_id string, path string, start_line int, end_line int, content string, symbol string")
    asked = spark.createDataFrame([(7, "r", "user by id")], "query_id bigint, repo_id string, text string")
    assert [r["chunk_id"] for r in search.overlap_search(asked, chunks).collect()] == [1]


def test_rank_fusion(spark):
    def ranking(names):
        return spark.createDataFrame([(1, n, i) for i, n in enumerate(names, 1)], "query_id int, chunk_id string, rank int")

    spans = spark.createDataFrame([(n, n + ".py", 1) for n in "abcd"], "chunk_id string, path string, start_line int")
    got = search.fused({"vector": ranking("abc"), "text": ranking("cda")}, spans).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got][:2] == ["a", "c"] and abs(got[0]["score"] - (1 / 61 + 1 / 63)) < 1e-12
    assert got[0]["sources"] == {"vector": 1, "text": 3}


def test_approximate_search_recall(spark):
    rng = random.Random(1)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(200)]
    chunks = spark.createDataFrame([(i, "r", v) for i, v in enumerate(base)], "chunk_id bigint, repo_id string, embedding array<double>")
    asked = spark.createDataFrame([(i, "r", [x + rng.gauss(0, 0.05) for x in base[i]]) for i in range(20)], "query_id bigint, repo_id string, vector array<double>")
    best = search.approximate_search(asked, chunks, 1).collect()
    assert sum(r["query_id"] == r["chunk_id"] for r in best) >= 18


# --- operations -------------------------------------------------------------------------------


def test_quota_equals_a_plain_walk_with_a_hot_user(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for user, count in ((1, 400), (2, 40), (3, 5)):
        at = 0
        for _ in range(count):
            at += rng.randint(0, 120) * 1_000_000
            rows.append((user, at, n))
            n += 1
    df = spark.createDataFrame(rows, "user_id bigint, ts_us bigint, event_id bigint")
    got = {r["event_id"]: r["accepted"] for r in ops.quota_decisions(df, 3, 600).collect()}
    want = {}
    for user in (1, 2, 3):
        kept = []
        for _, at, e in sorted(r for r in rows if r[0] == user):
            kept = [x for x in kept if x > at - 600_000_000]
            want[e] = len(kept) < 3
            if want[e]:
                kept.append(at)
    assert got == want


def test_running_sum_and_previous_value_cross_slices(spark):
    rows = [("hot" if i % 3 else f"k{i}", i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    sums = {r["i"]: r["s"] for r in running_sum(df, ["k"], ["i"], "v", "s").collect()}
    lags = {r["i"]: r["p"] for r in previous_value(df, ["k"], ["i"], "v", "p").collect()}
    total, last = {}, {}
    for k, i, v in rows:
        assert sums[i] == total.get(k, 0) and lags[i] == last.get(k)
        total[k], last[k] = total.get(k, 0) + v, v


def test_salted_join_keeps_rows(spark):
    big = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    plain = big.join(small, "k", "left").select("id", "k", "w")
    assert sorted(salted_join(big, small, ["k"], "left").select("id", "k", "w").collect()) == sorted(plain.collect())


def test_stale_job_sweep(spark):
    jobs = spark.sql("""SELECT * FROM VALUES (1, 1, 'running', 45), (2, 1, 'running', 5), (3, 1, 'queued', 120), (4, 1, 'waiting_for_model', 600) AS t(job_id, repo_id, status, ago)""")
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    jobs = jobs.select("job_id", "repo_id", "status", F.timestamp_micros(F.unix_micros(now) - F.col("ago").cast("bigint") * 60_000_000).alias("heartbeat_at"),
                       F.lit(None).cast("timestamp").alias("started_at"), now.alias("created_at"))
    repos = spark.sql("SELECT 1 AS repo_id, 'ingesting' AS status")
    once = ops.swept_jobs(jobs, repos, now)
    assert {r["job_id"]: r["status"] for r in once.collect()} == {1: "failed", 2: "running", 3: "queued", 4: "waiting_for_model"}
    again = ops.swept_jobs(once.drop("swept", "silent_minutes", "abandon_analysis"), repos, now)
    assert again.where("swept").count() == 0


def test_cost_and_redaction(spark):
    assert one(spark, X.cost(F.lit(2000), F.lit(500), 0.5, 2.0)) == 2.0
    assert one(spark, X.scrubbed(F.lit("token ghp_" + "a" * 24 + " end"))) == "token [REDACTED] end"


def test_grep_scan_limit_and_results(spark):
    df = spark.createDataFrame([("r", "a.txt", "hit\nmiss\nhit"), ("r", "b.txt", "hit")], "repo_id string, path string, text string")
    assert [(r["path"], r["line_no"]) for r in tools.grep(df, "hit").orderBy("rank").collect()] == [("a.txt", 1), ("a.txt", 3), ("b.txt", 1)]
    assert tools.grep(df, "hit", scan_chars=12).count() == 2
    assert tools.grep(df, "hit", max_results=1).count() == 1


def test_tree_round_trip(spark, tmp_path):
    (tmp_path / "repo" / "src").mkdir(parents=True)
    (tmp_path / "repo" / "src" / "a.py").write_bytes(b"x = 1\n\xff")
    row = trees.read_tree(spark, str(tmp_path)).first()
    assert (row["repo_id"], row["path"], row["size"]) == ("repo", "src/a.py", 7)
    assert one(spark, trees.read_text(F.lit(b"x\xff"))) == "x�"


def test_blob_store_keeps_first_content(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "text string")
    path = str(tmp_path / "blobs")
    blobs = stores.blobs_of(df)
    stores.append_blobs(blobs, spark.createDataFrame([], blobs.schema), path)
    stores.append_blobs(blobs, spark.read.schema(blobs.schema).parquet(path), path)
    assert spark.read.schema(blobs.schema).parquet(path).count() == 2


def test_repo_addresses(spark):
    for url in ("https://github.com/o/r.git", "github.com/o/r/tree/x", "o/r", "git@github.com:o/r.git"):
        assert tuple(one(spark, P.repo_ref(F.lit(url)))) == ("o", "r", "github.com/o/r")
    assert one(spark, P.repo_ref(F.lit("https://example.org/o/r"))) is None


# --- no limit unless asked for ------------------------------------------------------------------


def test_defaults_read_everything(spark):
    text = "a" * 9000 + "\x00" + "b"
    rows = [("r", "big.py", 900_000, "x = 1\n"), ("r", "late.py", 9002, text), ("r", "late.js", 40_000, "x;\n" * 11_000 + "y" * 40_000_0)]
    df = spark.createDataFrame(rows, "repo_id string, path string, size long, text string")
    reason = lambda *limit: {r["path"]: r["why"] for r in df.select("path", files.skip_reason(F.col("path"), F.col("size"), F.col("text"), *limit).alias("why")).collect()}
    assert reason()["big.py"] is None and reason()["late.py"] == "binary"
    assert reason(500_000)["big.py"] == "too_large"
    assert files.rejected_repos(df).count() == 0 and files.within_limits(df).count() == 3
    ends = spark.createDataFrame([("p", "w " * 5000 + "one"), ("p", "w " * 5000 + "two")], "path string, text string")
    hashes = ends.select(X.embed_hash(F.lit("m"), X.embedding_text(F.col("path"), F.lit(None), F.col("text"))).alias("h"))
    assert hashes.distinct().count() == 2


# --- streams on any batching --------------------------------------------------------------------


def test_streams_decide_in_time_order_within_a_micro_batch(spark, tmp_path):
    from corpusloom.streaming import jobs
    from corpusloom.streaming.state import BatchTable

    rows = [(1, i, 1_700_000_000_000_000 + i * 60_000_000, i % 4 < 2) for i in range(30)][::-1]
    frame = spark.createDataFrame(rows, "key bigint, event_id bigint, ts_us bigint, online boolean").coalesce(1)
    frame.withColumn("ts", F.timestamp_micros("ts_us")).write.parquet(f"{tmp_path}/in")
    landed = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        found = {}
        for name, stream in {
            "quota": jobs.quota_stream(landed.withColumnRenamed("key", "user_id"), 3, 600),
        }.items():
            writer = stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}")
            query = writer.option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
            query.awaitTermination()
            found[name] = {r["event_id"]: r[2] for r in spark.read.parquet(f"{tmp_path}/{name}").collect()}
        last = jobs.probe_table(spark, f"{tmp_path}/last", f"{tmp_path}/health-state")
        changes = BatchTable(spark, f"{tmp_path}/changes", "server bigint, event_id bigint, online boolean", f"{tmp_path}/health-state")
        jobs.run_available(jobs.health_changes(landed.withColumnRenamed("key", "server"), last, changes), f"{tmp_path}/health-state")
        found["health"] = {r["event_id"]: r["online"] for r in changes.read(spark).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept, want = [], {}
    for i in range(30):
        kept = [x for x in kept if x > i - 10]
        want[i] = len(kept) < 3
        kept += [i] * want[i]
    assert found["quota"] == want
    online = [i % 4 < 2 for i in range(30)]
    assert found["health"] == {i: online[i] for i in range(1, 30) if online[i] != online[i - 1]}
