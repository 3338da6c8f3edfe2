"""Statistics, usage, jobs, conversations and validation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import text as X
from corpusloom.operators import chunk, files as fop, graph, ops as op, stats, tools
from corpusloom.plans.files import DOC_INDEX, _LANG, doc_index
from corpusloom.plans.graph import CODE, EDGES_SQL, stored_edges
from corpusloom.plans.references import SYMBOLS_SQL, code_symbols
from corpusloom.plans.registry import query
from corpusloom.sources import stores
from corpusloom.sources.corpora import corpus

c = F.col
TREE = ("tree_files",)


def tree_index(t):
    return corpus(t, "tree_files").withColumns({"language": fop.language(c("path")), "line_count": X.line_count(c("text"))})


_TREE = f"ti AS (SELECT *, {_LANG} AS language, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count FROM tree_files)"
_STATS = f"{_TREE}, ls AS (SELECT repo_id, language, count(*) AS files, sum(size) AS bytes, sum(line_count) AS lines FROM ti GROUP BY 1, 2)"
_PROG = "(" + ", ".join(f"'{x}'" for x in fixed.PROGRAMMING) + ")"
_SHARES = f"""{_STATS}, sh AS (SELECT repo_id, language, round_even(bytes * 100 / sum(bytes) OVER (PARTITION BY repo_id), 1) AS percent,
 row_number() OVER (PARTITION BY repo_id ORDER BY bytes DESC, language) AS position FROM ls WHERE language IN {_PROG})"""


@query("f1_language_stats", f"WITH {_STATS} SELECT * FROM ls", TREE)
def f1(t):
    return stats.language_stats(tree_index(t))


@query("f2_language_shares", f"WITH {_SHARES} SELECT * FROM sh", TREE)
def f2(t):
    return stats.language_shares(stats.language_stats(tree_index(t)))


@query("f2_primary_language", f"WITH {_SHARES} SELECT repo_id, language AS primary_language FROM sh WHERE position = 1", TREE)
def f2_primary(t):
    return stats.primary_language(stats.language_stats(tree_index(t)))


@query(
    "f3_snapshot_stats",
    f"""WITH {EDGES_SQL}, {SYMBOLS_SQL}, s AS (SELECT repo_id, count(*) AS symbols FROM syms GROUP BY 1), e AS (SELECT repo_id, count(*) FILTER (WHERE NOT external) AS dependency_edges,
 count(DISTINCT dst) FILTER (WHERE external) AS external_dependencies FROM edges GROUP BY 1)
 SELECT f.repo_id, count(*) AS files, sum(length(text) - length(replace(text, chr(10), '')) + 1) AS lines, sum(octet_length(encode(text))) AS bytes, any_value(symbols) AS symbols,
 count(*) AS chunks, any_value(dependency_edges) AS dependency_edges, any_value(external_dependencies) AS external_dependencies, 'typescript=' || count(*) FILTER (WHERE k % 4 = 1 AND k % 3 <> 1) AS skipped
 FROM code_files f JOIN s USING (repo_id) JOIN e USING (repo_id) GROUP BY 1""",
    CODE,
)
def f3(t):
    files = corpus(t, "code_files")
    counts = code_symbols(t).groupBy("repo_id", "path").agg(F.count("*").alias("n_symbols"))
    rows = files.select("repo_id", "path", F.octet_length("text").alias("size"), X.line_count(c("text")).alias("line_count")).join(counts, ["repo_id", "path"], "left")
    skipped = files.where("language = 'typescript'").groupBy("repo_id", c("language").alias("reason")).agg(F.count("*").alias("skipped"))
    out = stats.snapshot_stats(rows, chunk.chunked(files), stored_edges(t), skipped)
    text = F.array_join(F.transform(F.map_entries("skipped"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumn("skipped", text)


@query(
    "f6_symbol_rich_files",
    f"""WITH {SYMBOLS_SQL}, n AS (SELECT repo_id, path, count(*) AS n FROM syms GROUP BY 1, 2)
 SELECT repo_id, path, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, path) AS rank FROM n) WHERE rank <= 10""",
    ("code_files",),
)
def f6(t):
    return stats.symbol_rich_files(tools.nested_symbols(code_symbols(t)))


@query(
    "k3_nested_symbols",
    f"WITH {SYMBOLS_SQL} SELECT repo_id, path, name, kind, start_line, end_line, parent FROM syms",
    ("code_files",),
)
def k3(t):
    return tools.exploded_symbols(tools.nested_symbols(code_symbols(t))).select("repo_id", "path", "name", "kind", "start_line", "end_line", "parent")


_TOP = """tl AS (SELECT repo_id, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) || '/' ELSE path END AS name, count(*) AS files FROM tree_files GROUP BY 1, 2),
 tp AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY name NOT LIKE '%/', files DESC, name) AS position FROM tl)"""


@query("f7_top_level", f"WITH {_TOP} SELECT * FROM tp WHERE position <= 25", TREE)
def f7(t):
    return stats.top_level(corpus(t, "tree_files"))


_ANCESTORS = """d AS (SELECT repo_id, path, text, array_to_string((string_split(path, '/'))[1:i], '/') AS dir FROM (SELECT *, unnest(range(0, len(string_split(path, '/')))) AS i FROM tree_files))"""


@query(
    "f8_list_directory",
    f"""WITH {_ANCESTORS}, r AS (SELECT repo_id, dir, text, CASE WHEN dir = '' THEN path ELSE substr(path, length(dir) + 2) END AS rest FROM d WHERE dir = '' OR dir LIKE '%/a' OR dir LIKE '%/docs'),
 e AS (SELECT repo_id, dir, contains(rest, '/') AS is_dir, split_part(rest, '/', 1) AS name, count(*) AS files, max(CASE WHEN NOT contains(rest, '/') THEN length(text) - length(replace(text, chr(10), '')) + 1 END) AS lines FROM r GROUP BY 1, 2, 3, 4)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, dir ORDER BY is_dir DESC, name) AS position FROM e) WHERE position <= 200""",
    TREE,
)
def f8(t):
    files = tree_index(t)
    dirs = files.select("repo_id", F.explode(F.array_append(stats.P.ancestors(c("path")), F.lit(""))).alias("dir")).distinct()
    return stats.list_directory(dirs.where("dir = '' OR dir LIKE '%/a' OR dir LIKE '%/docs'"), files)


@query(
    "e22_tree_view",
    f"""WITH {_ANCESTORS}, n AS (SELECT DISTINCT repo_id, dir AS path, 'dir' AS type FROM d WHERE dir <> '' UNION ALL SELECT repo_id, path, 'file' FROM tree_files)
 SELECT repo_id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, regexp_replace(path, '^.*/', '') AS name, path, type FROM n""",
    TREE,
)
def e22(t):
    return stats.tree_nodes(corpus(t, "tree_files")).orderBy("repo_id", "parent", "type", "name")


@query(
    "f17_digest",
    f"""WITH {_SHARES}, {_TOP}, b AS (SELECT repo_id, count(*) AS files, sum(line_count) AS lines FROM ti GROUP BY 1)
 SELECT b.repo_id, 'Repository: ' || b.repo_id || chr(10) || 'Size: ' || files || ' files, ' || lines || ' lines' || chr(10) || 'Languages: ' ||
 (SELECT string_agg(language || ' ' || percent || '%', ', ' ORDER BY position) FROM sh WHERE sh.repo_id = b.repo_id AND position <= 6) || chr(10) || 'Top-level layout:' || chr(10) ||
 (SELECT string_agg('  - ' || name || ' (' || tp.files || ' files)', chr(10) ORDER BY position) FROM tp WHERE tp.repo_id = b.repo_id AND position <= 20) AS digest FROM b""",
    TREE,
)
def f17(t):
    files = tree_index(t)
    base = files.groupBy("repo_id").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"))
    shares = stats.language_shares(stats.language_stats(files))
    none = files.where("path LIKE '%never%'")
    empty = none.select("repo_id", "path", F.lit(1).alias("rank"), c("path").alias("dst"), F.lit(0).alias("imports"), F.lit(0).alias("n"))
    return stats.digest(base, shares, stats.top_level(files), empty, empty, empty, fop.readmes(none))


@query("f17_digest_full")
def f17_full(t):
    """The digest with all of its parts on the code corpus."""
    files = corpus(t, "code_files").withColumns({"size": F.length("text"), "line_count": X.line_count(c("text"))})
    base = files.groupBy("repo_id").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"))
    shares = stats.language_shares(stats.language_stats(files))
    central = graph.most_imported(stored_edges(t))
    rich = stats.symbol_rich_files(tools.nested_symbols(code_symbols(t)))
    return stats.digest(base, shares, stats.top_level(files), fop.entry_points(files), central, rich, fop.readmes(files))


@query(
    "d19_content_join",
    f"WITH {DOC_INDEX} SELECT repo_id, path, blob_sha, md5(text) AS digest FROM doc_index",
    ("doc_files",),
)
def d19(t):
    files = doc_index(t)
    joined = stores.with_content(files.drop("text"), stores.blobs_of(files))
    return joined.select("repo_id", "path", "blob_sha", F.md5(c("content").cast("binary")).alias("digest"))


@query(
    "e19_grep",
    """WITH l AS (SELECT repo_id, path, i AS line_no, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT repo_id, path, CASE WHEN text LIKE '%' || chr(10)
 THEN string_split(left(text, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END AS ls FROM doc_files WHERE path LIKE 'en/%')))
 SELECT repo_id, path, line_no, trim(line) AS line, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path, line_no) AS rank FROM l WHERE regexp_matches(line, '(?i)the [a-z]+ing')) WHERE rank <= 50""",
    ("doc_files",),
)
def e19(t):
    return tools.grep(corpus(t, "doc_files"), "the [a-z]+ing", path_glob="en/**/*.txt", ignore_case=True)


@query(
    "e21_text_tool_calls",
    """SELECT event_id AS reply_id, CASE WHEN event_type = 'click' THEN 'read_file' ELSE 'grep' END AS name, CASE event_type WHEN 'click' THEN '{"path":"p' || user_id || '"}' WHEN 'view' THEN '{"pattern":"' || user_id || '"}' ELSE '{}' END AS arguments, 1 AS call_no
 FROM events WHERE event_type IN ('click', 'view', 'signup') UNION ALL SELECT event_id, 'grep', '{"pattern":"x"}', 2 FROM events WHERE event_type = 'click'
 UNION ALL SELECT event_id, 'grep', '{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":' || user_id || '}}}}}}}}', 1 FROM events WHERE event_type = 'purchase'""",
)
def e21(t):
    text = F.expr("""CASE event_type WHEN 'click' THEN concat('<tool_call>{"name": "read_file", "arguments": {"path": "p', user_id, '"}}</tool_call> and <tool_call>{"function": {"name": "grep", "parameters": {"pattern": "x"}}}')
     WHEN 'view' THEN concat('Try\n```json\n[{"tool": "grep", "args": {"pattern": "', user_id, '"}}]\n``` {"name": "grep"}') WHEN 'signup' THEN 'I call {"name": "grep"} now'
     WHEN 'purchase' THEN concat('{"name": "grep", {so {"name": "grep", "arguments": {"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": ', user_id, '}}}}}}}}} or {"name": ')
     ELSE '{"name": "unheard_of", "arguments": {}}' END""")
    return tools.text_tool_calls(t.events.select(c("event_id").alias("reply_id"), text.alias("text")), list(fixed.TOOL_VERBS))


@query(
    "k2_tool_arguments",
    """SELECT event_id, CASE event_type WHEN 'click' THEN CASE WHEN user_id % 2 = 0 THEN 'invalid_arguments' END WHEN 'view' THEN 'unknown_tool' WHEN 'error' THEN 'invalid_json'
 WHEN 'signup' THEN 'invalid_arguments' END AS error_type, CASE event_type WHEN 'click' THEN CASE WHEN user_id % 2 = 0 THEN 'limit: too large,zz: not allowed' ELSE '' END
 WHEN 'signup' THEN 'path: missing,start_line: not an integer' WHEN 'purchase' THEN '' END AS problems FROM events""",
)
def k2(t):
    args = F.expr("""CASE event_type WHEN 'click' THEN CASE WHEN user_id % 2 = 0 THEN '{"query": "abc", "limit": 99, "zz": 1}' ELSE '{"query": "abc"}' END
     WHEN 'view' THEN '{}' WHEN 'error' THEN '{"query": ' WHEN 'signup' THEN '{"start_line": "x"}' ELSE '' END""")
    tool = F.expr("CASE event_type WHEN 'view' THEN 'nope' WHEN 'signup' THEN 'read_file' WHEN 'purchase' THEN 'get_repo_metadata' ELSE 'search_code' END")
    rows = t.events.select("event_id", tool.alias("tool"), args.alias("arguments"))
    return tools.tool_argument_errors(rows).select("event_id", "error_type", F.array_join("problems", ",").alias("problems"))


@query(
    "k1_section_problems",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'intro: too short,steps: too few,steps.0.title: too short,steps.1.path: missing,steps.1.start_line: too small'
 WHEN 2 THEN 'intro: missing,steps: missing' ELSE '(root): not an object' END AS problems FROM events""",
)
def k1(t):
    step = '{"title": "A step", "path": "a.py", "explanation": "Explains what happens in this part."}'
    good = '{"intro": "A tour through placing an order.", "steps": [%s], "extra": 1}' % ", ".join([step] * 3)
    bad = '{"intro": "Short", "steps": [%s, %s]}' % (step.replace("A step", " x "), step.replace('"path": "a.py"', '"start_line": 0'))
    data = F.when(c("event_id") % 4 == 0, F.lit(good)).when(c("event_id") % 4 == 1, F.lit(bad)).when(c("event_id") % 4 == 2, F.lit("{}"))
    return tools.section_problems(t.events.select("event_id", data.alias("data")), "tour").select("event_id", F.array_join("problems", ",").alias("problems"))


# --- usage and jobs ---------------------------------------------------------------------------


def usage_rows(t):
    return t.events.selectExpr(
        "user_id", "user_id % 20 AS repo_id", "event_type", "CASE WHEN event_type = 'error' THEN NULL ELSE 1 END AS calls", "CAST(value * 10 AS BIGINT) AS prompt_tokens",
        "CAST(floor(value) AS BIGINT) AS completion_tokens", "event_id % 1000 AS latency_ms", "event_id",
    )


_USE = """us AS (SELECT event_id, user_id, user_id % 20 AS repo_id, event_type, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS calls, CAST(trunc(value * 10) AS BIGINT) AS prompt_tokens,
 CAST(floor(value) AS BIGINT) AS completion_tokens, event_id % 1000 AS latency_ms FROM events)"""
_SUMS = "sum(calls) AS calls, sum(prompt_tokens) AS prompt_tokens, sum(completion_tokens) AS completion_tokens, sum(latency_ms) AS latency_ms, sum(prompt_tokens) + sum(completion_tokens) AS total_tokens"


@query(
    "f10_usage_sum",
    f"WITH {_USE} SELECT repo_id, {_SUMS}, round(sum(prompt_tokens) / 1000 * 0.5 + sum(completion_tokens) / 1000 * 2.0, 6) AS est_cost FROM us GROUP BY 1",
)
def f10(t):
    return op.sum_usage(usage_rows(t), ["repo_id"], 0.5, 2.0)


@query(
    "f11_chat_usage",
    """SELECT conv_id % 30 AS user_id, conv_id % 7 AS repo_id, count(*) FILTER (WHERE role = 'user') AS questions, count(*) FILTER (WHERE role <> 'user') AS calls,
 coalesce(sum(length(text)) FILTER (WHERE role <> 'user'), 0) AS prompt_tokens, coalesce(sum(turn) FILTER (WHERE role <> 'user'), 0) AS completion_tokens, 0 AS latency_ms,
 coalesce(sum(length(text) + turn) FILTER (WHERE role <> 'user'), 0) AS total_tokens, 0.0::DOUBLE AS est_cost FROM conversations GROUP BY 1, 2""",
)
def f11(t):
    talk = t.conversations
    messages = talk.selectExpr("conv_id AS thread_id", "role", "1 AS calls", "length(text) AS prompt_tokens", "turn AS completion_tokens", "CAST(NULL AS BIGINT) AS latency_ms")
    threads = talk.selectExpr("conv_id AS thread_id", "conv_id % 30 AS user_id", "conv_id % 7 AS repo_id").distinct()
    return op.chat_usage(messages, threads)


@query(
    "f12_analysis_usage",
    f"""WITH {_USE}, an AS (SELECT repo_id, {_SUMS} FROM us GROUP BY 1), st AS (SELECT DISTINCT user_id, user_id * 7 % 20 AS repo_id FROM events WHERE event_type = 'signup')
 SELECT user_id, repo_id, {_SUMS}, 0.0::DOUBLE AS est_cost FROM st JOIN an USING (repo_id) GROUP BY GROUPING SETS ((user_id, repo_id), (user_id))""",
)
def f12(t):
    analyses = op.sum_usage(usage_rows(t), ["repo_id"])
    jobs = t.events.where("event_type = 'signup'").selectExpr("user_id", "user_id * 7 % 20 AS repo_id")
    return op.analysis_usage(jobs, analyses)


_STEPS = list(fixed.STEP_WEIGHTS)


@query(
    "f13_job_progress",
    f"""SELECT job_id, least(100, CAST(floor(sum(w * least(f, 1)) * 100 / 125) AS BIGINT)) AS progress FROM (SELECT l_orderkey AS job_id, d / 8.0::DOUBLE AS f,
 CASE l_linenumber % 9 {" ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(fixed.STEP_WEIGHTS.values()))} END AS w FROM
 (SELECT l_orderkey, l_linenumber, max(l_partkey % 9) AS d FROM lineitem GROUP BY 1, 2)) GROUP BY 1""",
)
def f13(t):
    steps = F.array(*[F.lit(s) for s in _STEPS])
    rows = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max(c("l_partkey") % 9).alias("d"))
    return op.job_progress(rows.select(c("l_orderkey").alias("job_id"), F.get(steps, c("l_linenumber") % 9).alias("step"), (c("d") / 8).alias("fraction")))


_SECT = """se AS (SELECT l_orderkey AS repo_id, CASE l_linenumber % 5 WHEN 0 THEN 'overview' WHEN 1 THEN 'architecture' WHEN 2 THEN 'start_here' WHEN 3 THEN 'tour' ELSE 'glossary' END AS section,
 CASE WHEN l_partkey % 3 = 0 THEN 'failed' WHEN l_partkey % 7 = 0 THEN 'pending' ELSE 'done' END AS status, l_suppkey % 2 = 0 AS requested FROM lineitem)"""


@query(
    "f14_analysis_status",
    f"""WITH {_SECT} SELECT repo_id, count(*) FILTER (WHERE status = 'done') AS done, count(*) AS sections, CASE WHEN count(*) FILTER (WHERE status = 'done') = count(*) THEN 'done'
 WHEN count(*) FILTER (WHERE status = 'done') > 0 THEN 'partial' ELSE 'failed' END AS status FROM se WHERE section <> 'tour' OR requested OR status = 'done' GROUP BY 1""",
)
def f14(t):
    section = F.expr("CASE l_linenumber % 5 WHEN 0 THEN 'overview' WHEN 1 THEN 'architecture' WHEN 2 THEN 'start_here' WHEN 3 THEN 'tour' ELSE 'glossary' END")
    status = F.expr("CASE WHEN l_partkey % 3 = 0 THEN 'failed' WHEN l_partkey % 7 = 0 THEN 'pending' ELSE 'done' END")
    rows = t.lineitem.select(c("l_orderkey").alias("repo_id"), section.alias("section"), status.alias("status"), (c("l_suppkey") % 2 == 0).alias("requested"))
    return op.analysis_status(rows)


def jobs(t):
    """One job per order, timed against 1999-01-01 12:00."""
    now = "TIMESTAMP '1999-01-01 12:00:00'"
    return t.orders.selectExpr(
        "o_orderkey AS job_id", "o_custkey AS repo_id", "o_custkey % 50 AS user_id",
        "CASE o_orderkey % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'queued' WHEN 2 THEN 'waiting_for_model' WHEN 3 THEN 'done' ELSE 'failed' END AS status",
        f"CASE WHEN o_orderkey % 3 = 0 THEN timestampadd(MINUTE, -CAST(o_orderkey % 70 AS INT), {now}) END AS heartbeat_at", "CAST(NULL AS TIMESTAMP) AS started_at",
        f"timestampadd(MINUTE, -CAST(o_orderkey % 900 AS INT), {now}) AS created_at", f"timestampadd(HOUR, -CAST(o_orderkey % 90 AS INT), {now}) AS waiting_since",
    )


_NOW = "TIMESTAMP '1999-01-01 12:00:00'"
_JOBS = f"""jo AS (SELECT o_orderkey AS job_id, o_custkey AS repo_id, CASE o_orderkey % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'queued' WHEN 2 THEN 'waiting_for_model' WHEN 3 THEN 'done' ELSE 'failed' END AS status,
 CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 70 END AS beat, o_orderkey % 900 AS age, o_orderkey % 90 AS wait, o_custkey % 50 AS user_id FROM orders),
 rs AS (SELECT c_custkey AS repo_id, CASE c_custkey % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' ELSE 'queued' END AS status FROM customer)"""


def repos(t):
    return t.customer.selectExpr("c_custkey AS repo_id", "CASE c_custkey % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' ELSE 'queued' END AS status", "concat('github.com/o/r', c_custkey) AS url_key", "sha1(CAST(c_custkey AS STRING)) AS commit_sha")


@query(
    "g1_latest_job",
    f"WITH {_JOBS} SELECT repo_id, arg_max(job_id, (-age, job_id)) AS job_id FROM jo GROUP BY 1",
)
def g1(t):
    return op.latest_job(jobs(t)).select("repo_id", "job_id")


_SWEPT = """sw AS (SELECT jo.*, rs.status AS rstatus, coalesce(beat, age) AS silent, CASE jo.status WHEN 'running' THEN coalesce(beat, age) > 30 WHEN 'queued' THEN coalesce(beat, age) > 360 ELSE false END AS swept FROM jo LEFT JOIN rs USING (repo_id))"""


@query(
    "l3_sweep_batch",
    f"""WITH {_JOBS}, {_SWEPT} SELECT job_id, swept, CASE WHEN swept THEN silent END AS silent_minutes, swept AND rstatus = 'ready' AS abandon_analysis,
 CASE WHEN swept THEN CASE WHEN rstatus = 'ready' THEN 'done' ELSE 'failed' END ELSE status END AS status FROM sw""",
)
def l3(t):
    out = op.swept_jobs(jobs(t), repos(t), F.expr(_NOW))
    return out.select("job_id", "swept", "silent_minutes", "abandon_analysis", "status")


@query(
    "l4_paused_jobs",
    f"""WITH {_JOBS} SELECT job_id, CASE WHEN status = 'waiting_for_model' THEN CASE WHEN wait > 48 THEN 'give_up' ELSE 'resume' END END AS action,
 CASE WHEN status = 'waiting_for_model' THEN CASE WHEN wait > 48 THEN 'done' ELSE 'running' END ELSE status END AS status FROM jo""",
)
def l4(t):
    return op.resumed_jobs(jobs(t), F.expr(_NOW), model_online=True).select("job_id", "action", "status")


@query(
    "d17_new_work",
    """SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE CASE o_custkey % 3 WHEN 0 THEN 'cached' WHEN 1 THEN 'retry' ELSE 'in_progress' END END AS outcome FROM orders""",
)
def d17(t):
    asked = t.orders.selectExpr("o_orderkey AS request_id", "concat('github.com/o/r', o_custkey) AS url_key", "sha1(CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE CAST(o_custkey AS STRING) END) AS commit_sha")
    return op.new_work(asked, repos(t)).select("request_id", "outcome")


@query(
    "d18_dashboard",
    f"""WITH {_JOBS}, lj AS (SELECT repo_id, arg_max(job_id, (-age, job_id)) AS job_id, arg_max(status, (-age, job_id)) AS job_status FROM jo GROUP BY 1),
 li AS (SELECT user_id, repo_id, min(age) AS age FROM jo GROUP BY 1, 2)
 SELECT user_id, repo_id, rs.status AS repo_status, job_id, job_status, CASE WHEN repo_id % 2 = 0 THEN 'partial' END AS analysis_status FROM li JOIN rs USING (repo_id) JOIN lj USING (repo_id)""",
)
def d18(t):
    all_jobs = jobs(t)
    links = all_jobs.groupBy("user_id", "repo_id").agg(F.max("created_at").alias("linked_at"))
    analyses = repos(t).where("repo_id % 2 = 0").select("repo_id", F.lit("partial").alias("status"))
    return op.dashboard(links, repos(t), all_jobs, analyses).drop("linked_at")


@query(
    "i1_ordered_union",
    """SELECT user_id, repo_id, min(p) AS priority FROM (SELECT o_custkey % 50 AS user_id, o_custkey AS repo_id, 0 AS p FROM orders WHERE o_orderstatus = 'F' UNION ALL
 SELECT o_custkey % 50, o_custkey, 1 FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT user_id % 50, user_id, 2 FROM events) GROUP BY 1, 2""",
)
def i1(t):
    mine = t.orders.selectExpr("o_custkey % 50 AS user_id", "o_custkey AS repo_id", "o_orderstatus")
    chats = t.events.selectExpr("user_id % 50 AS user_id", "user_id AS repo_id")
    return op.ordered_union([mine.where("o_orderstatus = 'F'"), mine.where("o_orderstatus = 'O'"), chats], ["user_id", "repo_id"])


# --- conversations, windows, top-k --------------------------------------------------------------


def messages(t):
    return t.conversations.selectExpr("conv_id AS thread_id", "turn AS pos", "role", "text")


_SQ = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(
    "g2_context",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
 SELECT conv_id AS thread_id, turn AS pos, role, n <= 4 AS verbatim, CASE WHEN n <= 4 THEN text WHEN role = 'user' THEN '- Q: ' || CASE WHEN length({_SQ}) <= 200 THEN {_SQ} ELSE left({_SQ}, 199) || '…' END
 ELSE '- A: ' || CASE WHEN length({_SQ}) <= 300 THEN {_SQ} ELSE left({_SQ}, 299) || '…' END END AS text FROM r""",
)
def g2(t):
    return op.conversation_context(messages(t), 2)


_TOOLS = """m AS (SELECT l_orderkey % 700 AS thread_id, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 0 THEN 'tool' ELSE 'assistant' END AS role, repeat('x', CAST(max(l_partkey) % 2500 AS INT)) AS text FROM lineitem GROUP BY 1, 2, 3)"""


def tool_messages(t):
    return t.lineitem.groupBy(
        F.expr("l_orderkey % 700").alias("thread_id"), F.expr("l_orderkey * 10 + l_linenumber").alias("pos"), F.expr("CASE WHEN l_linenumber % 2 = 0 THEN 'tool' ELSE 'assistant' END").alias("role")
    ).agg(F.expr("repeat('x', CAST(max(l_partkey) % 2500 AS INT))").alias("text"))


@query(
    "g3_compaction",
    f"""WITH {_TOOLS}, a AS (SELECT *, sum(length(text)) OVER (PARTITION BY thread_id) AS total, CASE WHEN role = 'tool' THEN row_number() OVER (PARTITION BY thread_id, role ORDER BY pos DESC) END AS n FROM m),
 b AS (SELECT *, CASE WHEN role = 'tool' AND n > 3 AND length(text) > 400 THEN length(text) - 400 - {len(fixed.OLD_OUTPUT_NOTE)} ELSE 0 END AS saving FROM a),
 d AS (SELECT *, coalesce(sum(saving) OVER (PARTITION BY thread_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS saved, sum(saving) OVER (PARTITION BY thread_id) AS everything FROM b)
 SELECT thread_id, pos, role, CASE WHEN saving <> 0 AND total - saved > 40000 THEN length(left(text, 400)) + {len(fixed.OLD_OUTPUT_NOTE)} WHEN n <= 3 AND length(text) > 2000 AND total - everything > 40000
 THEN 2000 + {len(fixed.RECENT_OUTPUT_NOTE)} ELSE length(text) END AS chars, (saving <> 0 AND total - saved > 40000) OR (coalesce(n, 9) <= 3 AND length(text) > 2000 AND total - everything > 40000) AS shortened FROM d""",
)
def g3(t):
    return op.compacted(tool_messages(t), 40_000).select("thread_id", "pos", "role", F.length("text").alias("chars"), "shortened")


@query(
    "g4_token_budget",
    f"""WITH {_USE}, r AS (SELECT event_id, repo_id, coalesce(sum(prompt_tokens) OVER (PARTITION BY repo_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM us)
 SELECT event_id, repo_id, used, used < 100000 AS allowed FROM r""",
)
def g4(t):
    calls = usage_rows(t).select("event_id", "repo_id", c("prompt_tokens").alias("tokens"))
    return op.budgeted_calls(calls, ["repo_id"], ["event_id"], 100_000).drop("tokens")


@query(
    "g5_last_logs",
    "SELECT job_id, step, event_id, rank FROM (SELECT user_id % 10 AS job_id, event_type AS step, event_id, row_number() OVER (PARTITION BY user_id % 10, event_type ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 200",
)
def g5(t):
    logs = t.events.selectExpr("user_id % 10 AS job_id", "event_type AS step", "ts", "event_id")
    return op.last_logs(logs).drop("ts")


@query(
    "g8_thread_titles",
    f"""SELECT conv_id AS thread_id, arg_min(CASE WHEN length({_SQ}) <= 80 THEN {_SQ} ELSE left({_SQ}, 79) || '…' END, turn) AS title FROM conversations WHERE role = 'user' GROUP BY 1""",
)
def g8(t):
    return op.thread_titles(messages(t))


@query(
    "h1_sort_limit",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100",
)
def h1(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(100)


@query(
    "h2_top_k_per_group",
    """SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 5""",
)
def h2(t):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return op.top_k(rows, ["l_suppkey"], [F.desc("l_extendedprice"), c("l_orderkey"), c("l_linenumber"), c("l_partkey")], 5)


@query(
    "h3_page",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE (o_custkey, o_orderkey) > (40, 100) ORDER BY o_custkey, o_orderkey LIMIT 20",
)
def h3(t):
    return op.page_after(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey", "o_orderkey"], [40, 100])


def probes(t):
    return t.events.selectExpr("user_id % 3 AS server", "ts", "event_id", "event_type <> 'error' AS online")


@query(
    "l6_health_changes",
    """SELECT server, event_id, online FROM (SELECT user_id % 3 AS server, event_id, event_type <> 'error' AS online, lag(event_type <> 'error') OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS p FROM events) WHERE p <> online""",
)
def l6(t):
    return op.status_changes(probes(t), ["server"], ["ts", "event_id"], "online").select("server", "event_id", "online")


def quota_requests(t):
    ts = F.unix_micros(c("ts"))
    return t.event_times().select((c("user_id") % 40).alias("user_id"), ts.alias("ts_us"), "event_id")


_QUOTA = """e AS (SELECT user_id % 40 AS user_id, epoch_us(ts) AS t, event_id, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS n FROM events),
 w AS (SELECT user_id, n, t, event_id, [t] AS hist, true AS accepted FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.t, e.event_id,
   CASE WHEN len(list_filter(w.hist, lambda x: x > e.t - 21600000000)) < 3 THEN list_append(list_filter(w.hist, lambda x: x > e.t - 21600000000), e.t) ELSE list_filter(w.hist, lambda x: x > e.t - 21600000000) END,
   len(list_filter(w.hist, lambda x: x > e.t - 21600000000)) < 3 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)"""


@query("l2_quota", f"WITH RECURSIVE {_QUOTA} SELECT user_id, t AS ts_us, event_id, accepted FROM w")
def l2(t):
    """Three requests per six hours, rejected ones not counted."""
    return op.quota_decisions(quota_requests(t), 3, 21_600)


@query(
    "l2_quota_status",
    f"""WITH RECURSIVE {_QUOTA}, x AS (SELECT user_id, count(*) AS used, min(t) AS o FROM w WHERE accepted AND t > 1706000000000000 - 21600000000 AND t <= 1706000000000000 GROUP BY 1)
 SELECT u.user_id, coalesce(used, 0) AS used, 3 - coalesce(used, 0) AS remaining, CASE WHEN used >= 3 THEN CAST(floor((o + 21600000000 - 1706000000000000) / 1000000) AS BIGINT) + 1 ELSE 0 END AS reset_in_seconds
 FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN x USING (user_id)""",
)
def l2_status(t):
    decided = op.quota_decisions(quota_requests(t), 3, 21_600)
    return op.quota_status(decided, F.lit(1706000000000000), 3, 21_600)
