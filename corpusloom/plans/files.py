"""Sources, stores and file classification over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import paths as P
from corpusloom.functions import text as X
from corpusloom.operators import files as op
from corpusloom.plans.registry import query
from corpusloom.session import durable_path
from corpusloom.sources import stores, trees
from corpusloom.sources.corpora import corpus

DOC_INDEX = """doc_index AS (SELECT *, octet_length(encode(text)) AS size,
 sha1(encode('blob ' || octet_length(encode(text)) || chr(0) || text)) AS blob_sha,
 length(text) - length(replace(text, chr(10), '')) + 1 AS line_count FROM doc_files)"""


def doc_index(t):
    """Files table of the documents corpus."""
    return corpus(t, "doc_files").select(
        "doc_id",
        "repo_id",
        "path",
        "language",
        "text",
        F.octet_length("text").alias("size"),
        X.line_count(F.col("text")).alias("line_count"),
        X.blob_sha(F.col("text")).alias("blob_sha"),
    )


def sql_list(words):
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


# --- A: sources and sinks ---------------------------------------------------------------------


@query("a1_read_tree")
def a1(t):
    listing = trees.read_tree(t.spark, t.root, repo_levels=0)
    return listing.select("path", "size")


@query(
    "a2_decode",
    "SELECT doc_id, md5(text || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '�' ELSE '�x' END)"
    " AS digest FROM documents",
)
def a2(t):
    tail = F.expr("CASE doc_id % 3 WHEN 0 THEN X'' WHEN 1 THEN X'FF' ELSE X'C378' END")
    content = F.concat(F.col("text").cast("binary"), tail)
    return t.documents.select("doc_id", F.md5(trees.read_text(content).cast("binary")).alias("digest"))


@query(
    "a3_new_blobs",
    f"WITH {DOC_INDEX} SELECT blob_sha AS sha, max(length(text)) AS chars FROM doc_index "
    "GROUP BY blob_sha HAVING bool_and(doc_id % 3 <> 0)",
    ("doc_files",),
)
def a3(t):
    files = corpus(t, "doc_files")
    stored = stores.blobs_of(files.where("doc_id % 3 = 0"))
    return stores.unstored_blobs(files, stored).select("sha", F.length("content").alias("chars"))


@query(
    "a3_stored_blobs",
    f"WITH {DOC_INDEX} SELECT blob_sha AS sha, left(blob_sha, 2) AS bucket, max(length(text)) AS chars, 1 AS copies FROM doc_index GROUP BY 1, 2",
    ("doc_files",),
)
def a3_store(t):
    """The store after two increments that overlap: each content once."""
    path = durable_path(t.spark, "blobs")
    files = corpus(t, "doc_files")
    stores.store_blobs(files.where("doc_id % 3 = 0"), path)
    stores.store_blobs(files, path)
    rows = stores.open_blobs(t.spark, path).select("sha", "bucket", F.length("content").alias("n"))
    return rows.groupBy("sha", "bucket").agg(F.max("n").alias("chars"), F.count("*").alias("copies"))


@query(
    "a4_replace_snapshot",
    "SELECT repo_id, CASE WHEN repo_id < 'src2' THEN 2 ELSE 1 END AS version, count(*) AS files, "
    "sum(length(text)) AS chars FROM doc_files GROUP BY repo_id",
    ("doc_files",),
)
def a4(t):
    path = durable_path(t.spark, "snapshot")
    rows = corpus(t, "doc_files").select("repo_id", "path", F.length("text").alias("chars"))
    stores.replace_snapshot(rows.withColumn("version", F.lit(1)), path)
    stores.replace_snapshot(rows.where("repo_id < 'src2'").withColumn("version", F.lit(2)), path)
    table = t.spark.read.schema("path string, chars int, version int, repo_id string").parquet(path)
    return table.groupBy("repo_id", "version").agg(
        F.count("*").alias("files"), F.sum("chars").alias("chars")
    )


@query(
    "a5_list_files",
    f"WITH {DOC_INDEX} SELECT repo_id, path, language, size, line_count, blob_sha FROM doc_index",
    ("doc_files",),
)
def a5(t):
    return stores.list_files(doc_index(t))


@query(
    "a6_look_up",
    f"WITH {DOC_INDEX} SELECT repo_id, path, blob_sha, size, length(text) AS chars FROM doc_index "
    "WHERE doc_id IN (SELECT doc_id FROM labels)",
    ("doc_files",),
)
def a6(t):
    files = doc_index(t)
    asked = files.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    blobs = stores.blobs_of(files)
    hits = stores.look_up(asked, files.drop("text"), blobs)
    return hits.select("repo_id", "path", "blob_sha", "size", F.length("content").alias("chars"))


@query(
    "a7_read_ranges",
    f"""WITH {DOC_INDEX}, req AS (SELECT doc_id AS request_id, repo_id,
 CASE WHEN doc_id % 11 = 0 THEN path || 'x' ELSE path END AS path, doc_id % 7 + 1 AS start_line,
 CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 9 + 1 END AS end_line FROM doc_index),
 split AS (SELECT repo_id, path, CASE WHEN text LIKE '%' || chr(10)
   THEN string_split(left(text, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END AS ls
   FROM doc_index),
 j AS (SELECT r.*, ls, greatest(len(ls), 1) AS total FROM req r LEFT JOIN split s USING (repo_id, path)),
 k AS (SELECT *, least(coalesce(end_line, total), total) AS wanted FROM j),
 s AS (SELECT *, CASE WHEN ls IS NULL THEN 'not_found' WHEN start_line > total THEN 'out_of_range'
   WHEN wanted < start_line THEN 'bad_range' ELSE 'ok' END AS status,
   least(wanted, start_line + 199) AS e FROM k)
 SELECT request_id, repo_id, path, status, CASE WHEN status = 'ok' THEN start_line END AS start_line,
 CASE WHEN status = 'ok' THEN e END AS end_line, CASE WHEN ls IS NOT NULL THEN total END AS total_lines,
 coalesce(wanted > e, false) AS more, CASE WHEN status = 'ok' THEN array_to_string(list_transform(
   range(start_line, e + 1), lambda i: lpad(CAST(i AS VARCHAR), CAST(length(CAST(e AS VARCHAR)) AS INTEGER), ' ')
   || ' | ' || ls[i]), chr(10)) END AS body FROM s""",
    ("doc_files",),
)
def a7(t):
    files = doc_index(t)
    asked = files.selectExpr(
        "doc_id AS request_id",
        "repo_id",
        "CASE WHEN doc_id % 11 = 0 THEN path || 'x' ELSE path END AS path",
        "CAST(doc_id % 7 + 1 AS INT) AS start_line",
        "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id % 9 + 1 AS INT) END AS end_line",
    )
    return stores.read_ranges(asked, files.drop("text"), stores.blobs_of(files), fixed.MAX_READ_LINES)


def call_log(t):
    """Agent calls from the events table."""
    return t.event_times().selectExpr(
        "concat('r', user_id % 20) AS repo_id",
        "CASE WHEN event_type IN ('view', 'click') THEN 'chat' ELSE 'analysis' END AS scope",
        "CAST(user_id AS STRING) AS run_id",
        "ts",
        "event_id",
        "CASE WHEN event_type = 'purchase' THEN 'llm' ELSE 'tool' END AS kind",
        "event_type AS tool",
        "concat('{\"q\":\"ghp_abcdefghijklmnopqrstu', event_id, '\"}') AS arguments",
        "event_type <> 'error' AS ok",
        "CAST(value * 10 AS BIGINT) AS duration_ms",
    )


@query(
    "a8_append_log",
    "SELECT 'r' || (user_id % 20) AS repo_id, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS calls, "
    "min('{\"q\":\"[REDACTED]\"}') AS arguments FROM events GROUP BY 1, 2",
)
def a8(t):
    path = durable_path(t.spark, "agent_log")
    log = call_log(t)
    stores.append_log(log.where("ok"), path)
    stores.append_log(log.where("NOT ok"), path)
    table = t.spark.read.parquet(path)
    return table.groupBy("repo_id", F.col("day").cast("string").alias("day")).agg(
        F.count("*").alias("calls"), F.min("arguments").alias("arguments")
    )


@query(
    "a9_log_retention",
    "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-02-20 12:00:00' - INTERVAL 30 DAY",
)
def a9(t):
    return stores.retained(call_log(t), F.lit("2024-02-20 12:00:00").cast("timestamp")).select("event_id")


_PAYLOAD = (
    "'{\"steps\": [{\"path\": \"' || path || '\", \"n\": 1}, {\"path\": \"dir/\"}], \"x\": {\"paths\": [\"' "
    "|| module || '.py\", \"lib/\"]}, \"note\": \"see \\\"path\\\": \\\"no\\\"\"}'"
)


@query(
    "a10_cited_paths",
    "SELECT DISTINCT repo_id, path FROM (SELECT repo_id, path FROM code_refs UNION ALL "
    "SELECT repo_id, module || '.py' FROM code_refs) WHERE path NOT LIKE '%/'",
    ("code_refs",),
)
def a10(t):
    refs = corpus(t, "code_refs")
    quoted = F.concat(
        F.lit('{"steps": [{"path": "'), "path", F.lit('", "n": 1}, {"path": "dir/"}], "x": {"paths": ["'),
        "module", F.lit('.py", "lib/"]}, "note": "see \\"path\\": \\"no\\""}'),
    )
    return stores.cited_paths(refs.select("repo_id", quoted.alias("payload")))


# --- B: classification ------------------------------------------------------------------------

_SEG = "string_split(path, '/')[:-2]"
_IGN = (
    f"(s IN {sql_list(fixed.IGNORED_DIRS)} OR lower(s) IN {sql_list(fixed.IGNORED_DIRS)} "
    "OR s LIKE '%.egg-info')"
)
_VEN = f"lower(s) IN {sql_list(fixed.VENDORED_DIRS)}"
_ANC = f"""anc AS (SELECT repo_id, path, i, {_SEG}[i] AS s, array_to_string(({_SEG})[1:i], '/') AS d
 FROM (SELECT repo_id, path, unnest(range(1, len({_SEG}) + 1)) AS i FROM tree_files))"""
_PRUNED = f"""{_ANC}, pruned AS (SELECT repo_id, path, arg_min(d, i) AS prune_dir,
 arg_min(CASE WHEN {_IGN} THEN 'ignored_dir' ELSE 'vendored' END, i) AS reason FROM anc
 WHERE {_IGN} OR {_VEN} GROUP BY repo_id, path)"""


@query(
    "b1_ignored_dirs",
    f"WITH {_ANC} SELECT repo_id, path FROM tree_files WHERE (repo_id, path) NOT IN "
    f"(SELECT (repo_id, path) FROM anc WHERE {_IGN})",
    ("tree_files",),
)
def b1(t):
    files = corpus(t, "tree_files").select("repo_id", "path")
    return files.where(~op.in_ignored_dir(F.col("path")))


@query(
    "b2_vendored_dirs",
    f"WITH {_ANC} SELECT repo_id, path FROM tree_files WHERE (repo_id, path) NOT IN "
    f"(SELECT (repo_id, path) FROM anc WHERE {_VEN})",
    ("tree_files",),
)
def b2(t):
    files = corpus(t, "tree_files").select("repo_id", "path")
    return files.where(~op.in_vendored_dir(F.col("path")))


@query(
    "b3_pruned_dirs",
    f"WITH {_PRUNED} SELECT repo_id, reason, count(DISTINCT prune_dir) AS dirs FROM pruned GROUP BY 1, 2",
    ("tree_files",),
)
def b3(t):
    return op.pruned_dir_counts(corpus(t, "tree_files").select("repo_id", "path"))


def ignore_rules(t):
    """Ignore-file lines derived from the nations: some at the root, some in the nation's folder."""
    return t.nation.join(F.broadcast(t.region), F.expr("n_regionkey = r_regionkey")).selectExpr(
        "r_name AS repo_id",
        "CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE lower(n_name) END AS dir",
        "n_nationkey AS ordinal",
        """CASE n_nationkey % 5 WHEN 0 THEN '*.toml' WHEN 1 THEN lower(n_name) || '/docs/'
         WHEN 2 THEN 'examples/ ' WHEN 3 THEN '!file_1*.toml' ELSE '/a/**/*.r?' END AS pattern""",
    )


_RULES_SQL = """rules AS (SELECT r_name AS repo_id, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE lower(n_name) END AS dir,
 n_nationkey AS ordinal, n_nationkey % 5 = 3 AS negated, CASE n_nationkey % 5 WHEN 0 THEN '^(.+/)?[^/]*[.]toml(/.*)?$'
 WHEN 1 THEN '^' || lower(n_name) || '/docs/.*$' WHEN 2 THEN '^(.+/)?examples/.*$'
 WHEN 3 THEN '^(.+/)?file_1[^/]*[.]toml(/.*)?$' ELSE '^a/(.+/)?[^/]*[.]r[^/](/.*)?$' END AS rx
 FROM nation JOIN region ON n_regionkey = r_regionkey),
 cand AS (SELECT DISTINCT repo_id, path, d || '/' AS name FROM anc UNION ALL SELECT repo_id, path, path FROM tree_files),
 hits AS (SELECT c.repo_id, c.path, c.name, r.dir, arg_max(negated, ordinal) AS neg FROM cand c JOIN rules r
   ON c.repo_id = r.repo_id AND (r.dir = '' OR starts_with(c.name, r.dir || '/') AND c.name <> r.dir || '/')
   AND regexp_matches(CASE WHEN r.dir = '' THEN c.name ELSE substr(c.name, length(r.dir) + 2) END, r.rx)
   GROUP BY 1, 2, 3, 4),
 hidden AS (SELECT DISTINCT repo_id, path, name FROM hits WHERE NOT neg)"""


@query(
    "b4_ignore_rules",
    f"WITH {_ANC}, {_RULES_SQL} SELECT DISTINCT repo_id, path FROM hidden",
    ("tree_files",),
)
def b4(t):
    files = corpus(t, "tree_files").select("repo_id", "path")
    rules = ignore_rules(t)
    dirs = op.ignored_dirs(files, rules)
    below = op.with_pruned_dir(files, dirs)
    # A static reason higher up may hide the rule, so compare directories directly here.
    spread = below.select("repo_id", "path", F.explode(P.ancestors(F.col("path"))).alias("dir"))
    under = spread.join(dirs, ["repo_id", "dir"], "left_semi").select("repo_id", "path")
    return under.union(op.ignored_files(files, rules)).distinct()


@query(
    "b5_symlinks",
    "SELECT repo_id, path FROM tree_files WHERE is_symlink",
    ("tree_files",),
)
def b5(t):
    files = corpus(t, "tree_files")
    reason = F.when(F.col("is_symlink"), F.lit("symlink"))
    return files.where(reason.isNotNull()).select("repo_id", "path")


_NAME = "lower(split_part(path, '/', -1))"
_EXT = f"regexp_extract({_NAME}, '^.+([.][^.]+)$', 1)"
_GEN = " OR ".join(f"ends_with({_NAME}, '{s}')" for s in fixed.GENERATED_SUFFIXES)
_LINES = "CASE WHEN text LIKE '%' || chr(10) THEN string_split(left(text, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END"
_MIN = (
    f"({_NAME} LIKE '%.min.%' OR ({_EXT} IN {sql_list(fixed.MINIFIED_CHECK_EXTENSIONS)} AND "
    f"list_max(list_transform({_LINES}, lambda x: length(x))) > 1000 AND length(text) / len({_LINES}) > 300))"
)
_SKIP = f"""CASE WHEN {_NAME} IN {sql_list(fixed.LOCKFILES)} THEN 'lockfile'
 WHEN {_EXT} IN {sql_list(fixed.BINARY_EXTENSIONS)} THEN 'binary' WHEN {_GEN} THEN 'generated'
 WHEN size = 0 THEN 'empty' WHEN size > 512000 THEN 'too_large' WHEN {_MIN} THEN 'minified'
 WHEN contains(text, chr(0)) THEN 'binary' END"""


@query(
    "b6_skip_reason",
    f"SELECT repo_id, path, {_SKIP} AS reason FROM tree_files",
    ("tree_files",),
)
def b6(t):
    files = corpus(t, "tree_files")
    reason = op.skip_reason(F.col("path"), F.col("size"), F.col("text"), fixed.MAX_FILE_BYTES)
    return files.select("repo_id", "path", reason.alias("reason"))


@query(
    "b7_minified",
    f"SELECT repo_id, path FROM tree_files WHERE {_MIN}",
    ("tree_files",),
)
def b7(t):
    files = corpus(t, "tree_files")
    return files.where(op.minified(F.col("path"), F.col("text"))).select("repo_id", "path")


@query(
    "b8_binary",
    "SELECT repo_id, path FROM tree_files WHERE contains(text, chr(0))",
    ("tree_files",),
)
def b8(t):
    files = corpus(t, "tree_files")
    return files.where(op.binary_content(F.col("text"))).select("repo_id", "path")


_FULL = f"""WITH {_PRUNED}, {_RULES_SQL}, gdir AS (SELECT repo_id, path, arg_min(rtrim(name, '/'), length(name)) AS d
   FROM hidden WHERE name LIKE '%/' GROUP BY 1, 2),
 reasons AS (SELECT f.repo_id, f.path, CASE
   WHEN p.prune_dir IS NOT NULL AND (g.d IS NULL OR length(p.prune_dir) <= length(g.d)) THEN p.reason
   WHEN g.d IS NOT NULL THEN 'gitignored' WHEN is_symlink THEN 'symlink'
   WHEN h.path IS NOT NULL THEN 'gitignored' ELSE {_SKIP} END AS reason,
   CASE WHEN p.prune_dir IS NOT NULL AND (g.d IS NULL OR length(p.prune_dir) <= length(g.d)) THEN p.prune_dir
     ELSE g.d END AS prune_dir, size
   FROM (SELECT * FROM tree_files) f LEFT JOIN pruned p USING (repo_id, path) LEFT JOIN gdir g USING (repo_id, path)
   LEFT JOIN (SELECT repo_id, path FROM hidden WHERE name = path) h USING (repo_id, path))"""


@query(
    "b9_skip_histogram",
    f"{_FULL} SELECT repo_id, reason, count(DISTINCT coalesce(prune_dir, path)) AS skipped FROM reasons "
    "WHERE reason IS NOT NULL GROUP BY 1, 2",
    ("tree_files",),
)
def b9(t):
    return op.skip_histogram(op.classified(corpus(t, "tree_files"), ignore_rules(t), fixed.MAX_FILE_BYTES))


@query(
    "b9_too_large",
    f"{_FULL} SELECT repo_id, path, size FROM reasons WHERE reason = 'too_large'",
    ("tree_files",),
)
def b9_too_large(t):
    return op.too_large_paths(op.classified(corpus(t, "tree_files"), ignore_rules(t), fixed.MAX_FILE_BYTES))


@query(
    "b10_limits",
    "SELECT repo_id, count(*) AS files, sum(size) AS bytes FROM tree_files WHERE repo_id IN (SELECT "
    "repo_id FROM tree_files GROUP BY 1 HAVING count(*) <= 300 AND sum(size) <= 50000000) GROUP BY 1",
    ("tree_files",),
)
def b10(t):
    files = corpus(t, "tree_files").select("repo_id", "path", "size")
    return op.repo_sizes(op.within_limits(files, max_files=300, max_bytes=50_000_000))


_LANG = (
    f"CASE {_NAME} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.LANGUAGE_OF_NAME.items())
    + f" ELSE CASE WHEN {_NAME} LIKE 'dockerfile%' THEN 'dockerfile' ELSE CASE {_EXT} "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.LANGUAGE_OF_EXTENSION.items())
    + " ELSE 'text' END END END"
)


@query(
    "b11_language",
    f"SELECT repo_id, path, {_LANG} AS language FROM tree_files",
    ("tree_files",),
)
def b11(t):
    files = corpus(t, "tree_files")
    return files.select("repo_id", "path", op.language(F.col("path")).alias("language"))


@query(
    "b12_manifests",
    f"SELECT repo_id, path FROM tree_files WHERE {_NAME} IN {sql_list(fixed.MANIFEST_NAMES)} OR "
    f"regexp_matches({_NAME}, '^requirements.*[.]txt$')",
    ("tree_files",),
)
def b12(t):
    files = corpus(t, "tree_files")
    return files.where(op.is_manifest(F.col("path"))).select("repo_id", "path")


@query(
    "b13_path_filters",
    "SELECT repo_id, path FROM tree_files WHERE contains(lower(path), 'file_1') AND "
    "(path GLOB 'nation_1*/*_[0-5]*.ts')",
    ("tree_files",),
)
def b13(t):
    files = corpus(t, "tree_files")
    path = F.col("path")
    return files.where(
        P.path_contains(path, " FILE_1 ") & P.glob_matches(path, "**/nation_1*/*_[0-5]*.ts")
    ).select("repo_id", "path")


@query(
    "b14_entry_points",
    f"""SELECT repo_id, path, rank FROM (SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY
 length(path) - length(replace(path, '/', '')), (lower(path) LIKE '%test%' OR lower(path) LIKE '%example%'), path)
 AS rank FROM tree_files WHERE {" OR ".join(f"regexp_matches(path, '{p}')" for p in fixed.ENTRY_PATTERNS)})
 WHERE rank <= 12""",
    ("tree_files",),
)
def b14(t):
    return op.entry_points(corpus(t, "tree_files").select("repo_id", "path"))


@query(
    "b15_readme",
    f"""SELECT repo_id, path, excerpt FROM (SELECT repo_id, path, text AS excerpt, row_number() OVER (PARTITION BY
 repo_id ORDER BY length(path) - length(replace(path, '/', '')), length(path), path) AS n FROM tree_files
 WHERE {_NAME} IN {sql_list(fixed.README_NAMES)}) WHERE n = 1""",
    ("tree_files",),
)
def b15(t):
    return op.readmes(corpus(t, "tree_files"))
