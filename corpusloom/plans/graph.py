"""Dependency graph and repository statistics over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.operators import graph as op
from corpusloom.plans.files import sql_list
from corpusloom.plans.registry import query
from corpusloom.session import checkpointed
from corpusloom.sources.corpora import corpus

c = F.col
CODE = ("code_files", "code_refs")


def code_paths(t):
    return corpus(t, "code_files").select("repo_id", "path")


def go_modules(t):
    return t.region.select(c("r_name").alias("repo_id"), F.concat(F.lit("example.com/"), F.lower("r_name")).alias("go_module"))


def code_refs(t):
    refs = corpus(t, "code_refs")
    names = F.when(c("name").isNotNull(), F.array("name")).otherwise(F.array().cast("array<string>"))
    return refs.withColumn("names", names).drop("name")


def code_edges(t):
    return op.build_edges(code_refs(t), code_paths(t), go_modules(t))


def stored_edges(t):
    """Edges as the durable table that questions about the graph start from."""
    return checkpointed(code_edges(t))


# The check resolves each kind of specifier with its own list of candidates and plain string tests.
_SUFFIXES = "SELECT repo_id, path, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM code_files WHERE path LIKE '{0}'"
EDGES_SQL = f"""paths AS (SELECT repo_id, path, regexp_replace(path, '/[^/]*$', '') AS dir FROM code_files),
 pymods AS (SELECT repo_id, array_to_string(m[i:], '.') AS key, path, length(path) - length(replace(path, '/', '')) AS depth FROM (SELECT repo_id, path, m,
   unnest(range(1, len(m) + 1)) AS i FROM (SELECT repo_id, path, string_split(regexp_replace(regexp_replace(path, '[.]py$', ''), '/__init__$', ''), '/') AS m
   FROM code_files WHERE path LIKE '%.py'))),
 pyidx AS (SELECT repo_id, key, arg_min(path, (depth, path)) AS target FROM pymods GROUP BY 1, 2),
 jidx AS (SELECT repo_id, array_to_string(string_split(path, '/')[i:], '/') AS key, min(path) AS target FROM ({_SUFFIXES.format('%.java')}) GROUP BY 1, 2),
 didx AS (SELECT repo_id, array_to_string(string_split(dir, '/')[i:], '/') AS key, min(dir) AS target FROM (SELECT repo_id, dir,
   unnest(range(1, len(string_split(dir, '/')) + 1)) AS i FROM paths) GROUP BY 1, 2),
 refs AS (SELECT ref_id, r.repo_id, r.path, r.language, module, level, name, regexp_replace(r.path, '/[^/]*$', '') AS dir,
   'example.com/' || lower(r.repo_id) AS gomod FROM code_refs r),
 cand AS (
   SELECT ref_id, 0 AS pos, 'py' AS space, module AS key FROM refs WHERE language = 'python' AND level = 0
   UNION ALL SELECT ref_id, 1, 'py', module || '.' || name FROM refs WHERE language = 'python' AND level = 0 AND name IS NOT NULL
   UNION ALL SELECT ref_id, 2, 'py', regexp_replace(module, '[.][^.]*$', '') FROM refs WHERE language = 'python' AND level = 0 AND module LIKE '%.%'
   UNION ALL SELECT ref_id, 0, 'path', dir || '/' || name || '.py' FROM refs WHERE language = 'python' AND level = 1
   UNION ALL SELECT ref_id, 1, 'path', dir || '/' || name || '/__init__.py' FROM refs WHERE language = 'python' AND level = 1
   UNION ALL SELECT ref_id, 2, 'path', dir || '/__init__.py' FROM refs WHERE language = 'python' AND level = 1
   UNION ALL SELECT ref_id, 0, 'path', regexp_replace(dir, '/[^/]*$', '') || '/' || replace(module, '.', '/') || '.py' FROM refs WHERE language = 'python' AND level = 2
   UNION ALL SELECT ref_id, 1, 'path', regexp_replace(dir, '/[^/]*$', '') || '/' || replace(module, '.', '/') || '/__init__.py' FROM refs WHERE language = 'python' AND level = 2
   UNION ALL SELECT ref_id, 10 + i, 'path', CASE WHEN module LIKE './%' THEN dir || substr(module, 2) WHEN module LIKE '../../%'
     THEN regexp_replace(dir, '/[^/]*/[^/]*$', '') || substr(module, 6) ELSE regexp_replace(dir, '/[^/]*$', '') || substr(module, 3) END
     || CASE i WHEN 0 THEN '' WHEN 9 THEN '/index.ts' WHEN 10 THEN '/index.tsx' ELSE ['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.mts', '.cts'][i] END
     FROM (SELECT *, unnest(range(0, 11)) AS i FROM refs WHERE language IN ('typescript', 'tsx') AND module LIKE '.%')
   UNION ALL SELECT ref_id, 11 + i, 'path', regexp_replace(dir, '/[^/]*/[^/]*$', '') || regexp_replace(substr(module, 6), '[.]js$', '') || ['.ts', '.tsx'][i]
     FROM (SELECT *, unnest(range(1, 3)) AS i FROM refs WHERE language IN ('typescript', 'tsx') AND module LIKE '../../%.js')
   UNION ALL SELECT ref_id, 0, 'java', replace(module, '.', '/') || '.java' FROM refs WHERE language = 'java'
   UNION ALL SELECT ref_id, 1, 'java', regexp_replace(replace(module, '.', '/'), '/[^/]*$', '') || '.java' FROM refs WHERE language = 'java'
   UNION ALL SELECT ref_id, 0, 'dirs', regexp_replace(replace(module, '.', '/'), '/[*]$', '') FROM refs WHERE language = 'java' AND module LIKE '%.*'
   UNION ALL SELECT ref_id, 0, 'dir', substr(module, length(gomod) + 2) FROM refs WHERE language = 'go' AND module LIKE gomod || '/%'),
 hit AS (SELECT r.ref_id, pos, i.target, false AS is_dir FROM cand JOIN refs r USING (ref_id) JOIN pyidx i ON i.repo_id = r.repo_id AND i.key = cand.key AND space = 'py'
   UNION ALL SELECT r.ref_id, pos, i.target, false FROM cand JOIN refs r USING (ref_id) JOIN jidx i ON i.repo_id = r.repo_id AND i.key = cand.key AND space = 'java'
   UNION ALL SELECT r.ref_id, pos, i.target, true FROM cand JOIN refs r USING (ref_id) JOIN didx i ON i.repo_id = r.repo_id AND i.key = cand.key AND space = 'dirs'
   UNION ALL SELECT r.ref_id, pos, i.dir, true FROM cand JOIN refs r USING (ref_id) JOIN (SELECT DISTINCT repo_id, dir FROM paths) i ON i.repo_id = r.repo_id AND i.dir = cand.key AND space = 'dir'
   UNION ALL SELECT r.ref_id, pos, i.path, false FROM cand JOIN refs r USING (ref_id) JOIN paths i ON i.repo_id = r.repo_id AND i.path = cand.key AND space = 'path'),
 best AS (SELECT ref_id, arg_min(target, pos) AS target, arg_min(is_dir, pos) AS is_dir FROM hit GROUP BY 1),
 j AS (SELECT r.*, target, is_dir, coalesce(target <> CASE WHEN language = 'go' THEN dir ELSE path END, false) AS internal FROM refs r LEFT JOIN best USING (ref_id)),
 edges AS (SELECT DISTINCT repo_id, path AS src, dst, NOT internal AS external, coalesce(internal AND is_dir, false) AS dst_is_dir,
   CASE WHEN module = '' THEN repeat('.', level) ELSE module END AS specifier FROM (SELECT *, CASE WHEN internal THEN target
   WHEN language = 'python' AND level = 0 THEN split_part(module, '.', 1) WHEN language IN ('typescript', 'tsx') AND module LIKE '@%' THEN array_to_string(string_split(module, '/')[1:2], '/')
   WHEN language IN ('typescript', 'tsx') AND module NOT LIKE '.%' THEN split_part(module, '/', 1) WHEN language = 'java' THEN array_to_string(string_split(module, '.')[1:2], '.')
   WHEN language = 'go' AND module <> gomod AND module NOT LIKE gomod || '/%' THEN module END AS dst FROM j) WHERE dst IS NOT NULL)"""


def _by_language(name, languages):
    @query(
        name,
        f"WITH {EDGES_SQL} SELECT repo_id, src, dst, external, dst_is_dir, specifier FROM edges WHERE (repo_id, src) IN (SELECT (repo_id, path) FROM code_files WHERE language IN {sql_list(languages)})",
        CODE,
    )
    def run(t):
        refs = code_refs(t).where(c("language").isin(languages))
        return op.build_edges(refs, code_paths(t), go_modules(t)).drop("src_dir")


_by_language("d1_python_imports", ["python"])
_by_language("d3_js_imports", ["typescript", "tsx"])
_by_language("d4_java_imports", ["java"])
_by_language("d5_go_imports", ["go"])


@query(
    "d2_relative_imports",
    f"WITH {EDGES_SQL} SELECT DISTINCT j.repo_id, j.path, j.module, j.level, j.name, j.target FROM j WHERE language = 'python' AND level > 0 AND target IS NOT NULL",
    CODE,
)
def d2(t):
    refs = op.with_signature(code_refs(t).where("level > 0"))
    found = op.resolved_signatures(refs.select(*op.SIGNATURE).distinct(), code_paths(t), go_modules(t))
    rows = op.skewed_join(refs.select(*op.SIGNATURE, "path").distinct(), found, op.SIGNATURE)
    name = F.nullif(c("names"), F.lit(""))
    return rows.select("repo_id", "path", "module", "level", name.alias("name"), c("hit.target").alias("target"))


@query(
    "d6_build_edges",
    f"WITH {EDGES_SQL} SELECT *, regexp_replace(src, '/[^/]*$', '') AS src_dir FROM edges",
    CODE,
)
def d6(t):
    return op.sorted_edges(code_edges(t))


@query(
    "i4_distinct_names",
    f"WITH {EDGES_SQL} SELECT DISTINCT repo_id, dst, external FROM edges",
    CODE,
)
def i4(t):
    return code_edges(t).select("repo_id", "dst", "external").distinct()


_PAIRS = "pairs AS (SELECT repo_id, src, dst, count(*) AS imports FROM edges WHERE NOT external AND src <> dst GROUP BY 1, 2, 3)"


@query(
    "f4_most_imported",
    f"""WITH {EDGES_SQL}, {_PAIRS}, deg AS (SELECT repo_id, dst, sum(imports) AS imports, count(*) AS importers FROM pairs GROUP BY 1, 2)
 SELECT repo_id, dst, imports, importers, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY imports DESC, dst) AS rank FROM deg) WHERE rank <= 12""",
    CODE,
)
def f4(t):
    return op.most_imported(stored_edges(t))


def _grp(col):
    return f"array_to_string((string_split({col}, '/')[:-2])[1:2], '/') || '/'"


@query(
    "f5_directory_imports",
    f"""WITH {EDGES_SQL}, {_PAIRS}, g AS (SELECT repo_id, {_grp('src')} AS src, {_grp('dst')} AS dst, sum(imports) AS imports FROM pairs
 WHERE {_grp('src')} <> {_grp('dst')} GROUP BY 1, 2, 3), rich AS (SELECT repo_id FROM g GROUP BY 1 HAVING count(*) >= 60),
 chosen AS (SELECT * FROM g WHERE repo_id IN (SELECT repo_id FROM rich) UNION ALL SELECT * FROM pairs WHERE repo_id NOT IN (SELECT repo_id FROM rich))
 SELECT repo_id, src, dst, imports, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY imports DESC, src, dst) AS rank FROM chosen) WHERE rank <= 20""",
    CODE,
)
def f5(t):
    return op.directory_imports(stored_edges(t), min_groups=60)


def path_modules(t):
    """Modules of the code corpus: one per nation folder, one per second folder, some single files."""
    files = corpus(t, "code_files")
    top = files.selectExpr("repo_id", "split(path, '/')[0] AS top").distinct()
    wide = top.selectExpr("repo_id", "concat('top_', top) AS module_id", "1 AS ord", "concat(top, '/') AS owned")
    deep = files.where("slug LIKE '%1'").selectExpr("repo_id", "slug", "split(path, '/')[0] AS a", "split(path, '/')[1] AS b").where("b = slug").distinct()
    narrow = deep.selectExpr("repo_id", "concat('deep_', a, '_', slug) AS module_id", "2 AS ord", "concat(a, '/', slug, '/') AS owned")
    single = files.where("k % 50 = 0").selectExpr("repo_id", "concat('file_', k) AS module_id", "3 AS ord", "path AS owned")
    return wide.unionByName(narrow).unionByName(single)


_OWNERS = """own AS (SELECT repo_id, path, CASE WHEN k % 50 = 0 THEN 'file_' || k
 WHEN slug LIKE '%1' AND string_split(path, '/')[2] = slug THEN 'deep_' || string_split(path, '/')[1] || '_' || slug ELSE 'top_' || string_split(path, '/')[1] END AS module_id FROM code_files)"""


@query("d13_owners", f"WITH {_OWNERS} SELECT * FROM own", ("code_files",))
def d13(t):
    return op.owners(code_paths(t), path_modules(t))


@query(
    "f9_module_imports",
    f"""WITH {EDGES_SQL}, {_PAIRS}, {_OWNERS} SELECT p.repo_id, a.module_id AS source, b.module_id AS target, sum(imports) AS imports FROM pairs p
 JOIN own a ON a.repo_id = p.repo_id AND a.path = p.src JOIN own b ON b.repo_id = p.repo_id AND b.path = p.dst WHERE a.module_id <> b.module_id GROUP BY 1, 2, 3""",
    CODE,
)
def f9(t):
    return op.module_imports(stored_edges(t), op.owners(code_paths(t), path_modules(t)))


@query(
    "d14_kept_modules",
    f"""WITH {_OWNERS}, m AS (SELECT DISTINCT repo_id, module_id, 'core' AS kind FROM own UNION ALL SELECT DISTINCT repo_id, 'ghost', 'core' FROM own
 UNION ALL SELECT DISTINCT repo_id, 'cloud', 'external' FROM own UNION ALL SELECT DISTINCT repo_id, 'unused', 'external' FROM own)
 SELECT * FROM m WHERE module_id NOT IN ('ghost', 'unused')""",
    ("code_files",),
)
def d14(t):
    own = op.owners(code_paths(t), path_modules(t))
    core = path_modules(t).select("repo_id", "module_id", F.lit("core").alias("kind")).distinct()
    extra = t.region.select(c("r_name").alias("repo_id"), F.explode(F.array(F.struct(F.lit("ghost").alias("m"), F.lit("core").alias("k")), F.struct(F.lit("cloud").alias("m"), F.lit("external").alias("k")), F.struct(F.lit("unused").alias("m"), F.lit("external").alias("k")))).alias("x"))
    modules = core.unionByName(extra.select("repo_id", c("x.m").alias("module_id"), c("x.k").alias("kind")))
    edges = path_modules(t).where("ord = 1").select("repo_id", c("module_id").alias("source"), F.lit("cloud").alias("target"))
    return op.linked_modules(op.owning_modules(modules, own), edges)


_D16 = f"""{EDGES_SQL}, tg AS (SELECT repo_id, path AS module, true AS is_file FROM code_files WHERE k % 3 = 0 UNION ALL
 SELECT DISTINCT repo_id, dir, false FROM paths UNION ALL SELECT DISTINCT repo_id, string_split(path, '/')[1], false FROM paths),
 deps AS (SELECT DISTINCT e.repo_id, module, CASE WHEN external THEN 'external' ELSE 'internal' END AS relation, dst AS path FROM tg JOIN edges e ON e.repo_id = tg.repo_id
   AND CASE WHEN is_file THEN src = module ELSE starts_with(src, module || '/') AND (external OR NOT (dst = module OR starts_with(dst, module || '/'))) END
 UNION SELECT DISTINCT e.repo_id, module, 'users', src FROM tg JOIN edges e ON e.repo_id = tg.repo_id AND NOT external AND CASE WHEN is_file
   THEN (dst = module OR dst = regexp_replace(module, '/[^/]*$', '')) AND src <> module ELSE (dst = module OR starts_with(dst, module || '/')) AND NOT (src = module OR starts_with(src, module || '/')) END)"""


def dependency_targets(t):
    files = corpus(t, "code_files")
    single = files.where("k % 3 = 0").selectExpr("repo_id", "path AS module", "true AS is_file")
    dirs = files.select("repo_id", F.explode(F.array(F.regexp_replace("path", "/[^/]*$", ""), F.split("path", "/")[0])).alias("module")).distinct()
    return single.unionByName(dirs.withColumn("is_file", F.lit(False)))


@query("d16_dependencies", f"WITH {_D16} SELECT * FROM deps", CODE)
def d16(t):
    return op.dependencies_of(dependency_targets(t), stored_edges(t))


@query(
    "d16_report",
    f"""WITH {_D16}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, module, relation ORDER BY path) AS n FROM deps),
 l AS (SELECT repo_id, module, string_agg(path, ', ' ORDER BY path) FILTER (WHERE relation = 'internal' AND n <= 60) AS i,
   string_agg(path, ', ' ORDER BY path) FILTER (WHERE relation = 'external' AND n <= 60) AS x, string_agg(path, ', ' ORDER BY path) FILTER (WHERE relation = 'users' AND n <= 60) AS u,
   count(*) FILTER (WHERE relation = 'users') AS nu FROM r GROUP BY 1, 2)
 SELECT tg.repo_id, tg.module, 'Dependencies of ' || tg.module || CASE WHEN is_file THEN '' ELSE '/' END || ':' || chr(10) || 'Imports (in this repo): ' || coalesce(i, 'none')
 || chr(10) || 'External packages: ' || coalesce(x, 'none') || chr(10) || 'Imported by (' || coalesce(nu, 0) || '): ' || coalesce(u, 'nothing') AS report FROM tg LEFT JOIN l USING (repo_id, module)""",
    CODE,
)
def d16_report(t):
    return op.dependency_report(dependency_targets(t), stored_edges(t))
