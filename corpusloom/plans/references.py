"""Reference checks over the given tables: claims are spellings of paths in the code corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.operators import graph, refs as op
from corpusloom.plans import extraction as ex
from corpusloom.plans.graph import code_edges
from corpusloom.plans.registry import query
from corpusloom.sources.corpora import corpus

c = F.col
BOTH = ("code_files", "claims")
_LANGS = [(ex._PY, 0), (ex._TS, 1), (ex._JAVA, 2), (ex._GO, 3)]
SYMBOLS_SQL = "syms AS (" + " UNION ALL ".join(
    ex._symbol_check(f"k % 4 = {rest}", rows) for rows, rest in _LANGS
) + ")"


def code_symbols(t):
    """Symbols of the code corpus written out per template (no parsing)."""
    files = corpus(t, "code_files")
    def struct(row):
        name, kind, s, e, parent = row.split(", ")
        return f"named_struct('name', {name}, 'kind', {kind}, 's', {s}, 'e', {e}, 'parent', CAST({parent} AS STRING))"
    cases = " ".join(f"WHEN {rest} THEN array({', '.join(struct(r) for r in rows)})" for rows, rest in _LANGS)
    out = files.select("k", "repo_id", "path", F.expr(f"inline(CASE CAST(k % 4 AS INT) {cases} END)"))
    shift = "CASE WHEN e < 0 THEN -e + CASE WHEN k % 3 > 0 THEN 1 + 2 * (k % 3) ELSE 0 END ELSE e END"
    return out.selectExpr(
        "repo_id", "path", "replace(name, '#', CAST(k AS STRING)) AS name", "kind", "s AS start_line",
        f"CAST({shift} AS INT) AS end_line", "replace(parent, '#', CAST(k AS STRING)) AS parent",
    )


def file_index(t):
    text = c("text")
    return corpus(t, "code_files").select("repo_id", "path", (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).alias("line_count"))


def texts(t):
    return corpus(t, "code_files").select("repo_id", "path", "text")


_RES = """names AS (SELECT repo_id, regexp_replace(path, '^.*/', '') AS b, count(*) AS n FROM code_files GROUP BY 1, 2),
 res AS (SELECT c.*, CASE WHEN form = 7 THEN NULL WHEN form = 3 AND nm.n > 1 THEN NULL ELSE true_path END AS path,
 CASE form WHEN 7 THEN NULL WHEN 2 THEN 'ignoring_case' WHEN 3 THEN CASE WHEN nm.n = 1 THEN 'suffix' END WHEN 6 THEN 'suffix' ELSE 'exact' END AS matched_by,
 CASE form WHEN 4 THEN 2 WHEN 5 THEN 5 END AS rs, CASE form WHEN 4 THEN 4 WHEN 5 THEN 5 END AS re
 FROM claims c LEFT JOIN names nm ON nm.repo_id = c.repo_id AND nm.b = regexp_replace(true_path, '^.*/', ''))"""
_CLAMP = """a AS (SELECT *, coalesce(start_line, rs) AS s0, coalesce(end_line, re) AS e0 FROM res),
 b AS (SELECT *, least(coalesce(s0, e0, 1), coalesce(e0, s0, 1)) AS lo, greatest(coalesce(s0, e0, 1), coalesce(e0, s0, 1)) AS hi FROM a),
 cl AS (SELECT *, path IS NULL OR (s0 IS NULL AND e0 IS NULL) OR lo > n OR (lo = 1 AND hi = 1 AND n > 1) AS nope FROM b),
 rep AS (SELECT *, CASE WHEN NOT nope THEN lo END AS s, CASE WHEN NOT nope THEN least(hi, n) END AS e FROM cl),
 fin AS (SELECT *, CASE WHEN path IS NULL THEN 'dropped' WHEN path = raw AND s IS NOT DISTINCT FROM start_line AND e IS NOT DISTINCT FROM end_line THEN 'ok' ELSE 'repaired' END AS outcome FROM rep)"""
REPAIRED_SQL = f"{_RES}, {_CLAMP}"


def claims(t):
    return corpus(t, "claims").withColumn("pos", c("claim_id"))


@query("d7_resolve_files", f"WITH {_RES} SELECT claim_id, path, matched_by, rs AS ref_start, re AS ref_end FROM res", BOTH)
def d7(t):
    return op.resolved(claims(t), file_index(t)).select("claim_id", "path", "matched_by", "ref_start", "ref_end")


def _dir_claims(t):
    raw = """CASE CAST(k % 5 AS INT) WHEN 0 THEN regexp_replace(path, '/[^/]*$', '') || '/' WHEN 1 THEN upper(regexp_replace(path, '/[^/]*$', ''))
     WHEN 2 THEN './' || split(path, '/')[0] WHEN 3 THEN 'nowhere/' ELSE path END"""
    return corpus(t, "code_files").select("k", c("k").alias("pos"), "repo_id", F.expr(raw).alias("raw"))


_DIR = "CASE k % 5 WHEN 0 THEN regexp_replace(path, '/[^/]*$', '') WHEN 1 THEN regexp_replace(path, '/[^/]*$', '') WHEN 2 THEN split_part(path, '/', 1) END"


@query("d8_resolve_dirs", f"SELECT k, {_DIR} AS dir FROM code_files", ("code_files",))
def d8(t):
    return op.resolved_dirs(_dir_claims(t), file_index(t)).select("k", "dir")


@query(
    "d9_symbol_lookup",
    f"""WITH {SYMBOLS_SQL}, rq AS (SELECT k AS request_id, repo_id, CASE k % 4 WHEN 0 THEN 'run' WHEN 1 THEN 'service_' || k WHEN 2 THEN 'toString' ELSE 'Get' END AS name,
 CASE WHEN k % 4 = 0 THEN 'Model_' || k END AS parent FROM code_files),
 m AS (SELECT request_id, s.*, s.name = rq.name AND (rq.parent IS NULL OR rq.parent IS NOT DISTINCT FROM s.parent) AS exact FROM rq JOIN syms s ON s.repo_id = rq.repo_id AND lower(s.name) = lower(rq.name)),
 x AS (SELECT *, bool_or(exact) OVER (PARTITION BY request_id) AS any_exact FROM m),
 r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY kind = 'method', path, start_line, end_line) AS rank FROM x WHERE exact = any_exact)
 SELECT request_id, repo_id, rank, kind, name, parent, path, start_line, end_line, exact FROM r WHERE rank <= 10""",
    ("code_files",),
)
def d9(t):
    asked = corpus(t, "code_files").selectExpr(
        "k AS request_id", "repo_id",
        "CASE CAST(k % 4 AS INT) WHEN 0 THEN 'Model_' || k || '.run' WHEN 1 THEN 'service_' || k WHEN 2 THEN 'toString' ELSE 'Get' END AS name",
    )
    return op.symbol_lookup(asked, code_symbols(t))


@query(
    "d10_unique_symbols",
    f"WITH {SYMBOLS_SQL} SELECT repo_id, lower(name) AS key, min(path) AS path, min(start_line) AS start_line, min(end_line) AS end_line FROM syms GROUP BY 1, 2 HAVING count(*) = 1",
    ("code_files",),
)
def d10(t):
    return op.unique_symbols(code_symbols(t))


_RANGE = f"""{SYMBOLS_SQL}, rg AS (SELECT claim_id, s.start_line AS sym_start, s.end_line AS sym_end FROM claims c JOIN syms s ON s.repo_id = c.repo_id AND s.path = c.true_path
 AND lower(s.name) = CASE c.k % 4 WHEN 0 THEN 'run' WHEN 1 THEN 'service_' || c.k WHEN 2 THEN 'mod' || c.k END AND NOT (c.k % 4 = 2 AND s.kind = 'method'))"""


@query("d10_symbol_ranges", f"WITH {_RANGE} SELECT claim_id, sym_start, sym_end FROM claims LEFT JOIN rg USING (claim_id)", BOTH)
def d10_ranges(t):
    rows = claims(t).withColumn("path", c("true_path"))
    return op.symbol_ranges(rows, code_symbols(t)).select("claim_id", "sym_start", "sym_end")


@query(
    "d11_suggestions",
    """WITH un AS (SELECT repo_id, regexp_replace(path, '/[^/]*$', '') || '/x' || regexp_replace(path, '^.*/', '') AS asked FROM code_files WHERE k % 7 = 0
 UNION SELECT repo_id, 'zz/' || regexp_replace(path, '^.*/', '') FROM code_files WHERE k % 7 = 1),
 p AS (SELECT un.repo_id, asked, path, levenshtein(asked, path) AS distance FROM un JOIN code_files f ON f.repo_id = un.repo_id
   AND abs(length(regexp_replace(asked, '^.*/', '')) - length(regexp_replace(path, '^.*/', ''))) <= 1
   AND levenshtein(lower(regexp_replace(asked, '^.*/', '')), lower(regexp_replace(path, '^.*/', ''))) <= 1)
 SELECT repo_id, asked, path, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, asked ORDER BY distance, path) AS rank FROM p) WHERE rank <= 3""",
    ("code_files",),
)
def d11(t):
    files = corpus(t, "code_files")
    name = P.basename(c("path"))
    one = files.where("k % 7 = 0").select("repo_id", F.concat(P.dirname(c("path")), F.lit("/x"), name).alias("path"))
    two = files.where("k % 7 = 1").select("repo_id", F.concat(F.lit("zz/"), name).alias("path"))
    return op.suggestions(one.unionByName(two), files.select("repo_id", "path"))


_MISSPELT = "replace(path, 'o', '0') || CASE WHEN k % 2 = 0 THEN 'x' ELSE '' END"


@query(
    "d11_close_paths",
    f"""WITH un AS (SELECT DISTINCT repo_id, {_MISSPELT} AS asked FROM code_files WHERE k % 3 = 0)
 SELECT repo_id, asked, path AS word, levenshtein(asked, path) AS distance FROM un JOIN code_files f USING (repo_id)
 WHERE abs(length(asked) - length(path)) <= 3 AND levenshtein(asked, path) <= 3""",
    ("code_files",),
)
def d11_paths(t):
    """Whole paths at most three changes away from misspelt ones."""
    files = corpus(t, "code_files")
    lost = files.where("k % 3 = 0").selectExpr("repo_id", f"{_MISSPELT} AS asked")
    return op.within_edits(lost, files.select("repo_id", c("path").alias("word")), 3)


@query(
    "d11_similar_symbols",
    f"""WITH {SYMBOLS_SQL}, un AS (SELECT DISTINCT repo_id, replace(name, 'e', '') AS asked FROM syms), nm AS (SELECT DISTINCT repo_id, name FROM syms),
 p AS (SELECT repo_id, asked, name, levenshtein(lower(asked), lower(name)) AS distance FROM un JOIN nm USING (repo_id)
   WHERE abs(length(asked) - length(name)) <= 2 AND levenshtein(lower(asked), lower(name)) <= 2)
 SELECT repo_id, asked, name, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, asked ORDER BY distance, name) AS rank FROM p) WHERE rank <= 5""",
    ("code_files",),
)
def d11_symbols(t):
    """Similar names for symbols written without the letter e."""
    known = code_symbols(t)
    return op.similar_symbols(known.select("repo_id", F.replace("name", F.lit("e"), F.lit("")).alias("name")), known, edits=2)


_MENT = """contains(lower(array_to_string(string_split(text, chr(10))[greatest(start_line - 2, 1):coalesce(end_line, start_line) + 2], chr(10))),
 CASE c.k % 4 WHEN 0 THEN 'run' WHEN 1 THEN 'service_' || c.k WHEN 2 THEN 'mod' || c.k ELSE 'unknown' || c.k END)"""


@query(
    "d12_mentions",
    f"SELECT claim_id, CASE WHEN start_line IS NOT NULL THEN {_MENT} END AS mentioned FROM claims c JOIN code_files f ON f.k = c.k",
    BOTH,
)
def d12(t):
    return op.with_mentions(claims(t).withColumn("path", c("true_path")), texts(t)).select("claim_id", "mentioned")


@query("n1_repair_refs", f"WITH {REPAIRED_SQL} SELECT claim_id, path, s AS start_line, e AS end_line, outcome FROM fin", BOTH)
def n1(t):
    return op.repaired_refs(claims(t), file_index(t)).select("claim_id", "path", "start_line", "end_line", "outcome")


@query(
    "n2_clamp",
    """SELECT claim_id, CASE WHEN ok THEN least(start_line, end_line) END AS s, CASE WHEN ok THEN least(greatest(start_line, end_line), n) END AS e FROM
 (SELECT *, start_line IS NOT NULL AND least(start_line, end_line) <= n AND NOT (start_line = 1 AND end_line = 1 AND n > 1) AS ok FROM claims)""",
    BOTH,
)
def n2(t):
    span = op.clamped(c("start_line"), c("end_line"), c("n"))
    return claims(t).select("claim_id", span.alias("r")).select("claim_id", "r.s", "r.e")


@query(
    "n3_overview",
    f"""SELECT k, CASE WHEN d IS NOT NULL THEN d || '/' WHEN k % 5 = 4 THEN path END AS path,
 CASE WHEN k % 5 = 0 THEN 'ok' WHEN d IS NOT NULL THEN 'repaired' WHEN k % 5 = 4 THEN 'ok' ELSE 'dropped' END AS outcome FROM (SELECT *, {_DIR} AS d FROM code_files)""",
    ("code_files",),
)
def n3(t):
    return op.overview_items(_dir_claims(t), file_index(t)).select("k", "path", "outcome")


@query(
    "n4_start_here",
    f"WITH {REPAIRED_SQL} SELECT repo_id, path, min(claim_id) AS claim_id FROM fin WHERE path IS NOT NULL GROUP BY 1, 2",
    BOTH,
)
def n4(t):
    return op.start_here_items(claims(t), file_index(t)).select("repo_id", "path", "claim_id")


@query(
    "g7_first_seen",
    "SELECT repo_id, lower(raw) AS key, min(claim_id) AS claim_id FROM claims GROUP BY 1, 2",
    BOTH,
)
def g7(t):
    rows = claims(t).select("repo_id", F.lower("raw").alias("key"), "claim_id", "pos")
    return op.first_seen(rows, ["repo_id", "key"]).drop("pos")


@query(
    "f16_reference_report",
    f"""WITH {REPAIRED_SQL}, d AS (SELECT repo_id, raw, row_number() OVER (PARTITION BY repo_id ORDER BY claim_id) AS i FROM fin WHERE outcome = 'dropped')
 SELECT repo_id, count(*) AS checked, count(*) FILTER (WHERE outcome = 'repaired') AS repaired, count(*) FILTER (WHERE outcome = 'dropped') AS dropped,
 (SELECT string_agg(raw, ',' ORDER BY i) FROM d WHERE d.repo_id = fin.repo_id AND i <= 20) AS dropped_paths FROM fin GROUP BY repo_id""",
    BOTH,
)
def f16(t):
    report = op.reference_report(op.repaired_refs(claims(t), file_index(t)), ["repo_id"])
    return report.withColumn("dropped_paths", F.array_join("dropped_paths", ","))


@query(
    "n5_definition_lines",
    f"""WITH {_RANGE}, m AS (SELECT claim_id, CASE WHEN start_line IS NOT NULL THEN {_MENT} END AS hit FROM claims c JOIN code_files f ON f.k = c.k)
 SELECT claim_id, CASE WHEN sym_start IS NOT NULL THEN sym_start WHEN hit = false THEN NULL ELSE start_line END AS start_line,
 CASE WHEN sym_start IS NOT NULL THEN sym_end WHEN hit = false THEN NULL ELSE end_line END AS end_line FROM claims LEFT JOIN rg USING (claim_id) LEFT JOIN m USING (claim_id)""",
    BOTH,
)
def n5(t):
    rows = claims(t).withColumn("path", c("true_path"))
    return op.definition_lines(rows, code_symbols(t), texts(t)).select("claim_id", "start_line", "end_line")


@query(
    "n6_glossary",
    """SELECT k AS pos, CASE k % 4 WHEN 0 THEN 'Model_' || k WHEN 1 THEN 'Service_' || k WHEN 2 THEN 'Nothing_' || k ELSE 'Store' || k END AS term,
 CASE WHEN k % 4 < 2 THEN path END AS path, CASE k % 4 WHEN 0 THEN 15 WHEN 1 THEN 13 END AS start_line,
 CASE k % 4 WHEN 0 THEN 28 + CASE WHEN k % 3 > 0 THEN 1 + 2 * (k % 3) ELSE 0 END WHEN 1 THEN 26 END AS end_line, k % 4 = 1 AS looked_up FROM code_files""",
    ("code_files",),
)
def n6(t):
    terms = corpus(t, "code_files").selectExpr(
        "k AS pos", "repo_id",
        "CASE CAST(k % 4 AS INT) WHEN 0 THEN 'Model_' || k WHEN 1 THEN 'Service_' || k WHEN 2 THEN 'Nothing_' || k ELSE 'Store' || k END AS term",
        "CASE CAST(k % 4 AS INT) WHEN 1 THEN NULL WHEN 3 THEN 'ghost/x.go' ELSE path END AS raw",
        "CAST(CASE WHEN k % 4 = 0 THEN 1 END AS INT) AS start_line", "CAST(CASE WHEN k % 4 = 0 THEN 2 END AS INT) AS end_line",
    )
    twice = terms.unionByName(terms.withColumns({"term": F.upper("term"), "pos": c("pos") + 1_000_000_000}))
    return op.glossary_terms(twice, file_index(t), code_symbols(t), texts(t)).drop("repo_id")


@query(
    "n7_tour",
    """SELECT k AS pos, 'step ' || k AS title, path, CASE k % 4 WHEN 0 THEN 15 WHEN 1 THEN 13 WHEN 2 THEN 8 ELSE 10 END AS start_line,
 CASE k % 4 WHEN 0 THEN 17 WHEN 1 THEN 17 WHEN 2 THEN 13 ELSE 12 END AS end_line FROM code_files""",
    ("code_files",),
)
def n7(t):
    steps = corpus(t, "code_files").selectExpr(
        "k AS pos", "repo_id", "'Core Logic: step ' || k AS title", "'./' || path AS raw", "CAST(NULL AS INT) AS start_line", "CAST(NULL AS INT) AS end_line",
        "CASE CAST(k % 4 AS INT) WHEN 0 THEN 'Model_' || k WHEN 1 THEN 'Service_' || k WHEN 2 THEN 'Mod' || k ELSE 'Store' || k END AS symbol",
    )
    twice = steps.unionByName(steps.withColumn("pos", c("pos") + 1_000_000_000))
    out = op.tour_steps(twice, file_index(t), code_symbols(t), texts(t), max_lines=8)
    return out.select("pos", "title", "path", "start_line", "end_line")


def _architecture(t):
    module = "struct<ord:int,id:string,name:string,kind:string,paths:array<string>>"
    listed = [
        (1, "Python Code", "Python", "core", ["src", "./src/zzz.py"]), (2, "web", "Web pages", "core", ["WEB/"]),
        (3, "web", "Java models", "core", ["java/"]), (4, "cloud", "Cloud", "external", []), (5, "ghost", "Ghost", "core", ["nope/"]),
        (6, "go", "Go", "other", ["internal/"]), (7, "unused", "Unused", "external", []),
    ]
    rows = [
        F.struct(F.lit(o).alias("ord"), F.lit(i).alias("id"), F.lit(n).alias("name"), F.lit(k).alias("kind"),
                 F.array(*[F.lit(p) for p in ps]).cast("array<string>").alias("paths")).cast(module)
        for o, i, n, k, ps in listed
    ]
    repos = corpus(t, "code_files").select("repo_id").distinct()
    links = [(1, "python", "Web pages", "calls"), (2, "GO", "cloud", "uses"), (3, "nowhere", "go", "x"), (4, "Python Code", "web", "again"), (5, "go", "Go", "self")]
    edges = [F.struct(F.lit(o).alias("ord"), F.lit(s).alias("source"), F.lit(d).alias("target"), F.lit(lb).alias("label")) for o, s, d, lb in links]
    # One import from Go to Python files per repo and file pair, so that an edge can be derived.
    pairs = corpus(t, "code_files").where("k % 4 = 3").select("repo_id", c("path").alias("src"), F.lit(2).cast("bigint").alias("imports"))
    target = corpus(t, "code_files").where("k % 4 = 0").groupBy("repo_id").agg(F.min("path").alias("dst"))
    return op.architecture(
        repos.select("repo_id", F.inline(F.array(*rows))), repos.select("repo_id", F.inline(F.array(*edges))), file_index(t), pairs.join(target, "repo_id")
    )


_REPOS = "rp AS (SELECT repo_id, count(*) FILTER (WHERE k % 4 = 3) AS go FROM code_files GROUP BY 1)"


@query(
    "n8_architecture_modules",
    f"""WITH {_REPOS} SELECT repo_id, module_id, kind, paths FROM rp, (VALUES ('python_code', 'core', 'src/'), ('web', 'ui', 'web/'), ('web_2', 'data', 'java/'),
 ('cloud', 'external', ''), ('go', 'other', 'internal/')) v(module_id, kind, paths)""",
    ("code_files",),
)
def n8_modules(t):
    modules, _ = _architecture(t)
    return modules.select("repo_id", "module_id", "kind", F.array_join("real", ",").alias("paths"))


@query(
    "n8_architecture_edges",
    f"""WITH {_REPOS} SELECT repo_id, source, target, label, derived, CASE WHEN derived THEN 2 * go ELSE imports END AS imports, position FROM rp,
 (VALUES ('python_code', 'web', 'calls', false, 0, 1), ('go', 'cloud', 'uses', false, 0, 2), ('go', 'python_code', NULL, true, 0, 3)) v(source, target, label, derived, imports, position)""",
    ("code_files",),
)
def n8_edges(t):
    return _architecture(t)[1]


@query(
    "i3_merged_edges",
    """WITH d AS (SELECT repo_id, split_part(path, '/', 2) AS source, coalesce(nullif(split_part(module, '.', 2), ''), 'x') AS target, count(*) AS imports FROM code_refs GROUP BY 1, 2, 3),
 u AS (SELECT repo_id, source, target, false AS derived, 7 AS imports, ord FROM (SELECT repo_id, source, target, row_number() OVER (PARTITION BY repo_id ORDER BY source, target) AS ord FROM d) WHERE ord <= 10
   UNION ALL SELECT repo_id, source, target, true, imports, 0 FROM d),
 o AS (SELECT *, row_number() OVER (PARTITION BY repo_id, source, target ORDER BY derived, ord) AS n FROM u)
 SELECT repo_id, source, target, derived, imports, position FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY derived, ord, CASE WHEN derived THEN -imports END, source, target) AS position FROM o WHERE n = 1) WHERE position <= 30""",
    ("code_refs",),
)
def i3(t):
    parts = F.expr("coalesce(nullif(element_at(concat(split(module, '[.]'), array('')), 2), ''), 'x')")
    refs = corpus(t, "code_refs").select("repo_id", F.split("path", "/")[1].alias("source"), parts.alias("target"))
    derived = refs.groupBy("repo_id", "source", "target").agg(F.count("*").alias("imports")).select(
        "repo_id", "source", "target", F.lit(None).cast("string").alias("label"), F.lit(True).alias("derived"), "imports", F.lit(0).alias("ord")
    )
    claimed = op.top_k(derived.drop("ord"), ["repo_id"], [c("source"), c("target")], 10, "ord").withColumns({"derived": F.lit(False), "imports": F.lit(7).cast("bigint")})
    return op.merged_edges(claimed.select(derived.columns), derived).drop("label")


@query(
    "n9_acceptance",
    f"""WITH {REPAIRED_SQL}, s AS (SELECT repo_id || '-' || (k % 200) AS repo_id, CASE claim_id % 4 WHEN 0 THEN 'overview' WHEN 1 THEN 'start_here' WHEN 2 THEN 'architecture' ELSE 'tour' END AS section,
 count(*) FILTER (WHERE path IS NOT NULL) AS kept, count(*) FILTER (WHERE path IS NOT NULL AND claim_id % 3 = 0) AS flows FROM fin GROUP BY 1, 2)
 SELECT repo_id, section, kept, CASE WHEN section = 'start_here' AND kept < 1 THEN 'no suggested file was found' WHEN section = 'overview' AND kept < 1 THEN 'the structure names no path that exists'
 WHEN section = 'architecture' AND kept < 2 THEN 'needs two modules with existing paths' WHEN section = 'tour' AND kept < 3 THEN 'needs three steps with existing files'
 WHEN section = 'tour' AND flows < 1 THEN 'no traced step names an existing file' END AS problem FROM s""",
    BOTH,
)
def n9(t):
    rows = op.repaired_refs(claims(t), file_index(t))
    section = F.expr("CASE CAST(claim_id % 4 AS INT) WHEN 0 THEN 'overview' WHEN 1 THEN 'start_here' WHEN 2 THEN 'architecture' ELSE 'tour' END")
    items = rows.select(
        F.concat("repo_id", F.lit("-"), (c("k") % 200).cast("string")).alias("repo_id"), section.alias("section"),
        F.when(c("claim_id") % 3 == 0, "flow_trace").otherwise("other").alias("item_kind"), c("path").isNotNull().alias("kept"),
    )
    return op.acceptance(items)


@query(
    "n9_section_bounds",
    """SELECT repo_id, least(8, greatest(1, n)) AS min_files, least(15, greatest(1, n)) AS max_files, least(8, greatest(3, n)) AS min_steps, least(12, greatest(3, n)) AS max_steps
 FROM (SELECT repo_id || (k % 100) AS repo_id, count(*) AS n FROM code_files GROUP BY 1)""",
    ("code_files",),
)
def n9_bounds(t):
    return op.section_bounds(corpus(t, "code_files").select(F.concat("repo_id", (c("k") % 100).cast("string")).alias("repo_id")))


_ANSWER = """'See [' || path || ':2-3] and `' || path || '` ([ghost/' || CAST(k AS STRING) || '.py]) .' || chr(10) || '```' || chr(10) || '[' || path || ']' || chr(10) || '``` end [link](x.md) [optional]  '"""


def _answers(t):
    rows = corpus(t, "code_files").select(c("k").alias("message_id"), "repo_id", F.expr(_ANSWER).alias("text"))
    return rows, op.answer_tokens(rows, file_index(t))


@query(
    "e20_answer_text",
    "SELECT k AS message_id, 'See [' || path || ':2-3] and [' || path || '].' || chr(10) || '```' || chr(10) || '[' || path || ']' || chr(10) || '``` end [link](x.md) [optional]' AS text FROM code_files",
    ("code_files",),
)
def e20(t):
    return op.repaired_answers(*_answers(t))


@query(
    "e20_citations",
    "SELECT k AS message_id, path, 2 AS start_line, 3 AS end_line FROM code_files UNION ALL SELECT k, path, NULL, NULL FROM code_files",
    ("code_files",),
)
def e20_citations(t):
    return op.answer_citations(_answers(t)[1]).drop("at")
