"""Symbols, imports, manifests and text extraction over the given tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from corpusloom.operators import chunk, extract, lexer, manifests
from corpusloom.plans.registry import query
from corpusloom.sources.corpora import corpus

c = F.col


def _symbols(t, language):
    return extract.symbols_of(extract.parsed(corpus(t, "code_files").where(c("language").isin(language))))


def _imports(t, language):
    return extract.imports_of(extract.parsed(corpus(t, "code_files").where(c("language").isin(language))))


def _symbol_check(where, rows, extra=""):
    """Symbols written out per source template: name, kind, first line, last line, parent."""
    values = ", ".join(f"({r})" for r in rows)
    return f"""SELECT f.repo_id, f.path, replace(v.name, '#', CAST(k AS VARCHAR)) AS name, v.kind, v.s AS start_line,
 CASE WHEN v.e < 0 THEN -v.e + CASE WHEN k % 3 > 0 THEN 1 + 2 * (k % 3) ELSE 0 END ELSE v.e END AS end_line,
 replace(v.parent, '#', CAST(k AS VARCHAR)) AS parent FROM code_files f, (VALUES {values}) v(name, kind, s, e, parent) WHERE {where} {extra}"""


_PY = ["'top_#', 'function', 9, 13, NULL", "'Model_#', 'class', 15, -28, NULL", "'prop', 'method', 18, 20, 'Model_#'",
       "'run', 'method', 22, 25, 'Model_#'", "'Meta', 'class', 27, 28, 'Model_#'"]
_PY_EXTRA = """UNION ALL SELECT repo_id, path, 'more', 'method', 30 + 2 * i, 31 + 2 * i, 'Model_' || k FROM (SELECT *,
 unnest(range(0, CAST(k % 3 AS BIGINT))) AS i FROM code_files WHERE k % 4 = 0)"""
_TS = ["'Shape_#', 'interface', 7, 9, NULL", "'Id', 'type', 10, 10, NULL", "'Color', 'enum', 11, 11, NULL",
       "'Service_#', 'class', 13, 26, NULL", "'constructor', 'method', 15, 17, 'Service_#'", "'load', 'method', 18, 22, 'Service_#'",
       "'handler', 'method', 23, 25, 'Service_#'", "'arrow_#', 'function', 28, 30, NULL", "'plain', 'function', 33, 38, NULL"]
_JAVA = ["'Mod#', 'class', 8, 25, NULL", "'Mod#', 'method', 11, 13, 'Mod#'", "'toString', 'method', 15, 18, 'Mod#'",
         "'Inner', 'class', 20, 24, 'Mod#'", "'work', 'method', 21, 23, 'Inner'", "'Port#', 'interface', 27, 29, NULL",
         "'call', 'method', 28, 28, 'Port#'", "'Mode', 'enum', 31, 31, NULL"]
_GO = ["'Store#', 'struct', 10, 12, NULL", "'Reader', 'interface', 14, 16, NULL", "'ID', 'type', 19, 19, NULL",
       "'Pair', 'struct', 20, 22, NULL", "'New#', 'function', 25, 27, NULL", "'Get', 'method', 29, 34, 'Store#'"]
_JS = ["typescript", "tsx"]


def _out(df):
    return df.select("repo_id", "path", "name", "kind", "start_line", "end_line", "parent")


@query("e10_python_symbols", _symbol_check("k % 4 = 0", _PY, _PY_EXTRA), ("code_files",))
def e10(t):
    return _out(_symbols(t, ["python"]))


@query("e11_js_symbols", _symbol_check("k % 4 = 1", _TS), ("code_files",))
def e11(t):
    return _out(_symbols(t, _JS))


@query("e12_java_symbols", _symbol_check("k % 4 = 2", _JAVA), ("code_files",))
def e12(t):
    return _out(_symbols(t, ["java"]))


@query("e13_go_symbols", _symbol_check("k % 4 = 3", _GO), ("code_files",))
def e13(t):
    return _out(_symbols(t, ["go"]))


_IMPORTS = {
    0: ["'os', 1, 0, ''", "'json', 2, 0, ''", "'sys', 2, 0, ''", "'', 3, 1, 'sibling_#'", "'core.base', 4, 2, 'Base,helper'", "'pkg@.mod_#', 5, 0, 'thing'"],
    1: ["'react', 1, 0, ''", "'./mod_#', 2, 0, ''", "'../w@/other', 3, 0, ''", "'fs', 4, 0, ''"],
    2: ["'java.util.List', 3, 0, ''", "'com.shop.Util.helper', 4, 0, ''", "'com.shop.models.*', 5, 0, ''"],
    3: ["'fmt', 4, 0, ''", "'example.com/lib#', 5, 0, ''", "'strings', 8, 0, ''"],
}


def _import_check(rest):
    values = ", ".join(f"({r})" for r in _IMPORTS[rest])
    return f"""SELECT f.repo_id, f.path, replace(replace(v.module, '#', CAST(k AS VARCHAR)), '@', CAST(k % 5 AS VARCHAR)) AS module, v.line, v.level,
 replace(v.names, '#', CAST(k AS VARCHAR)) AS names FROM code_files f, (VALUES {values}) v(module, line, level, names) WHERE k % 4 = {rest}"""


def _named(df):
    return df.select("repo_id", "path", "module", "line", "level", F.array_join("names", ",").alias("names"))


@query("e10_python_imports", _import_check(0), ("code_files",))
def e10_imports(t):
    return _named(_imports(t, ["python"]))


@query("e11_js_imports", _import_check(1), ("code_files",))
def e11_imports(t):
    return _named(_imports(t, _JS))


@query("e12_java_imports", _import_check(2), ("code_files",))
def e12_imports(t):
    return _named(_imports(t, ["java"]))


@query("e13_go_imports", _import_check(3), ("code_files",))
def e13_imports(t):
    return _named(_imports(t, ["go"]))


_ALL_SYMBOLS = " UNION ALL ".join(
    [_symbol_check("k % 4 = 0", _PY, _PY_EXTRA), _symbol_check("k % 4 = 1", _TS), _symbol_check("k % 4 = 2", _JAVA), _symbol_check("k % 4 = 3", _GO)]
)


@query(
    "e14_file_facts",
    f"""SELECT repo_id, path, string_agg(name || ':' || kind || ':' || start_line || '-' || end_line || ':' || coalesce(parent, ''), ',' ORDER BY start_line, -end_line, name) AS symbols,
 any_value(CASE k % 4 WHEN 2 THEN 'com.shop.p' || (k % 5) WHEN 3 THEN 'g' || (k % 5) END) AS package, any_value(k % 9 = 0) AS parse_errors
 FROM ({_ALL_SYMBOLS}) JOIN code_files USING (repo_id, path) GROUP BY 1, 2""",
    ("code_files",),
)
def e14(t):
    """Every symbol of every file in file order; a ninth of the files has a bracket too many."""
    files = corpus(t, "code_files").withColumn("text", F.expr("CASE WHEN k % 9 = 0 THEN text || '\n\n}' ELSE text END"))
    facts = extract.file_facts(files)

    def shown(s):
        return F.concat_ws(":", s["name"], s["kind"], F.concat(s["start_line"], F.lit("-"), s["end_line"]), F.coalesce(s["parent"], F.lit("")))

    return facts.select("repo_id", "path", F.array_join(F.transform("symbols", shown), ",").alias("symbols"), "package", "parse_errors")


# Shapes that patterns over lines miss: (language, text, symbols); # is the file's number.
_SHAPES = [
    ("typescript", r"""const re# = /["'{(]\/[/}]+/g;
const arrow# =
  async (a: string, b = { x: 1 }): Promise<Map<string, { y: number }>> => {
    return `a ${b ? `in ${a} {` : "}"} z`;
  };
export class Box#<T> extends Base<{ a: T }> {
  static count = 0
  get size(): number { return 1 }
  handler = (e: Event): void => {
    if (e) { for (;;) {} }
  };
  [Symbol.iterator]() { return this }
}
let x = 1, f# = function () { return x }
""", ["'arrow#', 'function', 2, 5, NULL", "'Box#', 'class', 6, 13, NULL", "'size', 'method', 8, 8, 'Box#'", "'handler', 'method', 9, 11, 'Box#'",
      "'[Symbol.iterator]', 'method', 12, 12, 'Box#'", "'f#', 'function', 14, 14, NULL"]),
    ("tsx", r"""@Dec({ a: "}" })
export default class extends Base {
  m() { return 4 / 2 / 1 }
}
export const enum Kind# { A, B }
type U# =
  | "a"
  | { b: string };
const K# = class { run(a = /[)]/) {} };
function over#(a: string): void;
function over#(a: any) { return <b>{a}</b> }
""", ["'default', 'class', 1, 4, NULL", "'Kind#', 'enum', 5, 5, NULL", "'U#', 'type', 6, 8, NULL", "'K#', 'class', 9, 9, NULL", "'run', 'method', 9, 9, 'K#'",
      "'over#', 'function', 10, 10, NULL", "'over#', 'function', 11, 11, NULL"]),
    ("java", r'''@Entity(name = "a{")
public final class A#<T extends Comparable<T>> extends B implements C {
  private Map<String, List<T>> m = new HashMap<>() {{ put("a", null); }};
  static { System.out.println("}"); }
  public A#(int x) throws E { this.x = x; }
  @Override
  public <K> List<K> get(@N String s, char c) {
    String t = """
      { " text
      """;
    return foo('{');
  }
  abstract void f();
}
''', ["'A#', 'class', 1, 14, NULL", "'A#', 'method', 5, 5, 'A#'", "'get', 'method', 6, 12, 'A#'", "'f', 'method', 13, 13, 'A#'"]),
    ("java", r"""record R#(int q) { R# { } int h() { return 1; } }
enum Mode# { X { void z() {} }, Y; void inEnum() {} }
@interface Note# { String value() default "x"; }
interface P# {
  void call();
  default int d() { return 1; }
}
""", ["'R#', 'class', 1, 1, NULL", "'h', 'method', 1, 1, 'R#'", "'Mode#', 'enum', 2, 2, NULL", "'Note#', 'interface', 3, 3, NULL", "'P#', 'interface', 4, 7, NULL",
      "'call', 'method', 5, 5, 'P#'", "'d', 'method', 6, 6, 'P#'"]),
    ("go", r"""type S#[K comparable, V any] struct { a map[string]struct{} }
func (s *S#[K, V]) Get(k K) (map[string]interface{}, error) {
  return nil, `}`
}
func New#(a int,
  b func() struct{}) *S# { return nil }
""", ["'S#', 'struct', 1, 1, NULL", "'Get', 'method', 2, 4, 'S#'", "'New#', 'function', 5, 6, NULL"]),
    ("go", r"""type (
  R# interface { F() }
  A# = [3]int
)
type (
  One# func(int)
)
func ext#(x int) int
""", ["'R#', 'interface', 2, 2, NULL", "'A#', 'type', 3, 3, NULL", "'One#', 'type', 5, 7, NULL", "'ext#', 'function', 8, 8, NULL"]),
    ("python", r"""@dec(")")
def f#(x=(1,
         2)):
    def g(): pass
    return x

class A#(
    Base):
    @p
    async def m(self): pass
    class In:
        def z(self): pass
""", ["'f#', 'function', 1, 5, NULL", "'A#', 'class', 7, 12, NULL", "'m', 'method', 9, 10, 'A#'", "'In', 'class', 11, 12, 'A#'"]),
    ("python", r"""print 'no longer valid'
@dec(
    1)
def f#(x,
       y):
    '''text
def no(): '''
    return 1

class A#:
    def m(self): pass
    def n(self):
        return 2
""", ["'f#', 'function', 2, 8, NULL", "'A#', 'class', 10, 13, NULL", "'m', 'method', 11, 11, 'A#'", "'n', 'method', 12, 13, 'A#'"]),
]


def _shape_check():
    parts = []
    for i, (_, _, rows) in enumerate(_SHAPES):
        values = ", ".join(f"({r})" for r in rows)
        parts.append(f"""SELECT 'shapes' AS repo_id, 'f' || c_custkey AS path, replace(v.name, '#', CAST(c_custkey AS VARCHAR)) AS name, v.kind, v.s + c_custkey % 3 AS start_line,
 v.e + c_custkey % 3 AS end_line, replace(v.parent, '#', CAST(c_custkey AS VARCHAR)) AS parent FROM customer, (VALUES {values}) v(name, kind, s, e, parent) WHERE c_custkey % {len(_SHAPES)} = {i}""")
    return " UNION ALL ".join(parts)


@query("e10_e13_shapes", _shape_check())
def e_shapes(t):
    """Two further shapes per language, one for each customer, moved down by up to two lines."""
    which, number = c("c_custkey") % len(_SHAPES), c("c_custkey").cast("string")
    pick = lambda at: F.element_at(F.array(*[F.lit(s[at]) for s in _SHAPES]), (which + 1).cast("int"))
    text = F.concat(F.repeat(F.lit("\n"), (c("c_custkey") % 3).cast("int")), F.replace(pick(1), F.lit("#"), number))
    files = t.customer.select(F.lit("shapes").alias("repo_id"), F.concat(F.lit("f"), number).alias("path"), pick(0).alias("language"), text.alias("text"))
    return _out(extract.symbols_of(extract.parsed(files)))


@query(
    "m6_pluggable_extractor",
    " UNION ALL ".join([_symbol_check("k % 4 = 0", [r for r in _PY if "'class'" in r]), _symbol_check("k % 4 = 1", _TS), _symbol_check("k % 4 = 2", _JAVA), _symbol_check("k % 4 = 3", _GO)]),
    ("code_files",),
)
def m6(t):
    """All languages together, with the Python extractor replaced by one that keeps classes only."""

    def classes_only(language, text):
        facts = lexer.facts_of(language, text)
        return replace(facts, symbols=[s for s in facts.symbols if s[1] == "class"])

    return _out(extract.symbols_of(extract.parsed(corpus(t, "code_files"), {"python": classes_only})))


def symbol_rows(t):
    """Symbols of the code corpus for the plans that need them as input."""
    return _out(extract.symbols_of(extract.parsed(corpus(t, "code_files"))))


def _with_symbols(t, language):
    files = corpus(t, "code_files").where(c("language").isin(language))
    facts = extract.file_facts(files).select("repo_id", "path", "symbols")
    return files.join(facts, ["repo_id", "path"], "left")


def _chunk_check(where, rows):
    values = ", ".join(f"({r})" for r in rows)
    return f"""SELECT f.repo_id, f.path, replace(v.symbol, '#', CAST(k AS VARCHAR)) AS symbol, v.kind, v.s AS start_line, v.e AS end_line,
 array_to_string(string_split(text, chr(10))[v.s:v.e], chr(10)) AS content FROM code_files f, (VALUES {values}) v(symbol, kind, s, e) WHERE {where}"""


def _chunks(df, limits=chunk.ChunkLimits()):
    return chunk.chunked(df, limits).select("repo_id", "path", "symbol", "kind", "start_line", "end_line", "content")


@query(
    "e9_chunk_code",
    _chunk_check("k % 4 = 1", [
        "NULL, 'module', 1, 6", "'Shape_#', 'interface', 7, 9", "'Id', 'type', 10, 10", "'Color', 'enum', 11, 11",
        "'Service_#', 'class', 13, 26", "'arrow_#', 'function', 28, 30", "NULL, 'module', 31, 32", "'plain', 'function', 33, 38",
    ]),
    ("code_files",),
)
def e9_code(t):
    return _chunks(_with_symbols(t, _JS))


@query(
    "e6_class_members",
    _chunk_check("k % 4 = 1", [
        "NULL, 'module', 1, 6", "'Shape_#', 'interface', 7, 9", "'Id', 'type', 10, 10", "'Color', 'enum', 11, 11",
        "'Service_#', 'class', 13, 14", "'Service_#.constructor', 'method', 15, 17", "'Service_#.load', 'method', 18, 22",
        "'Service_#.handler', 'method', 23, 25", "'Service_#', 'class', 26, 26",
        "'arrow_#', 'function', 28, 30", "NULL, 'module', 31, 32", "'plain', 'function', 33, 38",
    ]),
    ("code_files",),
)
def e6(t):
    return _chunks(_with_symbols(t, _JS), chunk.ChunkLimits(max_lines=10))


@query(
    "e8_emit_parts",
    _chunk_check("k % 4 = 3", [
        "NULL, 'module', 1, 3", "NULL, 'module', 3, 4", "NULL, 'module', 4, 6", "NULL, 'module', 6, 7", "NULL, 'module', 7, 9", "'Store#', 'struct', 10, 12",
        "'Reader', 'interface', 14, 16", "NULL, 'module', 17, 18", "'ID', 'type', 19, 19", "'Pair', 'struct', 20, 22",
        "NULL, 'module', 23, 24", "'New#', 'function', 25, 27",
    ]) + """ UNION ALL SELECT f.repo_id, f.path, 'Get (part ' || v.i || '/3)', 'method', v.s, v.e,
 array_to_string(string_split(text, chr(10))[v.s:v.e], chr(10)) FROM code_files f, (VALUES (1, 29, 31), (2, 31, 33), (3, 33, 34)) v(i, s, e) WHERE k % 4 = 3""",
    ("code_files",),
)
def e8(t):
    # Go methods carry their receiver as parent, so they are not units here: cut them as functions.
    rows = _with_symbols(t, ["go"]).withColumn(
        "symbols",
        F.transform("symbols", lambda s: s.withField("parent", F.lit(None).cast("string"))),
    )
    return _chunks(rows, chunk.ChunkLimits(max_lines=3, split_overlap=1, window=4, window_overlap=1))


# --- manifests --------------------------------------------------------------------------------


def _by_kind(rows, columns):
    return f"(VALUES {', '.join(f'({r})' for r in rows)}) v(rest, {columns})"


_DEPS = _by_kind(
    ["0, 0, 'react', 'js'", "0, 1, 'left-pad-#', 'js'", "0, 2, 'Express', 'js'", "0, 3, 'jest', 'js'",
     "1, 0, 'django', 'python'", "1, 1, 'click', 'python'", "1, 2, 'unknown-#', 'python'", "1, 3, 'uvicorn', 'python'",
     "1, 4, 'pytest', 'python'", "1, 5, 'fastapi', 'python'", "2, 0, 'flask', 'python'", "2, 1, 'numpy', 'python'",
     "2, 3, '-r', 'python'", "2, 4, 'scikit-learn', 'python'", "3, 0, 'celery', 'python'", "3, 1, 'pandas', 'python'"],
    "pos, dependency, ecosystem",
)


@query(
    "e15_dependencies",
    f"SELECT repo_id, path, pos, replace(dependency, '#', CAST(k AS VARCHAR)) AS dependency, ecosystem FROM manifest_files JOIN {_DEPS} ON k % 12 = rest",
    ("manifest_files",),
)
def e15(t):
    return manifests.dependencies(corpus(t, "manifest_files")).select("repo_id", "path", "pos", "dependency", "ecosystem")


_MARKS = _by_kind(
    ["4, 'GORM'", "4, 'Gin'", "5, 'Spring Boot'", "5, 'JUnit'", "6, 'Quarkus'", "6, 'Lombok'", "7, 'Ruby on Rails'", "9, 'Docker'"], "label"
)
_MARKS_SQL = f"""SELECT repo_id, path, label FROM manifest_files JOIN {_MARKS} ON k % 12 = rest
 UNION ALL SELECT repo_id, path, 'Laravel' FROM manifest_files WHERE k % 24 = 8
 UNION ALL SELECT repo_id, path, 'Docker Compose' FROM manifest_files WHERE k % 24 = 22"""


@query("e16_markers", _MARKS_SQL, ("manifest_files",))
def e16(t):
    return manifests.markers(corpus(t, "manifest_files")).select("repo_id", "path", "label")


_ORDERED = _by_kind(
    # Root files by path, then deeper ones: rank of each label inside a complete repository.
    ["9, 'Docker', 10", "7, 'Ruby on Rails', 20", "6, 'Quarkus', 30", "6, 'Lombok', 31", "4, 'GORM', 50", "4, 'Gin', 51",
     "1, 'Django', 70", "1, 'Click', 71", "1, 'pytest', 72", "1, 'FastAPI', 73", "2, 'Flask', 80", "2, 'NumPy', 81",
     "2, 'scikit-learn', 82", "5, 'Spring Boot', 90", "5, 'JUnit', 91", "3, 'Celery', 95", "3, 'pandas', 96"],
    "label, ord",
)


@query(
    "e17_frameworks",
    f"""WITH l AS (SELECT repo_id, label, ord FROM manifest_files JOIN {_ORDERED} ON k % 12 = rest
 UNION ALL SELECT repo_id, 'Laravel', 41 FROM manifest_files WHERE k % 24 = 8
 UNION ALL SELECT repo_id, 'Docker Compose', 40 FROM manifest_files WHERE k % 24 = 22
 UNION ALL SELECT repo_id, 'GitHub Actions', 999 FROM manifest_files WHERE k % 24 = 10
 UNION ALL SELECT repo_id, v.label, v.ord + CASE WHEN k % 24 = 0 THEN 60 ELSE 97 END FROM manifest_files, (VALUES ('React', 0), ('Express', 1), ('Jest', 2)) v(label, ord) WHERE k % 12 = 0)
 SELECT repo_id, label, row_number() OVER (PARTITION BY repo_id ORDER BY ord) AS position FROM l""",
    ("manifest_files",),
)
def e17(t):
    return manifests.frameworks(corpus(t, "manifest_files"))


@query(
    "e18_run_scripts",
    """WITH s AS (SELECT repo_id, replace(v.script, '#', CAST(k AS VARCHAR)) AS script, replace(v.command, '#', CAST(k AS VARCHAR)) AS command,
 v.ord + CASE WHEN k % 24 = 12 THEN 100 ELSE 0 END AS ord FROM manifest_files JOIN (VALUES (11, 'make build', '', 1), (11, 'make test-all', '', 2),
 (0, 'npm run dev', 'vite', 3), (0, 'npm run test', 'jest -n #', 4), (1, 'serve#', 'app:main', 5)) v(rest, script, command, ord) ON k % 12 = rest)
 SELECT repo_id, script, command, row_number() OVER (PARTITION BY repo_id ORDER BY ord) AS position FROM s""",
    ("manifest_files",),
)
def e18(t):
    return manifests.run_scripts(corpus(t, "manifest_files"))


@query(
    "e16_package_managers",
    """SELECT repo_id, m AS manager FROM (SELECT DISTINCT repo_id, CASE k % 12 WHEN 0 THEN 'npm' WHEN 1 THEN 'poetry' WHEN 2 THEN 'pip' WHEN 4 THEN 'go modules'
 WHEN 5 THEN 'Maven' WHEN 6 THEN 'Gradle' WHEN 7 THEN 'Bundler' WHEN 8 THEN 'Composer' END AS m FROM manifest_files) WHERE m IS NOT NULL""",
    ("manifest_files",),
)
def e16_managers(t):
    return manifests.package_managers(corpus(t, "manifest_files")).select("repo_id", "manager")


@query(
    "e16_go_modules",
    "SELECT repo_id, 'example.com/r' || k AS go_module FROM manifest_files WHERE k % 12 = 4",
    ("manifest_files",),
)
def e16_go(t):
    return manifests.go_modules(corpus(t, "manifest_files"))
