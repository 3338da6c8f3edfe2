"""Scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import paths as P
from corpusloom.functions import text as X
from corpusloom.plans.files import doc_index, sql_list
from corpusloom.plans.registry import query
from corpusloom.sources.corpora import corpus

c = F.col


@query(
    "c1_blob_sha",
    "SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text)) || chr(0) || text)) AS sha FROM documents",
)
def c1(t):
    return t.documents.select("doc_id", X.blob_sha(c("text")).alias("sha"))


_EMBED_SQL = (
    "('File: ' || path || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Symbol: s' || doc_id || chr(10) "
    "ELSE '' END || text)"
)


def _with_symbol(t):
    symbol = F.when(c("doc_id") % 2 == 0, F.concat(F.lit("s"), c("doc_id").cast("string")))
    return corpus(t, "doc_files").withColumn("symbol", symbol)


@query("c2_embedding_text", f"SELECT doc_id, {_EMBED_SQL} AS text FROM doc_files", ("doc_files",))
def c2(t):
    return _with_symbol(t).select(
        "doc_id", X.embedding_text(c("path"), c("symbol"), c("text")).alias("text")
    )


@query(
    "c3_embed_hash",
    f"SELECT doc_id, sha256(encode('hash-384' || chr(0) || {_EMBED_SQL})) AS hash FROM doc_files",
    ("doc_files",),
)
def c3(t):
    text = X.embedding_text(c("path"), c("symbol"), c("text"))
    return _with_symbol(t).select("doc_id", X.embed_hash(F.lit("hash-384"), text).alias("hash"))


@query(
    "c4_line_counts",
    "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count, "
    "len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN 1 ELSE 0 END "
    "AS n_lines FROM (SELECT doc_id, text || CASE WHEN doc_id % 4 = 0 THEN chr(10) ELSE '' END AS text FROM documents)",
)
def c4(t):
    text = F.expr("text || CASE WHEN doc_id % 4 = 0 THEN chr(10) ELSE '' END")
    return t.documents.withColumn("text", text).select(
        "doc_id", X.line_count(c("text")).alias("line_count"), F.size(X.lines(c("text"))).alias("n_lines")
    )


@query(
    "c5_module_and_group",
    """SELECT repo_id, path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS module,
 CASE WHEN contains(path, '/') THEN array_to_string((string_split(path, '/')[:-2])[1:2], '/') || '/' ELSE '(root files)' END AS grp
 FROM tree_files""",
    ("tree_files",),
)
def c5(t):
    return corpus(t, "tree_files").select(
        "repo_id", "path", P.module_of(c("path")).alias("module"), P.group_of(c("path")).alias("grp")
    )


@query(
    "c6_ancestors",
    """SELECT repo_id, path, array_to_string((string_split(path, '/'))[1:i], '/') AS dir FROM (SELECT repo_id, path,
 unnest(range(1, len(string_split(path, '/')))) AS i FROM tree_files)""",
    ("tree_files",),
)
def c6(t):
    return corpus(t, "tree_files").select("repo_id", "path", F.explode(P.ancestors(c("path"))).alias("dir"))


_RAW = """CASE k % 8 WHEN 0 THEN ' ./' || path || ':12-20 ' WHEN 1 THEN '`' || path || '#L5`'
 WHEN 2 THEN '/' || path WHEN 3 THEN replace(path, '/', chr(92)) WHEN 4 THEN upper(repo_id) || '/app/' || path
 WHEN 5 THEN path || '#L7-L9' WHEN 6 THEN 'x/../' || path ELSE 'App/' || path || ':3' END"""


@query(
    "c7_normalise_path",
    f"""SELECT k, path AS clean, CASE k % 8 WHEN 0 THEN 12 WHEN 1 THEN 5 WHEN 5 THEN 7 WHEN 7 THEN 3 END AS s,
 CASE k % 8 WHEN 0 THEN 20 WHEN 1 THEN 5 WHEN 5 THEN 9 WHEN 7 THEN 3 END AS e FROM tree_files""",
    ("tree_files",),
)
def c7(t):
    raw = corpus(t, "tree_files").withColumn("raw", F.expr(_RAW.replace("chr(92)", "char(92)")))
    start, end = P.reference_lines(c("raw"))
    name = F.concat(F.lower("repo_id"), F.lit("/app"))
    clean = P.without_repo_prefix(P.reference_path(c("raw")), name)
    return raw.select("k", clean.alias("clean"), start.alias("s"), end.alias("e"))


@query(
    "c8_repo_url",
    """SELECT k, CASE k % 6 WHEN 5 THEN NULL ELSE 'Owner' || k END AS owner, CASE k % 6 WHEN 5 THEN NULL ELSE 'repo.' || k END AS name,
 CASE k % 6 WHEN 5 THEN NULL ELSE 'github.com/owner' || k || '/repo.' || k END AS url_key FROM tree_files""",
    ("tree_files",),
)
def c8(t):
    url = """CASE k % 6 WHEN 0 THEN ' https://github.com/Owner' || k || '/repo.' || k || '.git'
     WHEN 1 THEN 'github.com/Owner' || k || '/repo.' || k WHEN 2 THEN 'Owner' || k || '/repo.' || k
     WHEN 3 THEN 'git@github.com:Owner' || k || '/repo.' || k || '.git'
     WHEN 4 THEN 'HTTP://www.github.com/Owner' || k || '/repo.' || k || '/tree/main'
     ELSE 'https://example.org/Owner' || k || '/r' END"""
    rows = corpus(t, "tree_files").select("k", F.expr(url).alias("url"))
    return rows.select("k", P.repo_ref(c("url")).alias("r")).select("k", "r.owner", "r.name", "r.url_key")


CODE_TOKENS_SQL = """list_distinct(list_transform(list_concat(regexp_extract_all({0}, '[A-Za-z0-9]+'),
 regexp_extract_all(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')),
 lambda x: lower(x)))"""


@query(
    "c9_code_tokens",
    f"SELECT doc_id, unnest({CODE_TOKENS_SQL.format('text')}) AS token FROM documents UNION ALL "
    f"SELECT -1 - k, unnest({CODE_TOKENS_SQL.format('text')}) FROM code_files",
    ("code_files",),
)
def c9(t):
    docs = t.documents.select("doc_id", F.explode(X.code_tokens(c("text"))).alias("token"))
    code = corpus(t, "code_files").select((-1 - c("k")).alias("doc_id"), F.explode(X.code_tokens(c("text"))).alias("token"))
    return docs.union(code)


_TERM = "'Mod' || k || '.run_' || k || '(a, b)'"


@query(
    "c10_keys_and_kinds",
    """SELECT k, 'run_' || k AS term, rtrim(regexp_replace('api_layer_' || k || '_' || lower(replace(repo_id, ' ', '_')), '_+$', '')) AS slug,
 CASE k % 3 WHEN 0 THEN 'flow_trace' WHEN 1 THEN 'testing' ELSE 'other' END AS kind,
 CASE k % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'util' WHEN 2 THEN 'data' WHEN 3 THEN 'ui' END AS hint FROM code_files""",
    ("code_files",),
)
def c10(t):
    rows = corpus(t, "code_files")
    kind = F.expr("CASE k % 3 WHEN 0 THEN ' Flow-Trace' WHEN 1 THEN 'Testing' ELSE 'Unheard of' END")
    words = F.expr("CASE k % 5 WHEN 0 THEN 'spec files' WHEN 1 THEN 'shared code' WHEN 2 THEN 'the models' WHEN 3 THEN 'web pages' ELSE 'engine' END")
    return rows.select(
        "k",
        X.term_key(F.expr(_TERM)).alias("term"),
        X.slug(F.concat(F.lit("API Layer "), c("k").cast("string"), F.lit(": "), "repo_id", F.lit("!"))).alias("slug"),
        X.coerced_kind(kind, fixed.TOUR_KINDS).alias("kind"),
        X.kind_hint(words).alias("hint"),
    )


_FLAT = "trim(regexp_replace(text, '[\\s]+', ' ', 'g'))"


@query(
    "c11_clip_and_label",
    f"""SELECT conv_id, turn, CASE WHEN length({_FLAT}) <= 80 THEN {_FLAT} ELSE left({_FLAT}, 79) || '…' END AS clip,
 CASE WHEN length(lab) <= 48 THEN lab ELSE rtrim(left(lab, 47)) || '…' END AS label,
 replace(text || '</repo_content>', '</repo_content', '<' || chr(92) || '/repo_content') AS escaped
 FROM (SELECT *, trim(regexp_replace(regexp_replace(replace('["' || text, '"', ''''), '[<>{{}}\\[\\]|`#;&\\\\]', '', 'g'), '\\s+', ' ', 'g')) AS lab FROM conversations)""",
)
def c11(t):
    return t.conversations.select(
        "conv_id",
        "turn",
        X.clipped(c("text"), fixed.TITLE_CHARS).alias("clip"),
        X.safe_label(F.concat(F.lit('["'), c("text"))).alias("label"),
        X.escaped_content(F.concat(c("text"), F.lit("</repo_content>"))).alias("escaped"),
    )


@query(
    "c12_citation_text",
    """SELECT k, CASE k % 3 WHEN 0 THEN '[' || path || ']' WHEN 1 THEN '[' || path || ':' || (k % 50 + 1) || ']'
 ELSE '[' || path || ':' || (k % 50 + 1) || '-' || (k % 50 + 4) || ']' END AS cite,
 'https://h/' || repo_id || '/blob/abc/' || replace(path, '_', '%20') || CASE WHEN k % 50 = 0 AND k % 100 = 0 THEN ''
 ELSE '#L' || (k % 50 + 1) || CASE WHEN k % 3 = 1 THEN '' ELSE '-L' || (k % 50 + 4) END END AS link FROM code_files""",
    ("code_files",),
)
def c12(t):
    rows = corpus(t, "code_files")
    start = F.expr("CASE WHEN k % 3 = 0 THEN NULL ELSE k % 50 + 1 END")
    end = F.expr("CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN k % 50 + 1 ELSE k % 50 + 4 END")
    s, e = F.expr("k % 50 + 1"), F.expr("CASE WHEN k % 3 = 1 THEN k % 50 + 1 ELSE k % 50 + 4 END")
    total = F.when(c("k") % 100 == 0, e).otherwise(F.lit(1000))
    url = F.concat(F.lit("https://h/"), c("repo_id"))
    return rows.select(
        "k",
        X.citation(c("path"), start, end).alias("cite"),
        X.blob_link(url, F.lit("abc"), F.replace("path", F.lit("_"), F.lit(" ")), s, e, total).alias("link"),
    )


@query(
    "c13_redaction",
    """SELECT event_id, 'user ' || user_id || ' sent [REDACTED] and [REDACTED]' AS line, '[REDACTED]' AS auth,
 CAST(user_id AS VARCHAR) AS tokens, 'key [REDACTED]' AS note FROM events""",
)
def c13(t):
    line = F.expr("concat('user ', user_id, ' sent ghp_', lpad(event_id, 24, '0'), ' and Bearer a.b-', event_id)")
    pairs = F.create_map(
        F.lit("Authorization"), F.lit("Basic abc"),
        F.lit("prompt_tokens"), c("user_id").cast("string"),
        F.lit("note"), F.expr("concat('key sk-', lpad(event_id, 20, 'x'))"),
    )
    rows = t.events.select("event_id", X.scrubbed(line).alias("line"), X.scrubbed_map(pairs).alias("m"))
    return rows.select("event_id", "line", c("m.Authorization").alias("auth"), c("m.prompt_tokens").alias("tokens"), "m.note")


@query(
    "c14_cost",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(l_partkey / 1000 * 0.5 + l_suppkey / 1000 * 2.0, 6) AS est_cost FROM lineitem",
)
def c14(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        X.cost(c("l_partkey"), c("l_suppkey"), 0.5, 2.0).alias("est_cost"),
    )


@query(
    "c15_display_name",
    """SELECT repo_id, path, CASE language WHEN 'tsx' THEN 'TypeScript' WHEN 'javascript' THEN 'JavaScript' WHEN 'typescript' THEN 'TypeScript'
 WHEN 'cpp' THEN 'C++' ELSE upper(left(language, 1)) || substr(language, 2) END AS display FROM (SELECT repo_id, path,
 CASE WHEN path LIKE '%.cpp' THEN 'cpp' WHEN path LIKE '%.tsx' THEN 'tsx' WHEN path LIKE '%.ts' THEN 'typescript' ELSE 'rust' END AS language FROM tree_files)""",
    ("tree_files",),
)
def c15(t):
    lang = F.expr("CASE WHEN path LIKE '%.cpp' THEN 'cpp' WHEN path LIKE '%.tsx' THEN 'tsx' WHEN path LIKE '%.ts' THEN 'typescript' ELSE 'rust' END")
    return corpus(t, "tree_files").select("repo_id", "path", X.display_name(lang).alias("display"))


@query(
    "c16_tool_summary",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'Searching for ''k' || user_id || '''' WHEN 'view' THEN 'Reading ''p' || user_id || ''''
 WHEN 'error' THEN 'Grepping for ''p' || user_id || ''' (failed: bad_pattern)' WHEN 'signup' THEN 'Reading repository metadata'
 ELSE 'Calling purchase ''m' || user_id || '''' END AS summary FROM events""",
)
def c16(t):
    name = F.expr("CASE event_type WHEN 'click' THEN 'search_code' WHEN 'view' THEN 'read_file' WHEN 'error' THEN 'grep' WHEN 'signup' THEN 'get_repo_metadata' ELSE event_type END")
    args = F.expr("""CASE event_type WHEN 'click' THEN concat('{"query":"k', user_id, '","path":"x"}')
     WHEN 'view' THEN concat('{"query":"","path":"p', user_id, '"}') WHEN 'error' THEN concat('{"pattern":"p', user_id, '"}')
     WHEN 'signup' THEN 'not json' ELSE concat('{"module":"m', user_id, '"}') END""")
    failed = F.when(c("event_type") == "error", F.lit("bad_pattern"))
    return t.events.select("event_id", X.tool_summary(name, args, c("event_type") != "error", failed).alias("summary"))


@query(
    "c17_first_json",
    "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE user_id END AS u FROM events",
)
def c17(t):
    reply = F.expr("""CASE event_id % 4 WHEN 0 THEN concat('<think>{"u":0}</think>ok ```json\n{"u": ', user_id, '}\n``` {"u":1}')
     WHEN 1 THEN concat('Sure: {"u": ', user_id, ', "x": [1]} hope it helps') WHEN 2 THEN concat('```\n{"u":', user_id, '}```') ELSE 'no object' END""")
    return t.events.select("event_id", F.try_variant_get(X.first_json(reply), "$.u", "bigint").alias("u"))


@query(
    "c18_numbers",
    """SELECT event_id, greatest(1, CAST(round_even(value / 60, 0) AS BIGINT)) AS minutes, CAST(floor(least(greatest(value / 100 - 0.1, 0), 1) * 100) AS BIGINT) AS pct,
 CAST(floor(floor(value * 10) / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(value * 10) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS took FROM events""",
)
def c18(t):
    return t.events.select(
        "event_id",
        X.rounded_minutes(c("value")).alias("minutes"),
        X.percent(c("value") / 100 - 0.1).alias("pct"),
        X.elapsed(c("value") * 10).alias("took"),
    )
