"""Chunking over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import chunk as op
from corpusloom.plans.registry import query
from corpusloom.sources.corpora import corpus

c = F.col

LINES = """CASE WHEN text = '' THEN [] WHEN text LIKE '%' || chr(10)
 THEN string_split(left(text, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END"""
_DOC = f"d AS (SELECT doc_id, repo_id, path, ls, len(ls) AS n FROM (SELECT *, {LINES} AS ls FROM doc_files))"


@query(
    "e1_file_lines",
    f"WITH {_DOC} SELECT repo_id, path, i AS line_no, ls[i] AS line FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM d)",
    ("doc_files",),
)
def e1(t):
    return op.file_lines(corpus(t, "doc_files"))


def _windows_sql(size, overlap, table="d", start="1", end="n"):
    step = size - overlap
    return f"""SELECT *, {start} + i * {step} AS s, least({end}, {start} + i * {step} + {size - 1}) AS e FROM (SELECT *,
 unnest(range(0, CAST(greatest(ceil(({end} - {start} + 1 - {size}) / {step}), 0) AS INTEGER) + 1)) AS i FROM {table}) WHERE n > 0"""


@query(
    "e2_line_windows",
    f"WITH {_DOC} SELECT repo_id, path, s AS start_line, e AS end_line FROM ({_windows_sql(12, 5)})",
    ("doc_files",),
)
def e2(t):
    lines = op.X.lines(c("text"))
    rows = corpus(t, "doc_files").select("repo_id", "path", F.size(lines).alias("n"))
    spans = op.windows(F.lit(1), c("n"), 12, 5)
    return rows.select("repo_id", "path", F.inline(spans)).withColumnsRenamed(
        {"start": "start_line", "end": "end_line"}
    )


@query(
    "e3_size_test",
    f"""WITH {_DOC} SELECT doc_id, n <= 120 AND length(array_to_string(ls, chr(10))) <= 6000 AS whole,
 least(n, 20) <= 120 AND length(array_to_string(ls[1:20], chr(10))) <= 6000 AS head FROM d""",
    ("doc_files",),
)
def e3(t):
    rows = corpus(t, "doc_files").withColumn("ls", op.X.lines(c("text")))
    limits, n = op.ChunkLimits(), F.size("ls")
    return rows.select(
        "doc_id",
        op.fits(c("ls"), F.lit(1), n, limits).alias("whole"),
        op.fits(c("ls"), F.lit(1), F.least(n, F.lit(20)), limits).alias("head"),
    )


def _packed_sql(windows, cap):
    """Greedy packing of each window by a recursive walk over its lines."""
    return f"""w AS ({windows}),
 walk AS (SELECT path, s, e, s AS pos, s AS a, CAST(length(ls[s]) AS BIGINT) AS size FROM w UNION ALL
   SELECT k.path, k.s, k.e, k.pos + 1, CASE WHEN k.size + length(w.ls[k.pos + 1]) + 1 <= {cap} THEN k.a ELSE k.pos + 1 END,
   CASE WHEN k.size + length(w.ls[k.pos + 1]) + 1 <= {cap} THEN k.size + length(w.ls[k.pos + 1]) + 1 ELSE length(w.ls[k.pos + 1]) END
   FROM walk k JOIN w ON w.path = k.path AND w.s = k.s AND w.e = k.e WHERE k.pos < k.e),
 spans AS (SELECT path, s, e, a, max(pos) AS b FROM walk GROUP BY 1, 2, 3, 4)"""


@query(
    "e4_char_bounded",
    f"WITH RECURSIVE {_DOC}, {_packed_sql(_windows_sql(20, 4), 500)} SELECT path, a AS start_line, b AS end_line, count(*) AS n FROM spans GROUP BY 1, 2, 3",
    ("doc_files",),
)
def e4(t):
    limits = op.ChunkLimits(max_lines=20, split_overlap=4, max_chars=500)
    rows = corpus(t, "doc_files").withColumn("ls", op.X.lines(c("text")))
    spans = op.char_bounded(c("ls"), F.lit(1), F.size("ls"), limits)
    return (
        rows.select("path", F.inline(spans))
        .groupBy("path", c("start").alias("start_line"), c("end").alias("end_line"))
        .agg(F.count("*").alias("n"))
    )


_SPANS = """sp AS (SELECT l_orderkey AS file_id, l_linenumber AS span_id, CAST(l_partkey % 90 + 1 AS INT) AS start_line,
 CAST(l_partkey % 90 + 1 + l_quantity AS INT) AS end_line FROM lineitem),
 u AS (SELECT file_id, span_id, start_line, end_line FROM (SELECT *, max(end_line) OVER (PARTITION BY file_id ORDER BY
 start_line, end_line DESC, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM sp) WHERE r IS NULL OR end_line > r)"""


def order_spans(t):
    """One file per order, one line span per line item."""
    return t.lineitem.selectExpr(
        "l_orderkey AS file_id",
        "l_linenumber AS span_id",
        "CAST(l_partkey % 90 + 1 AS INT) AS start_line",
        "CAST(l_partkey % 90 + 1 + l_quantity AS INT) AS end_line",
    ).groupBy("file_id", "span_id", "start_line", "end_line").count().drop("count")


@query(
    "e5_top_level_units",
    f"WITH {_SPANS} SELECT DISTINCT file_id, start_line, end_line FROM u",
)
def e5(t):
    return op.top_level_spans(order_spans(t), ["file_id"]).select("file_id", "start_line", "end_line")


@query(
    "e7_module_gaps",
    f"""WITH {_SPANS}, g AS (SELECT file_id, coalesce(lag(end_line) OVER (PARTITION BY file_id ORDER BY start_line), 0) + 1 AS a,
 start_line - 1 AS b FROM (SELECT DISTINCT file_id, start_line, end_line FROM u) UNION ALL SELECT file_id, max(end_line) + 1, 160 FROM u GROUP BY 1)
 SELECT file_id, a AS start_line, b AS end_line FROM g WHERE a <= b""",
)
def e7(t):
    spans = order_spans(t)
    totals = spans.select("file_id").distinct().withColumn("n_lines", F.lit(160))
    return op.gaps(spans, totals, ["file_id"])


@query(
    "e9_chunk_documents",
    f"""WITH RECURSIVE {_DOC}, win AS ({_windows_sql(80, 15)}),
 fit AS (SELECT *, length(array_to_string(ls[s:e], chr(10))) <= 6000 AND e - s < 120 AS whole FROM win),
 big AS (SELECT repo_id, path, ls, n, s AS ws, e AS we, s, e FROM fit WHERE NOT whole), {_packed_sql("SELECT * FROM big", 6000)},
 out AS (SELECT repo_id, path, s, e, ls FROM fit WHERE whole UNION ALL
   SELECT big.repo_id, big.path, spans.a, spans.b, big.ls FROM spans JOIN big ON spans.path = big.path AND spans.s = big.s AND spans.e = big.e)
 SELECT repo_id, path, 'text' AS language, NULL AS symbol, 'file' AS kind, s AS start_line, e AS end_line,
 array_to_string(ls[s:e], chr(10)) AS content FROM out WHERE regexp_matches(array_to_string(ls[s:e], chr(10)), '[^\\s]')""",
    ("doc_files",),
)
def e9_documents(t):
    return op.chunked(corpus(t, "doc_files"))
