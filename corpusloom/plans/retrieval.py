"""Embedding and search over the given tables."""

from __future__ import annotations

import hashlib
import re

import numpy as np

from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import text as X
from corpusloom.operators import embed, search, textindex, vectorindex
from corpusloom.plans.registry import query
from corpusloom.plans.scalars import CODE_TOKENS_SQL
from corpusloom.session import durable_path
from corpusloom.sources.corpora import corpus

c = F.col


def doc_chunks(t):
    """Every document as one searchable passage."""
    text = c("text")
    return corpus(t, "doc_files").select(
        "doc_id",
        "repo_id",
        "path",
        F.concat(F.lit("getDocById"), c("doc_id").cast("string")).alias("symbol"),
        F.lit(1).alias("start_line"),
        F.size(X.lines(text)).alias("end_line"),
        text.alias("content"),
        c("doc_id").alias("chunk_id"),
    )


def questions(t):
    """Benchmark texts, each asked of one source."""
    return t.benchmark.select(
        c("item_id").alias("query_id"), F.concat(F.lit("src"), (c("item_id") % 20).cast("string")).alias("repo_id"), "text"
    )


def question_vectors(t, dimensions):
    vectors = embed.hashing_embeddings(t.benchmark.select("item_id", "text"), "item_id", dimensions)
    return vectors.select(c("item_id").alias("query_id"), c("embedding").alias("vector"))


def chunk_vectors(t):
    """Vectors of the passages; the repository is read off the row, so nothing is joined."""
    texts = corpus(t, "doc_files").select(F.struct("doc_id", "repo_id").alias("at"), "text")
    vectors = embed.hashing_embeddings(texts, "at")
    return vectors.select(c("at.doc_id").alias("chunk_id"), c("at.repo_id").alias("repo_id"), "embedding")


_BUCKET = "CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) % {0}"


def weights_sql(table, key, text, dims):
    return f"""(SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS weight FROM (SELECT {key}, {_BUCKET.format(dims)} AS bucket,
 CAST(count(*) AS DOUBLE) AS n FROM (SELECT {key}, md5(unnest({CODE_TOKENS_SQL.format(text)})) AS h FROM {table}) GROUP BY 1, 2))"""


_CHUNKS = """ch AS (SELECT doc_id AS chunk_id, repo_id, path, 'getDocById' || doc_id AS symbol, 1 AS start_line, text AS content FROM doc_files),
 qs AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS repo_id, text FROM benchmark)"""
_VECTOR = f"""qw AS {weights_sql('qs', 'query_id', 'text', 384)}, cw AS {weights_sql('ch', 'chunk_id', 'content', 384)},
 vs AS (SELECT q.query_id, chunk_id, round(coalesce(sum(qw.weight * cw.weight), 0), 9) AS score FROM qs q JOIN ch USING (repo_id)
   LEFT JOIN (SELECT * FROM qw) qw ON qw.query_id = q.query_id LEFT JOIN (SELECT * FROM cw) cw USING (chunk_id, bucket) GROUP BY 1, 2),
 vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs)"""
_OVERLAP = f"""qt AS (SELECT query_id, repo_id, unnest({CODE_TOKENS_SQL.format('text')}) AS token FROM qs),
 ct AS (SELECT chunk_id, repo_id, path, start_line, unnest({CODE_TOKENS_SQL.format('content')}) AS token, 1 AS w FROM ch
   UNION ALL SELECT chunk_id, repo_id, path, start_line, unnest({CODE_TOKENS_SQL.format('symbol')}), 3 FROM ch
   UNION ALL SELECT chunk_id, repo_id, path, start_line, unnest({CODE_TOKENS_SQL.format('path')}), 2 FROM ch),
 ts AS (SELECT query_id, chunk_id, path, start_line, sum(w) AS score FROM qt JOIN ct USING (repo_id, token) GROUP BY 1, 2, 3, 4),
 tr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, start_line, chunk_id) AS rank FROM ts)"""
_FUSED = """fu AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score, string_agg(source || '=' || rank, ',' ORDER BY source) AS sources
   FROM (SELECT query_id, chunk_id, rank, 'vector' AS source FROM vr WHERE rank <= 30 UNION ALL SELECT query_id, chunk_id, rank, 'text' FROM tr WHERE rank <= 30) GROUP BY 1, 2),
 fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, path, start_line, chunk_id) AS rank FROM fu JOIN (SELECT chunk_id, path, start_line FROM ch) USING (chunk_id))"""
DOCS = ("doc_files",)


@query(
    "m4_hashing_embedder",
    f"SELECT doc_id, bucket, round(weight, 9) AS weight FROM {weights_sql('documents', 'doc_id', 'text', 384)}",
)
def m4(t):
    return embed.hashing_weights(t.documents, "doc_id").withColumn("weight", F.round("weight", 9))


_UNIT = "list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y))))"


@query(
    "m3_normalise",
    f"SELECT vec_id, round(list_sum({_UNIT}), 6) AS total, len(embedding) AS dims FROM embeddings",
)
def m3(t):
    vector = embed.checked(embed.normalised(F.transform("embedding", lambda x: x.cast("double") * 3)), 64)
    total = F.round(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x), 6)
    return t.embeddings.select("vec_id", total.alias("total"), F.size(vector).alias("dims"))


def _hashing_provider(dimensions):
    """The hashing embedder as a plug-in model (local class: travels to the workers by value)."""

    class Provider:
        model_name = f"hash-{dimensions}"

        def __init__(self):
            self.dimensions = dimensions

        def embed_documents(self, texts):
            return [self.embed_query(text) for text in texts]

        def embed_query(self, text):
            tokens = {t.lower() for pattern in (fixed.WORD, fixed.WORD_PART) for t in re.findall(pattern, text)}
            heads = b"".join(hashlib.md5(t.encode()).digest()[:4] for t in tokens)
            counts = np.bincount(np.frombuffer(heads, "<u4") % self.dimensions, minlength=self.dimensions)
            return (counts / max(np.linalg.norm(counts), 1.0)).tolist()

    return Provider


@query(
    "m1_provider_run",
    f"SELECT doc_id AS id, bucket, round(weight, 9) AS weight FROM {weights_sql('documents', 'doc_id', 'text', 96)}",
)
def m1(t):
    """A Python model called in batches of 64 inside the tasks (M1, M2)."""
    texts = t.documents.select(c("doc_id").alias("id"), "text")
    rows = embed.run_provider(texts, _hashing_provider(96), key="id")
    long = rows.select("id", F.posexplode("embedding").alias("bucket", "weight")).where("weight <> 0")
    return long.withColumn("weight", F.round("weight", 9))


@query(
    "m2_batched_retry",
    f"SELECT doc_id AS id, bucket, round(weight, 9) AS weight FROM {weights_sql('documents', 'doc_id', 'text', 32)}",
)
def m2(t):
    """Small batches from a model whose every second call fails: each batch is tried again."""
    base = _hashing_provider(32)

    class Flaky(base):
        calls = 0

        def embed_documents(self, texts):
            self.calls += 1
            if self.calls % 2:
                raise ConnectionError("busy")
            return [self.embed_query(x) for x in texts]

    texts = t.documents.select(c("doc_id").alias("id"), "text")
    rows = embed.run_provider(texts, Flaky, key="id", batch=16, retries=2)
    long = rows.select("id", F.posexplode("embedding").alias("bucket", "weight")).where("weight <> 0")
    return long.withColumn("weight", F.round("weight", 9))


_HASHED = """hs AS (SELECT doc_id, repo_id, sha256(encode('hash-384' || chr(0) || 'File: ' || lang || '/' || chr(10) || text)) AS h, doc_id % 3 = 0 AS stored
 FROM (SELECT doc_id, source AS repo_id, lang, text FROM documents))"""


def _hashed(t):
    rows = t.documents.select(
        "doc_id", c("source").alias("repo_id"), F.concat("lang", F.lit("/")).alias("path"), F.lit(None).cast("string").alias("symbol"), c("text").alias("content")
    )
    chunks = embed.with_embed_hash(rows, "hash-384")
    stored = chunks.where("doc_id % 3 = 0")
    vectors = embed.hashing_embeddings(stored.select("doc_id", "text"), "doc_id", 16)
    return chunks, stored.select("doc_id", "embed_hash").join(vectors, "doc_id")


@query(
    "d15_vector_reuse",
    f"WITH {_HASHED}, old AS (SELECT DISTINCT h FROM hs WHERE stored) SELECT doc_id, h AS embed_hash, 16 AS dims, h IN (SELECT h FROM old) AS reused FROM hs",
)
def d15(t):
    chunks, stored = _hashed(t)
    out = embed.embedded(chunks, stored, lambda todo: embed.hashing_embeddings(todo, "embed_hash", 16))
    known = stored.select("embed_hash").distinct().withColumn("reused", F.lit(True))
    return out.join(known, "embed_hash", "left").select(
        "doc_id", "embed_hash", F.size("embedding").alias("dims"), F.coalesce("reused", F.lit(False)).alias("reused")
    )


@query(
    "f15_embed_report",
    f"""WITH {_HASHED} SELECT repo_id, count(*) AS total, count(*) FILTER (WHERE h IN (SELECT h FROM hs WHERE stored)) AS reused,
 count(*) FILTER (WHERE h NOT IN (SELECT h FROM hs WHERE stored)) AS embedded FROM hs GROUP BY 1""",
)
def f15(t):
    chunks, stored = _hashed(t)
    return embed.embed_report(chunks, stored)


_J1_QUERIES = f"""qw AS {weights_sql('benchmark', 'item_id', 'text', 64)},
 qv AS (SELECT i.item_id AS query_id, (i.item_id % 10) AS label, list(coalesce(weight, 0) ORDER BY b) AS vector FROM (SELECT item_id FROM benchmark) i CROSS JOIN
   (SELECT unnest(range(0, 64)) AS b) LEFT JOIN qw ON qw.item_id = i.item_id AND bucket = b GROUP BY 1, 2)"""


def _label_queries(t):
    return question_vectors(t, 64).withColumn("repo_id", (c("query_id") % 10).cast("string"))


def _label_chunks(t):
    return t.embeddings.select(c("vec_id").alias("chunk_id"), c("label").cast("string").alias("repo_id"), "embedding")


_J1 = f"""WITH {_J1_QUERIES}, s AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(vector::DOUBLE[], embedding::DOUBLE[]), 9) AS score FROM qv JOIN embeddings USING (label))
 SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10"""


@query("j1_vector_topk", _J1)
def j1(t):
    return search.vector_search(_label_queries(t), _label_chunks(t), 10).withColumn("score", F.round("score", 6))


@query("j1_stored_index", _J1)
def j1_stored(t):
    """The same from an index on storage, opened anew."""
    path = durable_path(t.spark, "vectors")
    vectorindex.write_index(_label_chunks(t), path)
    out = search.vector_search(_label_queries(t), vectorindex.open_index(t.spark, path), 10)
    return out.withColumn("score", F.round("score", 6))


@query("j2_approximate_topk")
def j2(t):
    return search.approximate_search(_label_queries(t), _label_chunks(t), 10)


@query(
    "j2_recall",
    f"SELECT count(DISTINCT query_id) AS queries, count(*) AS wanted, true AS enough FROM ({_J1})",
)
def j2_recall(t):
    """How much of the exact result the approximate search finds: nine tenths or more."""
    index, asked = vectorindex.write_index(_label_chunks(t)), _label_queries(t)
    found = search.approximate_search(asked, index, 10).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    both = search.vector_search(asked, index, 10).join(found, ["query_id", "chunk_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), (F.sum("hit") >= 0.9 * F.count("*")).alias("enough"))


@query(
    "j3_overlap",
    f"WITH {_CHUNKS}, {_OVERLAP} SELECT query_id, chunk_id, path, start_line, score, rank FROM tr WHERE rank <= 30",
    DOCS,
)
def j3(t):
    return search.overlap_search(questions(t), doc_chunks(t))


@query(
    "i2_shared_tokens",
    f"""WITH {_CHUNKS}, a AS (SELECT query_id, repo_id, {CODE_TOKENS_SQL.format('text')} AS ts FROM qs), b AS (SELECT chunk_id, repo_id, {CODE_TOKENS_SQL.format('symbol')} AS ts FROM ch)
 SELECT chunk_id, len(list_intersect({CODE_TOKENS_SQL.format('content')}, {CODE_TOKENS_SQL.format("content || ' ' || symbol")})) AS shared FROM ch""",
    DOCS,
)
def i2(t):
    both = F.array_intersect(X.code_tokens(c("content")), X.code_tokens(F.concat("content", F.lit(" "), "symbol")))
    return doc_chunks(t).select("chunk_id", F.size(both).alias("shared"))


def _indexed_sql(col):
    """Index tokens: words with underscores, and the parts of compound words."""
    word = f"list_filter(regexp_split_to_array({col}, '[^A-Za-z0-9_]+'), lambda w: w <> '')"
    parts = f"""flatten(list_transform(list_filter({word}, lambda w: regexp_matches(w, '_|[a-z][A-Z]|[A-Z][A-Z][a-z]|[A-Za-z][0-9]|[0-9][A-Za-z]')),
 lambda w: regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')))"""
    return f"list_transform(list_concat({word}, {parts}), lambda x: lower(x))"


_BM25 = f"""WITH {_CHUNKS}, qt AS (SELECT query_id, repo_id, unnest({CODE_TOKENS_SQL.format('text')}) AS token FROM qs),
 f AS (SELECT chunk_id, repo_id, path, start_line, 'content' AS field, 1.0 AS boost, {_indexed_sql('content')} AS ts FROM ch
   UNION ALL SELECT chunk_id, repo_id, path, start_line, 'symbol', 3.0, {_indexed_sql('symbol')} FROM ch UNION ALL SELECT chunk_id, repo_id, path, start_line, 'path', 2.0, {_indexed_sql('path')} FROM ch),
 st AS (SELECT repo_id, field, count(*) AS docs, avg(len(ts)) AS mean FROM f WHERE len(ts) > 0 GROUP BY 1, 2),
 tf AS (SELECT chunk_id, repo_id, path, start_line, field, boost, n, token, count(*) AS tf FROM (SELECT *, len(ts) AS n, unnest(ts) AS token FROM f) GROUP BY ALL),
 df AS (SELECT repo_id, field, token, count(*) AS df FROM tf GROUP BY 1, 2, 3),
 sc AS (SELECT query_id, chunk_id, path, start_line, round(sum(boost * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
   FROM qt JOIN tf USING (repo_id, token) JOIN df USING (repo_id, field, token) JOIN st USING (repo_id, field) GROUP BY 1, 2, 3, 4)
 SELECT query_id, chunk_id, path, start_line, round(score, 3) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, start_line, chunk_id) AS rank FROM sc) WHERE rank <= 10"""


@query("j4_bm25", _BM25, DOCS)
def j4(t):
    return search.bm25_search(questions(t), doc_chunks(t), 10).withColumn("score", F.round("score", 3))


def _stored_index(t, tokens):
    """The passages in an index on storage: the even ones first, the odd ones added later."""
    path = durable_path(t.spark, "passages")
    chunks = doc_chunks(t)
    textindex.write_index(chunks.where("doc_id % 2 = 0"), path, tokens)
    return textindex.write_index(chunks.where("doc_id % 2 <> 0"), path, tokens, add=True)


@query(
    "j3_stored_index_all_repos",
    f"""WITH {_CHUNKS.replace("'src' || (item_id % 20)", "'' || (item_id % 20)")}, {_OVERLAP.replace("USING (repo_id, token)", "USING (token)")}
 SELECT query_id, chunk_id, path, start_line, score, rank FROM tr WHERE rank <= 10""",
    DOCS,
)
def j3_all(t):
    """A stored index, grown once, asked without a repository: all of them are searched."""
    asked = questions(t).withColumn("repo_id", F.lit(None).cast("string"))
    return search.overlap_search(asked, _stored_index(t, X.code_tokens), 10)


@query("j4_stored_index", _BM25, DOCS)
def j4_stored(t):
    return search.bm25_search(questions(t), _stored_index(t, X.indexed_tokens), 10).withColumn("score", F.round("score", 3))


@query(
    "g6_ranks",
    f"WITH {_CHUNKS}, {_OVERLAP} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT * FROM tr WHERE rank <= 30)",
    DOCS,
)
def g6(t):
    scores = search.overlap_search(questions(t), doc_chunks(t)).drop("rank")
    return search.ranked(scores, 30).select("query_id", "chunk_id", "rank")


@query(
    "j5_rank_fusion",
    f"WITH {_CHUNKS}, {_VECTOR}, {_OVERLAP}, {_FUSED} SELECT query_id, chunk_id, path, start_line, round(score, 9) AS score, sources, rank FROM fr WHERE rank <= 15",
    DOCS,
)
def j5(t):
    chunks = doc_chunks(t)
    asked = question_vectors(t, 384).join(questions(t).drop("text"), "query_id")
    rankings = {
        "vector": search.vector_search(asked, chunk_vectors(t)),
        "text": search.overlap_search(questions(t), chunks),
    }
    out = search.fused(rankings, chunks, 15)
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("sources")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumn("sources", listed).withColumn("score", F.round("score", 9))


def hybrid(t, limit=10):
    asked = questions(t).join(question_vectors(t, 384), "query_id")
    return search.hybrid_search(asked, doc_chunks(t), limit, vectors=chunk_vectors(t))


@query(
    "j6_hybrid_search",
    f"WITH {_CHUNKS}, {_VECTOR}, {_OVERLAP}, {_FUSED} SELECT query_id, chunk_id, path, start_line, round(score, 9) AS score, rank FROM fr WHERE rank <= 10",
    DOCS,
)
def j6(t):
    return hybrid(t).select("query_id", "chunk_id", "path", "start_line", F.round("score", 9).alias("score"), "rank")


@query(
    "j6_text_only",
    f"WITH {_CHUNKS}, {_OVERLAP} SELECT query_id, chunk_id, round(1.0 / (60 + rank), 9) AS score, rank FROM tr WHERE rank <= 10",
    DOCS,
)
def j6_text(t):
    """One retriever missing: the other ranking alone decides."""
    out = search.hybrid_search(questions(t), doc_chunks(t), 10)
    return out.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


_LS = "CASE WHEN content LIKE '%' || chr(10) THEN string_split(left(content, length(content) - 1), chr(10)) ELSE string_split(content, chr(10)) END"


@query(
    "j7_snippets",
    f"""WITH {_CHUNKS}, {_OVERLAP}, h AS (SELECT query_id, chunk_id, rank, path, {_LS} AS ls, len({_LS}) AS n FROM (SELECT * FROM tr WHERE rank <= 10) JOIN (SELECT chunk_id, content FROM ch) USING (chunk_id))
 SELECT query_id, rank, chunk_id, '### ' || path || ':1-' || n || ' (getDocById' || chunk_id || ')' || chr(10) || array_to_string(list_transform(range(1, least(n, 15) + 1), lambda i:
 lpad(CAST(i AS VARCHAR), CAST(length(CAST(least(n, 15) AS VARCHAR)) AS INTEGER), ' ') || ' | ' || ls[i]), chr(10)) || CASE WHEN n > 15 THEN chr(10) || '…' ELSE '' END AS block,
 '[' || path || ':1' || CASE WHEN n = 1 THEN '' ELSE '-' || n END || ']' AS citation FROM h""",
    DOCS,
)
def j7(t):
    chunks = doc_chunks(t)
    return search.rendered_hits(search.overlap_search(questions(t), chunks, 10), chunks)


@query(
    "m5_search_backend",
    f"WITH {_CHUNKS}, {_OVERLAP} SELECT query_id, count(*) AS hits, min(rank) AS best FROM tr WHERE rank <= 10 GROUP BY 1",
    DOCS,
)
def m5(t):
    """A backend is a pair of functions giving rankings of one schema; here the text side is swapped."""
    backend = {"text_search": lambda q, ch, k: search.overlap_search(q, ch, k)}
    out = search.hybrid_search(questions(t), doc_chunks(t), 10, candidates=10, **backend)
    return out.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("best"))
