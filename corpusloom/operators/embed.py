"""Embedding texts: provider interface, batched runs inside tasks, reuse by content hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import text as X
from corpusloom.scale import computed_once


class EmbeddingProvider(Protocol):
    """What an embedding model must offer. Instances are created once per task."""

    model_name: str
    dimensions: int

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


def run_provider(
    texts: DataFrame,
    make_provider: Callable[[], EmbeddingProvider],
    key: str = "embed_hash",
    batch: int = fixed.EMBED_BATCH,
    retries: int = 3,
    prefix: str = "",
) -> DataFrame:
    """Embeds ``key, text`` rows in fixed batches inside the tasks: ``key, embedding``.

    A failing batch is tried again; Spark's task retry stands above that. A batch with the wrong
    number of vectors, or a vector of the wrong size, fails the task. Vectors come out with unit
    length.
    """

    def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make_provider()

        def attempt(part: list[str]) -> list[list[float]]:
            for left in range(retries, -1, -1):
                try:
                    return provider.embed_documents(part)
                except Exception:
                    if left == 0:
                        raise
            return []

        for frame in frames:
            vectors: list[list[float]] = []
            for start in range(0, len(frame), batch):
                part = [prefix + t for t in frame["text"].iloc[start : start + batch]]
                result = attempt(part)
                if len(result) != len(part) or any(len(v) != provider.dimensions for v in result):
                    raise ValueError("embedding provider returned wrong vectors")
                vectors.extend(result)
            yield pd.DataFrame({key: frame[key].values, "embedding": vectors})

    schema = f"{key} {texts.schema[key].dataType.simpleString()}, embedding array<double>"
    raw = texts.select(key, "text").mapInPandas(embed, schema)
    return raw.withColumn("embedding", normalised(F.col("embedding")))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def normalised(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is.

    A lambda works out all of its body for each element, so the length is bound by an outer one: once per vector.
    """
    length = F.coalesce(F.nullif(norm(vector), F.lit(0.0)), F.lit(1.0))
    return F.get(F.transform(F.array(length), lambda n: F.transform(vector, lambda x: x / n)), F.lit(0))


def checked(vector: Column, dimensions: int) -> Column:
    """The vector, or a task failure when its size is wrong."""
    message = F.lit(f"expected {dimensions} dimensions")
    return F.when(F.size(vector) == dimensions, vector).otherwise(F.raise_error(message))


def token_bucket(token: Column, dimensions: int) -> Column:
    """Bucket of a token: the first four bytes of its md5, little endian, modulo ``dimensions``."""
    digest = F.md5(token.cast("binary"))
    swapped = F.concat(*[F.substring(digest, 7 - 2 * i, 2) for i in range(4)])
    return F.conv(swapped, 16, 10).cast("bigint") % dimensions


def _sparse(texts: DataFrame, key: str, dimensions: int) -> DataFrame:
    """Bucket numbers and unit-length weights per text, as two arrays."""
    buckets = F.array_sort(F.transform(X.code_tokens(F.col("text")), lambda w: token_bucket(w, dimensions)))
    rows = computed_once(texts.select(key, "text"), "_b", buckets)
    # In the sorted list, the distance between first positions is the number of repeats.
    starts = F.transform("_b", lambda b, i: F.when((i == 0) | (b != F.get("_b", i - 1)), i))
    rows = computed_once(rows, "_p", F.array_compact(starts))
    counts = F.transform("_p", lambda p, i: (F.coalesce(F.get("_p", i + 1), F.size("_b")) - p).cast("double"))
    rows = computed_once(rows.withColumn("_k", F.transform("_p", lambda p: F.get("_b", p))), "_n", counts)
    return computed_once(rows.select(key, "_k", "_n"), "_c", normalised(F.col("_n"))).drop("_n")


def hashing_embeddings(texts: DataFrame, key: str, dimensions: int = fixed.HASH_DIMENSIONS) -> DataFrame:
    """Deterministic embedding: tokens hashed to buckets, counted, scaled to unit length.

    Takes ``key, text`` and gives ``key, embedding``. All work stays inside the row: embedding a
    corpus needs no shuffle and no Python.
    """
    rows = computed_once(_sparse(texts, key, dimensions), "_m", F.map_from_arrays("_k", "_c"))
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(dimensions - 1)),
        lambda i: F.coalesce(F.try_element_at("_m", i.cast("bigint")), F.lit(0.0)),
    )
    return computed_once(rows.select(key, "_m"), "embedding", dense).drop("_m")


def hashing_weights(texts: DataFrame, key: str, dimensions: int = fixed.HASH_DIMENSIONS) -> DataFrame:
    """The same vectors in long form: ``key, bucket, weight`` for non-zero entries."""
    pairs = F.zip_with("_k", "_c", lambda b, w: F.struct(b.alias("bucket"), w.alias("weight")))
    return _sparse(texts, key, dimensions).select(key, F.inline(pairs))


def with_embed_hash(chunks: DataFrame, model: str) -> DataFrame:
    """Adds the text to embed and its hash (model and exact text)."""
    text = X.embedding_text(F.col("path"), F.col("symbol"), F.col("content"))
    return chunks.withColumn("text", text).withColumn("embed_hash", X.embed_hash(F.lit(model), F.col("text")))


def cached_vectors(stored: DataFrame) -> DataFrame:
    """One stored vector per hash."""
    rows = stored.where("embed_hash IS NOT NULL AND embedding IS NOT NULL")
    return rows.groupBy("embed_hash").agg(F.min("embedding").alias("embedding"))


def to_embed(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct texts without a stored vector: ``embed_hash, text``.

    Hashes meet first, without texts. Where few are new, adaptive execution broadcasts them by their measured
    size, and only their texts move.
    """
    known = stored.where("embedding IS NOT NULL").select("embed_hash")
    new = chunks.select("embed_hash").distinct().join(known, "embed_hash", "left_anti")
    wanted = chunks.join(new.withColumnRenamed("embed_hash", "_new"), F.col("embed_hash").eqNullSafe(F.col("_new")), "left_semi")
    return wanted.groupBy("embed_hash").agg(F.min("text").alias("text"))


def embedded(
    chunks: DataFrame, stored: DataFrame, embed: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Chunks with vectors: stored ones by hash, the rest from ``embed`` (``embed_hash, embedding``)."""
    fresh = embed(to_embed(chunks, stored))
    vectors = cached_vectors(stored).unionByName(fresh.select("embed_hash", "embedding"))
    return chunks.join(vectors, "embed_hash", "left")


def embed_report(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks per repo: total, reused and embedded. Equal hashes are counted before the join."""
    per_hash = chunks.groupBy("repo_id", "embed_hash").agg(F.count("*").alias("n"))
    known = stored.where("embedding IS NOT NULL").select("embed_hash").distinct().withColumn("hit", F.lit(1))
    rows = per_hash.join(known, "embed_hash", "left")
    reused = F.coalesce(F.sum(F.when(F.col("hit").isNotNull(), F.col("n"))), F.lit(0))
    return rows.groupBy("repo_id").agg(
        F.sum("n").alias("total"), reused.alias("reused"), (F.sum("n") - reused).alias("embedded")
    )
