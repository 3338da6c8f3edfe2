"""A stored inverted index for keyword search: built once, asked by batches of queries.

Chunks are cut into segments as they come (no shuffle). A segment has one row for each repository and token: the chunks
that hold it, as numbers inside the segment, and how often they do, field by field. One more row (its token is null) has
the chunks' ids, places and field lengths. Rows also carry counts and maxima, so that document frequencies and upper
bounds of scores are read without the arrays. Added chunks are further segments.

A search meets the asked tokens with the rows of their buckets. Every query gets a unit of work for each segment that
has one of its tokens, with an upper bound of the scores in it; the units with the best bounds run first, and of the others
only those whose bound reaches the k-th score found. A unit adds up its arrays in the task and returns its k best
chunks, so pairs of a query and a chunk are never shuffled, however common a word is.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import words as W
from corpusloom.scale import top_k
from corpusloom.session import durable_path, slice_count

FIELDS = ("content", "symbol", "path")
BOOSTS = {"content": 1.0, "symbol": 3.0, "path": 2.0}
SEGMENT = 4096
SEGMENT_TOKENS = 1 << 20
GROUP_SEGMENTS = 4
BUCKETS = 32
SIEVE_FLAGS = 1 << 20
FIRST_UNITS = 16
QUERY_SLICE = 5000
SENT_TOKENS = 100_000
SENT_ROWS = 1 << 15
TIES = ["path", "start_line", "chunk_id"]
_PLACE = ["chunk_id", "path", "start_line"]
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class TextIndex:
    """The rows of an index, as ``write_index`` stores them."""

    rows: DataFrame

    @property
    def lengths(self) -> DataFrame:
        return self.rows.where("token IS NULL")

    @property
    def postings(self) -> DataFrame:
        return self.rows.where("token IS NOT NULL")


def _bucket(token: Column) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int"), F.lit(-1))


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _segment(batch: pa.Table, names: list[str]) -> pa.RecordBatch:
    """The index rows of one segment."""
    keys = [(c, "ascending") for c in ("repo_id", *TIES)]
    batch = batch.take(pc.sort_indices(batch, sort_keys=keys, null_placement="at_start")).combine_chunks()
    n, repo = batch.num_rows, batch.column("repo_id").to_pylist()
    first = np.array([i == 0 or repo[i] != repo[i - 1] for i in range(n)], bool)
    group = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    number = np.arange(n) - starts[group]
    tokens = [batch.column(f"t_{f}").combine_chunks() for f in FIELDS]
    sizes = [pc.list_value_length(t).fill_null(0).to_numpy(False).astype(np.int64) for t in tokens]
    lengths = [batch.column(f"l_{f}").combine_chunks().to_numpy(False) for f in FIELDS]
    coded = pa.concat_arrays([t.flatten().cast(pa.string()) for t in tokens]).dictionary_encode()
    field = np.repeat(np.arange(len(FIELDS)), [s.sum() for s in sizes])
    row = np.concatenate([np.repeat(np.arange(n), s) for s in sizes])
    pair, back = np.unique(coded.indices.to_numpy(False).astype(np.int64) * n + row, return_inverse=True)
    times = [np.bincount(back[field == i], minlength=len(pair)) for i in range(len(FIELDS))]
    code, at = pair // n, pair % n
    # Rows of the index: a token in a repository; then one row per repository for its chunks.
    cut = np.ones(len(pair), bool)
    cut[1:] = (code[1:] != code[:-1]) | (group[at[1:]] != group[at[:-1]])
    heads = np.flatnonzero(cut)
    ends = np.append(heads[1:], len(pair))[: len(heads)]
    whole = np.append(starts[1:], n)
    owner = np.concatenate((group[at[heads]], np.arange(len(starts))))
    every = np.concatenate((ends, len(pair) + whole))
    tokens_out = pa.concat_arrays([coded.dictionary.take(pa.array(code[heads])), pa.nulls(len(starts), pa.string())])
    repos = batch.column("repo_id").take(pa.array(starts[owner])).combine_chunks()
    segment = int.from_bytes(os.urandom(8), "little", signed=True)
    out = [pa.array(np.full(len(every), segment)), repos, tokens_out, _lists(np.concatenate((number[at], number)), every)]
    begins = np.concatenate((heads, len(pair) + starts))
    for t, size in zip(times, lengths, strict=True):
        both, length = np.concatenate((t, size)), np.concatenate((size[at], size))
        out.append(_lists(both, every))
        reduce = (lambda f, x: f.reduceat(x, begins)) if len(begins) else (lambda f, x: x)
        out += [pa.array(reduce(np.add, (both > 0).astype(np.int64))), pa.array(reduce(np.add, both)), pa.array(reduce(np.maximum, both))]
        out.append(pa.array(reduce(np.minimum, np.where(both > 0, length, np.iinfo(np.int64).max))))
    bounds = pa.array(np.concatenate((np.zeros(len(heads) + 1), whole)).astype(np.int32))
    empty = np.zeros(len(every), bool)
    empty[: len(heads)] = True
    for c in _PLACE:
        values = batch.column(c).combine_chunks() if isinstance(batch.column(c), pa.ChunkedArray) else batch.column(c)
        out.append(pa.ListArray.from_arrays(bounds, values, mask=pa.array(empty)))
    return pa.RecordBatch.from_arrays(out, names)


def _sent(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A segment in pieces: the other side holds one at a time, outside its heap."""
    for start in range(0, rows.num_rows, SENT_ROWS):
        yield rows.slice(start, SENT_ROWS)


def _hashes(values: pa.Array) -> np.ndarray:
    """A hash for each string, zero for null."""
    known = pc.is_valid(values).to_numpy(False)
    return np.where(known, pd.util.hash_array(values.fill_null("").to_numpy(False).astype(object), categorize=False), np.uint64(0))


def _places(tokens: np.ndarray, repos: np.ndarray | np.uint64, flags: int) -> np.ndarray:
    return ((tokens ^ (repos * _ODD)) * _ODD) >> np.uint64(64 - (flags.bit_length() - 1))


@dataclass(frozen=True)
class Sieve:
    """Tells whether a token may be among the asked ones: never no for one that is, seldom yes for another."""

    sent: Broadcast
    flags: int
    free: bool

    def holds(self, tokens: np.ndarray, repos: np.ndarray) -> np.ndarray:
        held = self.sent.value[_places(tokens, repos, self.flags)]
        return held | self.sent.value[_places(tokens, np.uint64(0), self.flags)] if self.free else held


def sieve_of(asked: DataFrame) -> Sieve:
    """The sieve of ``asked`` (``repo_id, token``; a NULL repo asks all of them).

    It has 16 flags a key and ``SIEVE_FLAGS`` (a megabyte) at most, which is all that the driver and each task hold. Beyond
    that it lets more tokens pass; the exact join comes afterwards.
    """
    keys = asked.select("repo_id", "token").distinct()
    count, free = keys.agg(F.count("*"), F.bool_or(F.isnull("repo_id"))).first()
    flags = min(max(1 << 10, 1 << (16 * max(count, 1) - 1).bit_length()), SIEVE_FLAGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(_hashes(batch.column("token")), _hashes(batch.column("repo_id")), flags)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(at).astype(np.int64))], ["place"])

    held = np.zeros(flags, bool)
    held[keys.mapInArrow(run, "place long").distinct().toPandas()["place"].to_numpy(np.int64)] = True
    return Sieve(keys.sparkSession.sparkContext.broadcast(held), flags, bool(free))


def _listed_pairs(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens, and the pairs of a row and the number of a token, with repeats."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(False)
    coded = lists.flatten().cast(pa.string()).dictionary_encode()
    return coded.dictionary, np.repeat(np.arange(len(lists)), sizes), coded.indices.to_numpy(False).astype(np.int64)


def _token_batches(batch: pa.RecordBatch, sieve: Sieve | None) -> Iterator[pa.RecordBatch]:
    """Rows with the lists of their tokens that pass the sieve (``t_``) and the lengths of the whole lists (``l_``).

    The fields come as texts, cut here as ``X.code_tokens`` does, or as lists of tokens.
    """
    fields = [batch.column(f"t_{f}") for f in FIELDS]
    plain = pa.types.is_string(fields[0].type) or pa.types.is_large_string(fields[0].type)
    for start, stop in W.text_slices(fields) if plain else [(0, batch.num_rows)]:
        part = batch.slice(start, stop - start)
        repos = _hashes(part.column("repo_id")) if sieve else None
        lists, lengths = [], []
        for f in FIELDS:
            tokens, row, code = (W.code_token_pairs if plain else _listed_pairs)(part.column(f"t_{f}"))
            lengths.append(pa.array(np.bincount(row, minlength=part.num_rows)))
            if sieve:
                held = sieve.holds(_hashes(tokens)[code], repos[row])
                row, code = row[held], code[held]
            ends = np.cumsum(np.bincount(row, minlength=part.num_rows))
            offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
            lists.append(pa.ListArray.from_arrays(offsets, tokens.take(pa.array(code))))
        own = ["repo_id", *_PLACE]
        names = [*own, *[f"t_{f}" for f in FIELDS], *[f"l_{f}" for f in FIELDS]]
        yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], *lists, *lengths], names)


def segments(
    chunks: DataFrame, tokens: Callable[[Column], Column], size: int = SEGMENT, most: int = SEGMENT_TOKENS, asked: DataFrame | None = None
) -> DataFrame:
    """The index rows of ``chunks`` (chunk_id, repo_id, path, start_line, content, symbol); a null field has no token.

    A segment ends at ``size`` chunks or about ``most`` tokens: a task holds one at a time, however long the chunks are.
    With ``asked`` (``repo_id, token``) most other tokens are left out; field lengths still count them.
    """
    texts = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) for f in FIELDS}
    lists = [(text if tokens is X.code_tokens else tokens(text)).alias(f"t_{f}") for f, text in texts.items()]
    rows = chunks.select(F.col("repo_id").cast("string").alias("repo_id"), *_PLACE, *lists)
    kind = {c: rows.schema[c].dataType.simpleString() for c in _PLACE}
    per_field = [f"{f} array<int>, n_{f} long, sum_{f} long, most_{f} long, short_{f} long" for f in FIELDS]
    places = [f"chunk_{c} array<{kind[c]}>" for c in _PLACE]
    schema = ", ".join(["segment long, repo_id string, token string, at array<int>", *per_field, *places])
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    sieve = None if asked is None else sieve_of(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, words = [], 0, 0
        for batch in (part for whole in batches for part in _token_batches(whole, sieve)):
            sizes = [pc.list_value_length(batch.column(f"t_{f}")).to_numpy(zero_copy_only=False) for f in FIELDS]
            ends, start = np.concatenate(([0], np.cumsum(np.sum(sizes, axis=0, dtype=np.int64)))), 0
            while start < batch.num_rows:
                fits = int(np.searchsorted(ends, ends[start] + most - words, "right")) - 1
                stop = min(max(fits, start + 1), start + size - count, batch.num_rows)
                held.append(batch.slice(start, stop - start))
                count, words, start = count + stop - start, words + int(ends[stop] - ends[start]), stop
                if count >= size or words >= most or start < batch.num_rows:
                    yield from _sent(_segment(pa.Table.from_batches(held), names))
                    held, count, words = [], 0, 0
        if count:
            yield from _sent(_segment(pa.Table.from_batches(held), names))

    return rows.mapInArrow(run, schema)


def write_index(
    chunks: DataFrame, path: str, tokens: Callable[[Column], Column] = X.indexed_tokens, add: bool = False, size: int = SEGMENT
) -> TextIndex:
    """Build the index of ``chunks`` at ``path`` (or ``add`` them to the one there).

    Rows are kept in one folder per bucket of tokens, sorted by token; a bucket is written by several tasks if it is large.
    """
    rows = segments(chunks, tokens, size).withColumn("bucket", _bucket(F.col("token")))
    spread = F.pmod("segment", F.lit(max(1, slice_count(chunks.sparkSession) // BUCKETS)))
    rows = rows.repartition("bucket", spread).sortWithinPartitions("bucket", "token")
    rows.write.mode("append" if add else "overwrite").partitionBy("bucket").parquet(path)
    return open_index(chunks.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(spark.read.parquet(path))


def index_for(chunks: DataFrame, asked: DataFrame, tokens: Callable[[Column], Column]) -> TextIndex:
    """An index that is kept for one batch of queries: only rows of the tokens in ``asked`` are stored.

    Most others are dropped before the segments are made.
    """
    rows = segments(chunks, tokens, asked=asked).withColumn("bucket", _bucket(F.col("token")))
    wanted = asked.select(F.col("token").alias("_token")).distinct()
    kept = rows.join(wanted, F.col("token") == F.col("_token"), "left_outer").where("token IS NULL OR _token IS NOT NULL").drop("_token")
    path = durable_path(chunks.sparkSession, "text-index")
    kept.write.parquet(path)
    return TextIndex(chunks.sparkSession.read.schema(kept.schema).parquet(path))


def asked_tokens(queries: DataFrame) -> DataFrame:
    """``query_tokens`` worked out once and stored: they are read several times."""
    return _saved(query_tokens(queries), "asked")


def query_tokens(queries: DataFrame) -> DataFrame:
    """``query_id, repo_id, token`` for queries with a ``text``; a NULL repo searches all of them."""
    rows = queries.select("query_id", F.col("repo_id").cast("string").alias("repo_id"), X.code_tokens(F.col("text")).alias("tokens"))
    return rows.select("query_id", "repo_id", F.explode("tokens").alias("token")).withColumn("bucket", _bucket(F.col("token")))


# --- scores -----------------------------------------------------------------------------------


def _saved(df: DataFrame, name: str) -> DataFrame:
    path = durable_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def overlap_terms(heads: DataFrame, index: TextIndex) -> DataFrame:
    """Weight and bound of a field's token: its boost, if a chunk has it at all."""
    bound = sum((F.when(F.col(f"n_{f}") > 0, F.lit(BOOSTS[f])).otherwise(0.0) for f in FIELDS), F.lit(0.0))
    weights = [F.lit(BOOSTS[f]).alias(f"weight_{f}") for f in FIELDS]
    return heads.select("*", *weights, *[F.lit(None).cast("double").alias(f"mean_{f}") for f in FIELDS], bound.alias("bound"))


def bm25_terms(heads: DataFrame, index: TextIndex, k1: float, b: float) -> DataFrame:
    """Boosted idf of each field's token, mean field lengths, and the highest score that a segment can give.

    Statistics are those of the chunk's repository: documents with the field, their mean length, and how many have the token.
    """
    sums = [F.sum(f"n_{f}").alias(f"docs_{f}") for f in FIELDS] + [F.try_divide(F.sum(f"sum_{f}"), F.sum(f"n_{f}")).alias(f"mean_{f}") for f in FIELDS]
    stats = index.lengths.groupBy("repo_id").agg(*sums).withColumnRenamed("repo_id", "_repo")
    distinct = heads.dropDuplicates(["segment", "repo_id", "token"])
    df = distinct.groupBy("repo_id", "token").agg(*[F.sum(f"n_{f}").alias(f"df_{f}") for f in FIELDS])
    df = df.withColumnsRenamed({"repo_id": "_r", "token": "_t"})
    rows = heads.join(df, F.col("repo_id").eqNullSafe(F.col("_r")) & (F.col("token") == F.col("_t")))
    rows = rows.join(stats, F.col("repo_id").eqNullSafe(F.col("_repo")))
    bound = F.lit(0.0)
    for f in FIELDS:
        idf = F.log(1 + (F.col(f"docs_{f}") - F.col(f"df_{f}") + 0.5) / (F.col(f"df_{f}") + 0.5))
        rows = rows.withColumn(f"weight_{f}", BOOSTS[f] * idf)
        most, short = F.col(f"most_{f}"), F.col(f"short_{f}")
        best = most * (k1 + 1) / (most + k1 * (1 - b + b * short / F.col(f"mean_{f}")))
        bound = bound + F.when(F.col(f"n_{f}") > 0, F.col(f"weight_{f}") * best).otherwise(0.0)
    return rows.withColumn("bound", bound).drop("_r", "_t", "_repo")


def _gain(kind: str, k1: float, b: float) -> Callable:
    """(times, lengths, weight, mean) -> what a field adds to the score of each chunk."""

    def presence(times, lengths, weight, mean):
        return weight * (times > 0)

    def bm25(times, lengths, weight, mean):
        return weight * times * (k1 + 1) / (times + k1 * (1 - b + b * lengths / mean))

    return presence if kind == "overlap" else bm25


def _unit_best(gain: Callable, k: int, columns: list[str]):
    """Best chunks of each unit of a task: postings and lengths on the left, units on the right."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {c: [] for c in columns}
        rows = {key: part for key, part in left.groupby("home", sort=False)}
        for key, asked in right.groupby("home", sort=False):
            part = rows[key]
            own = part[part["token"].isna()].iloc[0]
            count, added = len(own["at"]), {}
            for row in part[part["token"].notna()].to_dict("records"):
                at, total = row["at"], np.zeros(len(row["at"]))
                for f in FIELDS:
                    times = row[f]
                    has = times > 0
                    if has.any():
                        total[has] += gain(times[has], own[f][at[has]], row[f"weight_{f}"], row[f"mean_{f}"])
                added[row["token"]] = at, total
            for query, tokens in zip(asked["query_id"], asked["tokens"], strict=True):
                found = [added[t] for t in tokens]
                at = np.concatenate([a for a, _ in found])
                score = np.round(np.bincount(at, np.concatenate([s for _, s in found]), count), 6)
                hit = np.flatnonzero(score > 0)
                best = hit[np.lexsort((hit, -score[hit]))[:k]]
                out["query_id"] += [query] * len(best)
                for c in _PLACE:
                    out[c] += [own[f"chunk_{c}"][i] for i in best.tolist()]
                out["score"] += score[best].tolist()
        return pd.DataFrame(out) if out["query_id"] else pd.DataFrame({c: np.zeros(0, object) for c in columns})

    return run


def search(
    queries: DataFrame, index: TextIndex, k: int, kind: str = "overlap", k1: float = 1.2, b: float = 0.75, first_units: int = FIRST_UNITS
) -> DataFrame:
    """The k best chunks per query (``query_id, chunk_id, path, start_line, score, rank``); ties by path, line and id.

    ``queries`` have a text, or are the stored rows of ``query_tokens``.
    """
    spark = queries.sparkSession
    asked = queries if "token" in queries.columns else asked_tokens(queries)
    narrow = ["segment", "repo_id", "token", "bucket", *[f"{n}_{f}" for f in FIELDS for n in ("n", "most", "short")]]
    heads = index.postings.select(*narrow)
    known, free = asked.where("repo_id IS NOT NULL"), asked.where("repo_id IS NULL").drop("repo_id")
    pairs = heads.join(known, ["bucket", "repo_id", "token"]).unionByName(heads.join(free, ["bucket", "token"]))
    terms = overlap_terms(pairs, index) if kind == "overlap" else bm25_terms(_saved(pairs, "asked-heads"), index, k1, b)
    weights = [f"{n}_{f}" for f in FIELDS for n in ("weight", "mean")]
    terms = _saved(terms.select("query_id", "segment", "repo_id", "token", "bucket", "bound", *weights), "terms")
    units = terms.groupBy("query_id", "segment", "repo_id").agg(F.sum("bound").alias("bound"), F.collect_list("token").alias("tokens"))
    units = _saved(top_k(units, ["query_id"], [F.desc("bound"), F.col("segment"), F.col("repo_id")], (1 << 31) - 1, "turn"), "units")
    many, tokens = asked.agg(F.count_distinct("query_id"), F.count_distinct("token")).first()
    slices = ceil(many / QUERY_SLICE) or 1
    # Postings that nobody asks for stay where they are; above ``SENT_TOKENS`` the join alone sorts them out.
    asked_postings = index.postings
    if tokens <= SENT_TOKENS:
        asked_postings = asked_postings.join(F.broadcast(asked.select("bucket", "token").distinct()), ["bucket", "token"], "left_semi")
    kind_of = {c: index.rows.schema[f"chunk_{c}"].dataType.elementType.simpleString() for c in _PLACE}
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, " + ", ".join(f"{c} {kind_of[c]}" for c in _PLACE) + ", score double"
    run = _unit_best(_gain(kind, k1, b), k, ["query_id", *_PLACE, "score"])
    # A group is held in memory by one task: their number follows the segments, so that none grows with the index.
    held = ceil(units.select("segment").distinct().count() / GROUP_SEGMENTS) * slices
    groups = max(slice_count(spark), spark.sparkContext.defaultParallelism, held)
    slice_of = F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int")

    def best_of(some: DataFrame) -> DataFrame:
        # Terms, units and homes grow with the index, and their files compress so well that the planner takes them for small.
        at = ["segment", "repo_id"]
        mine = some.select("query_id", *at, "tokens", slice_of.alias("slice"))
        needed = terms.join(some.select("query_id", *at).hint("merge"), ["query_id", "segment"]).where(terms["repo_id"].eqNullSafe(some["repo_id"]))
        needed = needed.select(terms["segment"], terms["repo_id"], "token", "bucket", *weights, slice_of.alias("slice")).distinct()
        needed = needed.withColumnsRenamed({"segment": "_s", "repo_id": "_r", "token": "_t", "bucket": "_b"})
        same = (F.col("segment") == F.col("_s")) & F.col("repo_id").eqNullSafe(F.col("_r"))
        hits = asked_postings.join(needed.hint("merge"), same & (F.col("bucket") == F.col("_b")) & (F.col("token") == F.col("_t")))
        homes = needed.select("_s", "_r", "slice").distinct()
        empty = [F.lit(None).cast("double").alias(w) for w in weights]
        own = index.lengths.join(homes.hint("merge"), same).select("*", *empty)
        wide = [*at, "token", "at", *FIELDS, *[f"chunk_{c}" for c in _PLACE], *weights, "slice"]
        rows = hits.select(*wide).unionByName(own.select(*wide))
        home = F.xxhash64("segment", F.col("repo_id").isNull(), "repo_id", "slice")
        left, right = (df.withColumn("home", home).withColumn("task", F.pmod("home", F.lit(groups))) for df in (rows, mine))
        left, right = left.groupBy("task"), right.groupBy("task")
        found = left.cogroup(right).applyInPandas(run, schema)
        return top_k(found, ["query_id"], [F.desc("score"), *[F.col(c) for c in TIES]], k)

    if (units.agg(F.max("turn")).first()[0] or 0) <= first_units:
        return best_of(units)
    first = _saved(best_of(units.where(F.col("turn") <= first_units)), "first-hits")
    bar = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
    later = units.where(F.col("turn") > first_units).join(bar, "query_id", "left").where("bar IS NULL OR bound + 1e-6 >= bar")
    both = first.drop("rank").unionByName(best_of(_saved(later.drop("bar"), "later-units")).drop("rank"))
    return top_k(both, ["query_id"], [F.desc("score"), *[F.col(c) for c in TIES]], k)
