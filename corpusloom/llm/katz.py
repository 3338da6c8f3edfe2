"""Language-model scores by Katz backoff over word pairs.

Counts are discounted by Good-Turing up to ``CUTOFF``; the mass taken from the followers of a context goes to the words
never seen after it, in proportion to their unigram probability, by a backoff weight that makes each context sum to
exactly one. Unigram mass that discounting frees goes to one unknown word. A context whose counts are all above the
cutoff would free nothing; its total is taken one higher.

Tables (in the shared folder): ``unigrams`` (word, count); ``pairs``: one row per bucket of contexts, with sorted arrays
(context, follower, count); ``weights``: one row per bucket with (context, total, backoff weight).

How it scales. Words are 64-bit hashes (a collision among V words has a chance of about V^2 / 2^65). The ``head``
most frequent words, a bounded table, are known to every task, which shortens their codes to three bytes and gives
their unigram counts at hand; all other words are looked up by a join. Text is never shuffled: each task sends packed
arrays of pairs to buckets of contexts. A context above half a bucket's fair share is dealt over several buckets by
its follower, and its sums are added up from them. Scores come back as one row per document and bucket.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import documents_of, mix64, slices_of, stored

CUTOFF = 5
HEAD = 1 << 20
BUCKET = 4_000_000
CHUNK = 2_000_000
END, BEGIN = np.uint64(HEAD), np.uint64(HEAD + 1)
TAIL = np.uint64(1 << 63)
_PLANES = 8
_SUMS = ["key", "rows", "n", "known", "base", "score"]


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def hashed(words: list[bytes]) -> np.ndarray:
    """Word hashes; the upper bit is always set and marks a word outside the head."""
    return np.fromiter((xxhash.xxh64_intdigest(w, 6) for w in words), np.uint64, len(words)) | TAIL


def packed(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays as compressed byte planes (small numbers leave most planes empty)."""
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(a.astype(np.uint64)).view(np.uint8).reshape(-1, _PLANES).T.tobytes()
        small = pa.compress(raw, "zstd", asbytes=True)
        parts.append(np.array([len(a), len(small)], np.int64).tobytes() + small)
    return b"".join(parts)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, size = np.frombuffer(data, np.int64, 2, at).tolist()
        at += 16
        raw = pa.decompress(data[at : at + size], n * _PLANES, "zstd", asbytes=True)
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(_PLANES, n).T).view(np.uint64).ravel())
        at += size
    return out


def discounts(counts: list[int], cutoff: int = CUTOFF) -> np.ndarray:
    """Good-Turing factors for the counts 0 .. cutoff + 1 (the last stands for all above: 1).

    ``counts[r]`` is how many types were seen r times. Where they give no factor between 0 and 1 (small or odd tables),
    half an occurrence is taken off instead.
    """
    out = np.ones(cutoff + 2)
    n1, last = counts[1], (cutoff + 1) * counts[cutoff + 1]
    common = last / n1 if n1 else 1.0
    for r in range(1, cutoff + 1):
        better = (r + 1) * counts[r + 1] / (r * counts[r]) if counts[r] else 0.0
        d = (better - common) / (1 - common) if common < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass
class Unigrams:
    """What every task knows: totals, discounts, and the head with its counts, sorted by hash."""

    total: int
    types: int
    texts: int
    factors: np.ndarray
    unknown: float
    hashes: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    spread: np.ndarray
    buckets: int

    def encoded(self, words: np.ndarray) -> np.ndarray:
        """Hashes to codes: a small number for the head, the hash itself for others."""
        if not len(self.hashes):
            return words
        spot = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[spot] == words, self.codes[spot], words)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """Unigram probability of words with these training counts (0: the unknown word)."""
        factor = self.factors[np.minimum(counts, CUTOFF + 1)]
        return np.where(counts > 0, factor * counts / max(self.total, 1), self.unknown)

    def known(self, codes: np.ndarray) -> np.ndarray:
        """Counts of head words and the end; 0 for tail words."""
        out = np.zeros(len(codes), np.int64)
        head = codes < np.uint64(HEAD)
        out[head] = self.counts[codes[head].astype(np.int64)]
        out[codes == END] = self.texts
        return out

    def parts(self, contexts: np.ndarray) -> np.ndarray:
        """Over how many buckets a context is dealt."""
        out = np.ones(len(contexts), np.uint64)
        small = contexts <= BEGIN
        out[small] = self.spread[contexts[small].astype(np.int64)]
        return out

    def bucket(self, contexts: np.ndarray, followers: np.ndarray) -> np.ndarray:
        turn = mix64(followers + np.uint64(1)) % self.parts(contexts)
        return (mix64(mix64(contexts) + turn) % np.uint64(self.buckets)).astype(np.int32)


def _prepared(docs: DataFrame, held_out) -> DataFrame:
    rows = documents_of(docs)
    return rows.withColumns({"held_out": held_out(F.col("doc_id")), "key": F.xxhash64("doc_id", "text")})


def _word_counts(training: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices_of(batches):
            for text in batch.column("text").to_pylist():
                seen.update(words_of(text))
            if len(seen) > 1_500_000:
                yield flushed(seen)
        yield flushed(seen)

    def flushed(seen: Counter) -> pa.RecordBatch:
        columns = [pa.array(hashed(list(seen)).view(np.int64)), pa.array(list(seen.values()), pa.int64())]
        seen.clear()
        return pa.RecordBatch.from_arrays(columns, ["word", "n"])

    rows = training.select("text").mapInArrow(run, "word long, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _unigrams(words: DataFrame, texts: int, everything: int, least_buckets: int, head: int) -> Unigrams:
    """Totals by one aggregate; the head is every word with at least the smallest power of two that bounds it."""
    levels = range(48)
    row = words.agg(
        F.count("*").alias("types"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        *[F.sum((F.col("n") == r).cast("long")).alias(f"c{r}") for r in range(1, CUTOFF + 2)],
        *[F.sum((F.col("n") >= 1 << i).cast("long")).alias(f"l{i}") for i in levels],
    ).first()
    total, types = int(row["total"]) + texts, int(row["types"]) + (texts > 0)
    of_count = [0] + [int(row[f"c{r}"] or 0) + (texts == r) for r in range(1, CUTOFF + 2)]
    level = next(i for i in levels if (row[f"l{i}"] or 0) <= head)
    top = words.where(F.col("n") >= 1 << level).toArrow()
    hashes, counts = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.lexsort((hashes, -counts))
    codes = np.zeros(len(order), np.uint64)
    codes[order] = np.arange(len(order), dtype=np.uint64)
    by_hash = np.argsort(hashes)
    buckets = max(least_buckets, ceil(everything / BUCKET))
    often = np.zeros(HEAD + 2, np.int64)
    often[: len(order)] = counts[order]
    often[int(BEGIN)] = texts
    spread = np.maximum(1, np.ceil(often * 2.0 * buckets / max(total, 1))).astype(np.uint64)
    factors = discounts(of_count)
    low = [factors[r] * r * of_count[r] for r in range(1, CUTOFF + 1)]
    kept = sum(low) + total - sum(r * of_count[r] for r in range(1, CUTOFF + 1))
    unknown = max(1 - kept / total, 1 / (total + 1)) if total else 1.0
    if total and 1 - kept / total <= 0:  # nothing was discounted: give way to the unknown word
        factors = factors * (1 - unknown)
    return Unigrams(total, types, texts, factors, unknown, hashes[by_hash], codes[by_hash], often, spread, buckets)


class _Chunk:
    """Pairs of many texts, gathered slice by slice as local numbers of words.

    ``name`` is the task and the chunk's turn in it: the same whenever the task runs again.
    """

    def __init__(self, known: Unigrams, turn: int) -> None:
        self.known = known
        self.name = (TaskContext.get().partitionId() << 32) + turn
        self.number: dict[bytes, int] = {}
        self.words: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.keys: list[int] = []
        self.held = 0

    def add(self, texts: list[str], keys: list[int]) -> None:
        number = self.number
        for text in texts:
            split = words_of(text)
            flat = [number.setdefault(w, len(number)) for w in split]
            self.words.append(np.array(flat, np.int32))
            self.sizes.append(len(flat))
        self.keys += keys
        self.held = sum(self.sizes)

    def close(self) -> None:
        """Sort the local words by code; ``context`` and ``follower`` are local numbers of the pairs in text order."""
        known = self.known
        codes = np.concatenate([known.encoded(hashed(list(self.number))), np.array([END, BEGIN], np.uint64)])
        self.number = {}
        order = np.argsort(codes)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.codes = codes[order]
        words = rank[np.concatenate(self.words)] if self.words else np.zeros(0, np.int32)
        self.words = []
        sizes = np.array(self.sizes, np.int64)
        ends = np.cumsum(sizes)
        self.context = np.insert(words, ends - sizes, rank[-1])
        self.follower = np.insert(words, ends, rank[-2])
        self.text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)

    def buckets(self, context: np.ndarray, follower: np.ndarray) -> np.ndarray:
        """Bucket of each pair of local numbers: by context, and by follower too where a context is dealt out."""
        nought = np.zeros(len(self.codes), np.uint64)
        plain = (mix64(mix64(self.codes) + nought) % np.uint64(self.known.buckets)).astype(np.int32)
        out = plain[context]
        many = (self.known.parts(self.codes) > 1)[context]
        if many.any():
            at = np.flatnonzero(many)
            out[at] = self.known.bucket(self.codes[context[at]], self.codes[follower[at]])
        return out


def _chunks(batches: Iterator[pa.RecordBatch], known: Unigrams) -> Iterator[_Chunk]:
    """The texts of a partition in chunks of about CHUNK words."""
    chunk, turn = _Chunk(known, 0), 0
    for batch in slices_of(batches):
        chunk.add(batch.column("text").to_pylist(), batch.column("key").to_pylist())
        if chunk.held > CHUNK:
            chunk.close()
            yield chunk
            turn += 1
            chunk = _Chunk(known, turn)
    if chunk.sizes:
        chunk.close()
        yield chunk


def _split(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    small = buckets.astype(np.uint16) if len(buckets) and buckets.max() < 1 << 16 else buckets
    order = np.argsort(small, kind="stable")
    sorted_ = buckets[order]
    edges = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(order) else order
    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
        yield int(sorted_[a]), order[a:b]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values to (distinct ones, how often)."""
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.append(first, len(values)))


def _pair_rows(shared: Broadcast):
    """Training texts to (bucket, packed distinct pairs with counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, shared.value):
            pair = chunk.context.astype(np.int64) * len(chunk.codes) + chunk.follower
            pair.sort()
            pair, n = _runs(pair)
            context, follower = np.divmod(pair, len(chunk.codes))
            for bucket, at in _split(chunk.buckets(context, follower)):
                data = packed(*_runs(chunk.codes[context[at]]), chunk.codes[follower[at]], n[at])
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([data], pa.binary())], ["bucket", "data"])

    return run


def _gathered(blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of a bucket to sorted distinct (context, follower, count)."""
    parts = [unpacked(b) for b in blocks]
    context = np.concatenate([np.repeat(p[0], p[1].astype(np.int64)) for p in parts])
    follower, n = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]).astype(np.int64)
    order = np.lexsort((follower, context))
    context, follower, n = context[order], follower[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | (follower[1:] != follower[:-1]))))
    return context[first], follower[first], np.add.reduceat(n, first)


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    context, follower, n = _gathered(pdf["data"])
    of_count = np.bincount(np.minimum(n, CUTOFF + 2), minlength=CUTOFF + 3)
    row = {"bucket": pdf["bucket"].iloc[:1].to_list(), "data": [packed(*_runs(context), follower, n)]}
    return pd.DataFrame(row | {f"n{r}": [int(of_count[r])] for r in range(1, CUTOFF + 2)})


def _sums(data: bytes, known: Unigrams, factors: np.ndarray):
    """Of a bucket: contexts, their counts, discounted counts, head probability of followers; and the tail pairs."""
    context, many, follower, n = unpacked(data)
    many, n = many.astype(np.int64), n.astype(np.int64)
    first = np.cumsum(many) - many
    kept = factors[np.minimum(n, CUTOFF + 1)] * n
    chance = known.probability(known.known(follower)) * (follower < TAIL)
    total, low, seen = (np.add.reduceat(x, first) for x in (n, kept, chance))
    tail = np.flatnonzero(follower >= TAIL)
    return context, total, low, seen, np.repeat(context, many)[tail], follower[tail]


def _tail_rows(shared: Broadcast):
    """Pairs whose follower is outside the head: (bucket, context, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
                *_, context, word = _sums(data, shared.value, np.ones(CUTOFF + 2))
                columns = [pa.array(np.full(len(word), bucket)), pa.array(context.view(np.int64)), pa.array(word.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "context", "word"])

    return run


def _spread_rows(shared: Broadcast, factors: np.ndarray):
    """Sums of the contexts that are dealt over several buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for data in batch.column("data").to_pylist():
                context, total, low, seen, *_ = _sums(data, known, factors)
                at = np.flatnonzero(known.parts(context) > 1)
                columns = [pa.array(context[at].view(np.int64)), pa.array(total[at]), pa.array(low[at]), pa.array(seen[at])]
                yield pa.RecordBatch.from_arrays(columns, ["context", "total", "low", "seen"])

    return run


def _weigh(total: np.ndarray, low: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total to divide by, backoff weight): what discounting frees over what unseen followers had."""
    base = np.where(total - low < 1e-9 * total, total + 1.0, total.astype(float))
    return base, (1 - low / base) / np.maximum(1 - seen, 1e-15)


def _weights(shared: Broadcast, factors: np.ndarray, spread: dict[int, tuple[float, float, float]]):
    """(pairs of a bucket, tail sums of the bucket) -> packed (context, count, total, weight)."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = shared.value
        if not len(left):
            return pd.DataFrame({"bucket": np.zeros(0, np.int64), "weights": []})
        context, total, low, seen, *_ = _sums(left["data"].iloc[0], known, factors)
        if len(right):
            at = np.searchsorted(context, right["context"].to_numpy().view(np.uint64))
            np.add.at(seen, at, right["seen"].to_numpy())
        for i in np.flatnonzero(known.parts(context) > 1).tolist():
            total[i], low[i], seen[i] = spread[int(context[i])]
        base, weight = _weigh(total, low, seen)
        floats = [x.view(np.uint64) for x in (base, weight)]
        return pd.DataFrame({"bucket": left["bucket"].iloc[:1], "weights": [packed(context, total, *floats)]})

    return run


@dataclass
class Model:
    words: DataFrame
    pairs: DataFrame
    weights: DataFrame
    shared: Broadcast
    factors: np.ndarray


def train(docs: DataFrame, held_out, head: int = HEAD) -> Model:
    """Learn from the rows for which ``held_out`` (of doc_id) is false; the tables are written to the shared folder."""
    spark = docs.sparkSession
    rows = _prepared(docs, held_out)
    training = rows.where(~F.col("held_out"))
    words = stored(_word_counts(training), "katz-unigrams")
    texts, everything = training.count(), rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 6
    known = _unigrams(words, texts, int(everything), spark.sparkContext.defaultParallelism, min(head, HEAD))
    shared = spark.sparkContext.broadcast(known)
    blocks = training.select("text", "key").mapInArrow(_pair_rows(shared), "bucket long, data binary")
    counts = ", ".join(f"n{r} long" for r in range(1, CUTOFF + 2))
    pairs = stored(blocks.groupBy("bucket").applyInPandas(_merged, f"bucket long, data binary, {counts}"), "katz-pairs")
    row = pairs.agg(*[F.sum(f"n{r}").alias(f"n{r}") for r in range(1, CUTOFF + 2)]).first()
    factors = discounts([0] + [int(row[f"n{r}"] or 0) for r in range(1, CUTOFF + 2)])
    # Unigram probability of the followers outside the head, summed by bucket and context.
    tails = pairs.select("bucket", "data").mapInArrow(_tail_rows(shared), "bucket long, context long, word long")
    chance = _chance(known, F.col("n"))
    tails = tails.join(words, "word").groupBy("bucket", "context").agg(F.sum(chance).alias("seen"))
    tails = stored(tails, "katz-tails")
    # Contexts dealt over several buckets: at most twice as many as there are buckets.
    dealt = pairs.select("data").mapInArrow(_spread_rows(shared, factors), "context long, total long, low double, seen double")
    dealt = dealt.groupBy("context").agg(F.sum("total").alias("total"), F.sum("low").alias("low"), F.sum("seen").alias("seen"))
    hot = {r["context"]: r for r in dealt.collect()}
    extra = tails.where(F.col("context").between(0, int(BEGIN))).groupBy("context").agg(F.sum("seen").alias("seen"))
    more = {r["context"]: r["seen"] for r in extra.where(F.col("context").isin(list(hot))).collect()} if hot else {}
    spread = {c: (r["total"], r["low"], r["seen"] + more.get(c, 0.0)) for c, r in hot.items()}
    grouped = pairs.select("bucket", "data").groupBy("bucket").cogroup(tails.groupBy("bucket"))
    weights = stored(grouped.applyInPandas(_weights(shared, factors, spread), "bucket long, weights binary"), "katz-weights")
    return Model(words, pairs, weights, shared, factors)


def _chance(known: Unigrams, n):
    """Unigram probability as a column of the training count."""
    factor = F.element_at(F.array(*[F.lit(float(x)) for x in known.factors]), F.least(n, F.lit(CUTOFF + 1)).cast("int") + 1)
    return F.when(n > 0, factor * n / float(max(known.total, 1))).otherwise(F.lit(float(known.unknown)))


def _occurrence_rows(shared: Broadcast):
    """All texts to (bucket, chunk, packed distinct pairs with the texts of the chunk that hold them).

    The texts' keys go once per chunk, to a bucket of their own (below zero).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, shared.value):
            words = len(chunk.codes)
            pair, text = _by_pair(chunk.context.astype(np.int64) * words + chunk.follower, chunk.text)
            context, follower = np.divmod(pair, words)
            for bucket, at in _split(chunk.buckets(context, follower)):
                distinct, times = _runs(pair[at])
                c, f = np.divmod(distinct, words)
                yield row(bucket, chunk.name, packed(*_runs(chunk.codes[c]), chunk.codes[f], times, text[at]))
            aside = -1 - (chunk.name ^ chunk.name >> 32) % shared.value.buckets
            yield row(aside, chunk.name, packed(np.array(chunk.keys, np.int64).view(np.uint64)))

    def row(bucket: int, name: int, data: bytes) -> pa.RecordBatch:
        columns = [pa.array([bucket], pa.int64()), pa.array([name], pa.int64()), pa.array([data], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "occurrences"])

    return run


def _by_pair(pair: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sorted by pair, then text; as one number where both fit into it."""
    bits = int(text.max()).bit_length() if len(text) else 0
    if len(pair) and int(pair.max()).bit_length() + bits < 63:
        both = (pair << bits) | text
        both.sort()
        return both >> bits, both & ((1 << bits) - 1)
    order = np.argsort(pair, kind="stable")
    return pair[order], text[order].astype(np.int64)


def _scores(shared: Broadcast, factors: np.ndarray):
    """(model of a bucket, occurrences of the bucket) -> (chunk, packed sums by text; or text, tail word, uses).

    A tail word that backs off is left to a join with the unigrams. Keys of texts pass through.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(right) and right["bucket"].iloc[0] < 0:
            return _answer(right["chunk"].to_numpy(), keys=right["occurrences"].to_list())
        known = shared.value
        model = unpacked(left["data"].iloc[0]) if len(left) else [np.zeros(0, np.uint64)] * 4
        weights = unpacked(left["weights"].iloc[0]) if len(left) else [np.zeros(0, np.uint64)] * 4
        contexts, many, follower, n = model
        # One entry more than there are contexts: what is unknown ends there, with count 0 and weight 1.
        total = np.append(weights[1].astype(np.int64), 0)
        back = np.append(np.log10(np.maximum(weights[3].view(float), 1e-300)), 0.0)
        base, n = weights[2].view(float), n.astype(np.int64)
        tails = np.unique(follower[follower >= TAIL])
        rank = np.zeros(HEAD + 2, np.int64)
        heads = np.unique(follower[follower < TAIL]).astype(np.int64)
        rank[heads] = np.arange(1, len(heads) + 1)
        width = len(heads) + len(tails) + 2

        def ranked(f: np.ndarray) -> np.ndarray:
            """Place of each follower among those of the bucket, 0 for none."""
            out, far = np.zeros(len(f), np.int64), f >= TAIL
            out[~far] = rank[f[~far].astype(np.int64)]
            if len(tails):
                spot = np.minimum(np.searchsorted(tails, f[far]), len(tails) - 1)
                out[far] = np.where(tails[spot] == f[far], spot + 1 + len(heads), 0)
            return out

        owner = np.repeat(np.arange(len(contexts)), many.astype(np.int64))
        index = owner * width + ranked(follower)
        order = np.argsort(index)
        index = index[order]
        gain = np.log10(factors[np.minimum(n, CUTOFF + 1)] * n / base[owner])[order] if len(n) else np.zeros(0)
        parts: list[pd.DataFrame] = []
        for name, data in zip(right["chunk"], right["occurrences"], strict=True):
            c, runs, f, times, text = unpacked(data)
            runs, times, text = runs.astype(np.int64), times.astype(np.int64), text.astype(np.int64)
            here = np.searchsorted(contexts, c)
            if len(contexts):
                here[contexts[np.minimum(here, len(contexts) - 1)] != c] = len(contexts)
            counted = np.where(c == BEGIN, known.texts, total[here])
            base_of = np.log10((counted + 0.5) / (known.total + 0.5 * (known.types + 1)))
            at = np.repeat(np.arange(len(c)), runs)
            place = ranked(f)
            seen = (place > 0) & (here[at] < len(contexts))
            pair = here[at] * width + place
            spot = np.minimum(np.searchsorted(index, pair), max(len(index) - 1, 0))
            if len(index):
                seen &= index[spot] == pair
            score = np.where(seen, gain[spot] if len(index) else 0.0, back[here[at]])
            easy = ~seen & (f < TAIL)
            score[easy] += np.log10(known.probability(known.known(f[easy])))
            # From distinct pairs to their uses in texts.
            use = np.repeat(np.arange(len(f)), times)
            of, size = at[use], int(text.max()) + 1
            number = lambda w: np.bincount(text, w, size)  # noqa: E731, B023
            sums = [number(w) for w in ((c == BEGIN)[of], None, (counted > 0)[of], base_of[of], score[use])]
            held = np.flatnonzero(sums[1])
            whole, real = [x[held].astype(np.uint64) for x in sums[:3]], [x[held].view(np.uint64) for x in sums[3:]]
            parts.append(_answer(np.array([name]), data=[packed(held, *whole, *real)]))
            hard = np.flatnonzero((~seen & (f >= TAIL))[use])
            if len(hard):
                one, n_one = _runs(np.sort(use[hard] * size + text[hard]))
                parts.append(_answer(np.full(len(one), name), text=one % size, word=f[one // size].view(np.int64), n=n_one))
        return pd.concat(parts) if parts else _answer(np.zeros(0, np.int64))

    return run


def _answer(chunk: np.ndarray, keys=None, data=None, text=0, word=0, n=0) -> pd.DataFrame:
    return pd.DataFrame({"chunk": chunk, "keys": keys, "data": data, "text": text, "word": word, "n": n})


def _by_text(pdf: pd.DataFrame) -> pd.DataFrame:
    """All answers of a chunk to one row per text."""
    keys = unpacked(pdf["keys"].dropna().iloc[0])[0].view(np.int64)
    sums = [np.zeros(len(keys), np.int64) for _ in range(3)] + [np.zeros(len(keys)) for _ in range(2)]
    for data in pdf["data"].dropna():
        text, *values = unpacked(data)
        at = text.astype(np.int64)
        for total, v in zip(sums, values, strict=True):
            total[at] += v.view(total.dtype)
    named = dict(zip(_SUMS, [keys, *sums], strict=True))
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[0], "text": np.arange(len(keys)), **named})


def scored(docs: DataFrame, held_out, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    A null or empty text is its end token alone. Repeated rows are learned from and scored each. A null doc_id counts as
    the empty id and is kept. An empty table gives no row; without a training text every word is unknown.
    """
    rows, known = _prepared(docs, held_out), model.shared.value
    blocks = rows.select("text", "key").mapInArrow(_occurrence_rows(model.shared), "bucket long, chunk long, occurrences binary")
    held = model.pairs.select("bucket", "data").join(model.weights, "bucket")
    grouped = held.groupBy("bucket").cogroup(blocks.groupBy("bucket"))
    answers = "chunk long, keys binary, data binary, text long, word long, n long"
    found = stored(grouped.applyInPandas(_scores(model.shared, model.factors), answers), "katz-scores")
    # Hashes of words have the upper bit set, so they are negative; packed sums have word 0.
    tails = found.where("word < 0").select("chunk", "text", "word", F.col("n").alias("uses"))
    tails = tails.join(model.words, "word", "left")
    late = F.sum(F.col("uses") * F.log10(_chance(known, F.coalesce("n", F.lit(0))))).alias("late")
    tails = tails.groupBy("chunk", "text").agg(late)
    texts = found.where("word = 0").select("chunk", "keys", "data").groupBy("chunk")
    by_text = texts.applyInPandas(_by_text, "chunk long, text long, key long, rows long, n long, known long, base double, score double")
    score = F.col("score") + F.coalesce("late", F.lit(0.0))
    sums = by_text.join(tails, ["chunk", "text"], "left").groupBy("key").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("known").alias("known"),
        F.sum("base").alias("base"), F.sum(score).alias("score"),
    )
    return rows.select("doc_id", "held_out", "key").join(sums, "key").select(
        "doc_id",
        "held_out",
        (F.col("n") / F.col("rows")).cast("long").alias("n_tokens"),
        (F.col("known") / F.col("rows")).cast("long").alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows")).alias("base_score"),
        (F.col("score") / F.col("rows")).alias("score"),
    )

