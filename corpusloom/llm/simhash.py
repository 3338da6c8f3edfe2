"""Near duplicates by SimHash: fingerprints, linked within a Hamming radius through BK-trees.

1. One fingerprint per text: the majority bit of the XXH64 hashes of its word shingles.
2. Distinct fingerprints are dealt to shards. Of ``m`` bit blocks at least ``m - radius`` agree in two
   fingerprints within the radius, so each choice of ``m - radius`` blocks is a shard key: every link
   lies in some shard. ``m`` follows the number of fingerprints and keeps shards small; it changes the
   work, not the result.
3. Each shard is a BK-tree: a child hangs from its parent by the integer distance between them. A search
   follows only the edges within the radius of the distance at hand. A whole-cluster broadcast of
   all trees would grow with the data, so a tree goes only to the tasks that hold its queries; a shard
   beyond ``tile`` fingerprints is cut into tiles, whose trees are copied to one task per pair of tiles.
4. Links become a spanning forest inside the task, and components of all documents by star contraction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import documents_of, slices_of, stored, tasks
from corpusloom.llm.components import connected, merged

SEED = 42


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """Unsigned hashes of the text's word shingles in their order; all words as one if they are too few."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -width]))
    spans = zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: str, width: int = 4) -> int:
    """The 64-bit fingerprint of one text; 0 without a word."""
    hashes = shingle_hashes(text, width)
    if len(hashes) < 2:
        return int(hashes.sum())
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp long) for every row of ``docs``; a null text counts as empty and gives 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches):
            fps = [fingerprint(t, width) for t in batch.column("text").to_pylist()]
            out = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], ["doc_id", "fp"])

    return documents_of(docs).mapInArrow(run, "doc_id long, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class Forest:
    """BK-trees of many shards, held as arrays: edges keyed by (parent, distance), sorted."""

    def __init__(self, shard: np.ndarray, value: np.ndarray) -> None:
        """``shard``: non-decreasing numbers; ``value``: unsigned fingerprints, distinct in a shard."""
        self.value = value
        n = len(value)
        first = np.ones(n, bool)
        first[1:] = shard[1:] != shard[:-1]
        self.roots = np.flatnonzero(first)
        self.root_of = self.roots[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        left = np.flatnonzero(~first)
        at = self.root_of[left]
        keys, children = [], []
        while len(left):
            edge = at * 65 + popcount(value[left] ^ value[at])
            key, which, back = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(key)
            children.append(left[which])
            rest = np.ones(len(left), bool)
            rest[which] = False
            at = left[which][back][rest]
            left = left[rest]
        edge = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        child = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(edge)
        self.edge, self.child = edge[order], child[order]

    def search(
        self, query: np.ndarray, root: np.ndarray, radius: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """(query number, node) of every node within ``radius`` of a query in the tree of its root."""
        who, node = np.arange(len(query)), root
        found_who, found_node = [], []
        while len(who):
            far = popcount(query[who] ^ self.value[node])
            hit = far <= radius
            found_who.append(who[hit])
            found_node.append(node[hit])
            low = np.searchsorted(self.edge, node * 65 + np.maximum(far - radius, 0))
            high = np.searchsorted(self.edge, node * 65 + np.minimum(far + radius, 64), "right")
            many = high - low
            total = int(many.sum())
            start = np.repeat(low - (np.cumsum(many) - many), many)
            who = np.repeat(who, many)
            node = self.child[start + np.arange(total)]
        if not found_who:
            return who, node
        return np.concatenate(found_who), np.concatenate(found_node)


def _forest_links(radius: int, visits: int = 4_000_000):
    """Spanning edges of all links in one bucket of tiles."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tile", "fp"], kind="stable")
        tile, value = pdf["tile"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
        names, local = np.unique(value, return_inverse=True)
        labels = np.arange(len(names))
        grown = pdf["in_tree"].to_numpy()
        forest = Forest(tile[grown], value[grown])
        tree_local = local[grown]
        tiles = tile[grown][forest.roots]
        sizes = np.diff(np.append(forest.roots, int(grown.sum())))
        asks = np.flatnonzero(pdf["asks"].to_numpy())
        if len(tiles):
            spot = np.minimum(np.searchsorted(tiles, tile[asks]), len(tiles) - 1)
            there = tiles[spot] == tile[asks]
            asks, spot = asks[there], spot[there]
        else:
            asks, spot = asks[:0], asks[:0]
        work = np.cumsum(sizes[spot]) if len(spot) else np.zeros(0, np.int64)
        start = 0
        while start < len(asks):
            base = work[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(work, base + visits, "right")))
            mine = asks[start:stop]
            who, node = forest.search(value[mine], forest.roots[spot[start:stop]], radius)
            labels = merged(labels, local[mine][who], tree_local[node])
            start = stop
        far = np.flatnonzero(labels != np.arange(len(names)))
        signed = names.view(np.int64)
        return pd.DataFrame({"a": signed[far], "b": signed[labels[far]]})

    return run


def _masks(radius: int, count: int, wanted: int = 512) -> list[int]:
    """Bit masks of the shard keys for ``count`` fingerprints: about ``wanted`` or fewer in a shard."""
    m = radius + 1
    while m < 2 * radius + 2 and comb(m, radius) < 200 and count >> (64 * (m - radius) // m) > wanted:
        m += 1
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, m - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = 4, tile: int = 4096) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (fp) linked within ``radius`` bits."""
    spark, count = distinct.sparkSession, distinct.count()
    masks = _masks(radius, count)
    keys = F.array(
        *[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long"))) for i, m in enumerate(masks)]
    )
    rows = distinct.select("fp", F.explode(keys).alias("key"))
    hot = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    parts = F.coalesce(F.ceil(F.col("n") / tile), F.lit(1)).cast("long")
    cut = rows.join(hot, "key", "left").withColumn("parts", parts)
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    buckets = max(tasks(spark), ceil(count * len(masks) / 200_000))
    tiled = cut.select(
        "fp",
        F.xxhash64("key", low, high).alias("tile"),
        (F.col("own") == low).alias("in_tree"),
        (F.col("own") == high).alias("asks"),
    ).withColumn("bucket", F.pmod("tile", F.lit(buckets)))
    return tiled.groupBy("bucket").applyInPandas(_forest_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id reachable through links (fingerprints that differ in at most
    ``radius`` bits), the row's own included. A null or wordless text has fingerprint 0 and links like
    any other. A null doc_id takes part with its text but is nobody's smallest id; a component of such
    rows only has a null id. Repeated rows are returned repeatedly. An empty table gives no row.
    """
    marked = stored(fingerprints(docs, width), "simhash")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    return grouped(marked, distinct, links(distinct, radius))


def grouped(marked: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``marked`` (doc_id, fp).

    ``distinct`` has each fp with its smallest doc_id (low), ``edges`` (a, b) link fps.
    """
    parts = connected(edges).select(F.col("node").alias("fp"), "component")
    rooted = distinct.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = rooted.groupBy("component").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "component").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(named, "fp").select("doc_id", digits, "component_id")


def first_of_each(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest doc_id.

    Of rows that repeat this id, the one with the smallest hash of its text stays. A row without an id
    goes if its group has a row with one, and stays otherwise (nothing names it as a copy).
    """
    return kept_of(docs, near_duplicates(docs, radius, width), lambda text: fingerprint(text, width))


def kept_of(docs: DataFrame, found: DataFrame, mark: Callable[[str], int]) -> DataFrame:
    """The rows of ``docs`` that stay if ``found`` is their grouping; ``mark`` gives a text's unsigned fp."""
    named = found.where("doc_id = component_id").select(F.col("doc_id").alias("_keep_id")).distinct()
    columns = docs.columns
    same = F.col("doc_id").cast("long") == F.col("_keep_id")
    joined = docs.join(named, same).drop("_keep_id")
    order = F.struct(F.xxhash64("text"), F.xxhash64(*columns))
    once = joined.withColumn("_turn", F.row_number().over(Window.partitionBy("doc_id").orderBy(order)))
    kept = once.where("_turn = 1").select(*columns)
    nameless = found.where("doc_id IS NULL AND component_id IS NULL").select("fingerprint").distinct()
    marks = docs.where("doc_id IS NULL")
    return kept.unionByName(_nameless(marks, nameless, mark))


def _nameless(rows: DataFrame, wanted: DataFrame, mark: Callable[[str], int]) -> DataFrame:
    """Rows without an id whose fingerprint is in ``wanted``."""
    columns = rows.columns

    @F.pandas_udf("string")
    def digits(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: f"{mark(t):016x}")

    marked = rows.withColumn("_fingerprint", digits(F.col("text").cast("string")))
    return marked.join(wanted, marked["_fingerprint"] == wanted["fingerprint"], "left_semi").select(*columns)
