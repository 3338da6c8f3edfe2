"""Nearest neighbours with randomly rotated one-bit codes.

A unit vector ``o`` is rotated by a seeded random orthogonal matrix; its code keeps the signs, so the coded
vector ``c`` is the nearest corner of a cube. The scalar ``fit = <c, o>`` corrects the estimate: for a unit query
``q``, ``<c, q> / fit`` estimates ``<o, q>`` without bias, and its error is about normal with deviation
``sqrt(1 - fit^2) / fit / sqrt(D - 1)``. The query's rotated coordinates are rounded to ``QUERY_BITS`` bits, so
``<c, q>`` is a sum of bit counts of the packed code with the query's bit planes.

Queries meet all rows in blocks. Inside a block the best estimates are measured exactly first; every row whose
estimate plus ``epsilon`` deviations reaches the k-th of these is measured too. Nothing else is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BITS = 4
EPSILON = 2.5
BLOCK = 4096


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector array<double>, dim) of rows with an id and a finite vector other than zero."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))
    rows = rows.where("vec_id IS NOT NULL AND vector IS NOT NULL")
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    return rows.where(~odd & some).withColumn("dim", F.size("vector"))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix of the next multiple of 64 (zeros fill a vector up to it)."""
    size = 64 * ceil(dim / 64)
    q, r = np.linalg.qr(np.random.default_rng([seed, size]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def rotated(vectors: np.ndarray, seed: int) -> np.ndarray:
    unit = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
    return unit @ rotation(vectors.shape[1], seed)[: vectors.shape[1]]


def encode(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits (n x D/64 unsigned words) and the correction scalar of each vector."""
    turned = rotated(vectors, seed)
    bits = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
    return bits, np.abs(turned).sum(1) / np.sqrt(turned.shape[1])


class Planes:
    """Queries as bit planes: coordinate = low + step * (4-bit number)."""

    def __init__(self, vectors: np.ndarray, seed: int) -> None:
        turned = rotated(vectors, seed)
        top = (1 << QUERY_BITS) - 1
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / top, 1e-300)
        dither = np.random.default_rng([seed, 1]).random(turned.shape[1])
        number = np.clip(np.floor((turned - self.low[:, None]) / self.step[:, None] + dither), 0, top)
        self.lost = np.sqrt((((self.low[:, None] + self.step[:, None] * number) - turned) ** 2).sum(1))
        number = number.astype(np.uint8)
        self.total = number.sum(1, dtype=np.int64)
        self.planes = [
            np.packbits(number >> j & 1, axis=1, bitorder="little").view(np.uint64) for j in range(QUERY_BITS)
        ]

    def estimates(self, part: slice, bits: np.ndarray, fit: np.ndarray, epsilon: float):
        """Estimated cosines of some queries with all codes, and how far they may be off."""
        size = bits.shape[1] * 64
        ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
        both = np.zeros((len(self.low[part]), len(bits)), np.int64)
        for j, plane in enumerate(self.planes):
            rows = plane[part]
            for w in range(bits.shape[1]):
                both += np.bitwise_count(rows[:, w, None] & bits[None, :, w]).astype(np.int64) << j
        low, step = self.low[part, None], self.step[part, None]
        dot = (2 * (low * ones + step * both) - (low * size + step * self.total[part, None])) / np.sqrt(size)
        off = np.sqrt(np.maximum(1 - fit**2, 0)) / np.sqrt(max(size - 1, 1)) + self.lost[part, None] / np.sqrt(size)
        return dot / fit, epsilon * off / fit


def even(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its largest component is near 1: cosines stay the same to the last bit."""
    _, power = np.frexp(np.abs(vectors).max(1, initial=0.0))
    return np.ldexp(vectors, -power[:, None])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, each sum in the order of the components."""
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for i in range(a.shape[1]):
        dot += a[:, i] * b[:, i]
        aa += a[:, i] * a[:, i]
        bb += b[:, i] * b[:, i]
    return np.clip(dot / (np.sqrt(aa) * np.sqrt(bb)), -1.0, 1.0)


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
    bits: np.ndarray, fit: np.ndarray, k: int, seed: int, epsilon: float, step: int = 128,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, cosine) of the k best rows of this block for each query."""
    planes, out = Planes(queries, seed), []
    first = min(len(ids), 4 * k + 1)
    length, own_length = (np.sqrt((v * v).sum(1)) for v in (vectors, queries))
    for start in range(0, len(queries), step):
        part = slice(start, start + step)
        guess, off = planes.estimates(part, bits, fit, epsilon)
        own = query_ids[part, None] == ids[None, :]
        guess[own] = -np.inf
        near = np.argpartition(-guess, first - 1, axis=1)[:, :first]
        who = np.repeat(np.arange(len(guess)), first)
        exact = np.full(guess.shape, -np.inf)
        exact[who, near.ravel()] = _measured(queries[part], vectors, who, near.ravel(), own_length[part], length)
        exact[own] = -np.inf
        bar = _best(exact, k)
        who, row = np.nonzero((guess + off >= bar[:, None]) & ~own)
        exact[who, row] = _measured(queries[part], vectors, who, row, own_length[part], length)
        # The order is decided by the exact measure, summed alike for every pair, so that equal vectors tie.
        who, row = np.nonzero(exact >= np.maximum(_best(exact, k) - 1e-9, -2.0)[:, None])
        score = cosine(queries[part][who], vectors[row])
        order = np.lexsort((ids[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        turn = np.arange(len(who)) - np.searchsorted(who, who)
        best = turn < k
        out.append((who[best] + start, row[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _best(exact: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity where a row has fewer columns."""
    if exact.shape[1] < k:
        return np.full(len(exact), -np.inf)
    return -np.partition(-exact, k - 1, axis=1)[:, k - 1]


def _measured(queries, vectors, who, row, own_length, length, step: int = 8192) -> np.ndarray:
    """Cosines of the chosen pairs on the original vectors."""
    out = np.empty(len(who))
    for i in range(0, len(who), step):
        w, r = who[i : i + step], row[i : i + step]
        out[i : i + step] = np.einsum("ij,ij->i", queries[w], vectors[r]) / (own_length[w] * length[r])
    return out


def index(vectors: DataFrame, seed: int = 11) -> DataFrame:
    """Every usable row with its code and correction scalar (from ``usable``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            codes, fits = [b""] * len(frame), np.zeros(len(frame))
            for _, at in frame.groupby("dim").indices.items():
                bits, fit = encode(even(np.stack(frame["vector"].to_numpy()[at])), seed)
                for i, row in zip(at.tolist(), bits, strict=True):
                    codes[i] = row.tobytes()
                fits[at] = fit
            columns = [batch.column(c) for c in ("vec_id", "vector", "dim")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(codes, pa.binary()), pa.array(fits)], ["vec_id", "vector", "dim", "code", "fit"]
            )

    return vectors.mapInArrow(run, "vec_id long, vector array<double>, dim int, code binary, fit double")


def nearest(
    vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    seed: int = 11, epsilon: float = EPSILON, block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows by cosine for each row that ``is_query`` (of vec_id) holds.

    Ties go to the smaller vec_id; a query with fewer candidates gets all. Rows with a null id, or whose vector is
    null, empty, zero or not finite, take no part; vectors of different lengths are not compared; rows that repeat
    an id count once (the smallest vector). An empty table gives no row.
    """
    coded = index(usable(vectors, id_col, vector_col), seed)
    sizes = usable(vectors, id_col, vector_col).agg(F.count("*").alias("n"), F.sum(is_query("vec_id").cast("long")).alias("q")).first()
    rows, asks = ceil(sizes["n"] / block) or 1, ceil((sizes["q"] or 0) / block) or 1
    place = F.pmod(F.xxhash64("vec_id"), F.lit(rows)).cast("int")
    turn = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(asks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = coded.withColumns({"place": place, "turn": every(asks)}) if asks > 1 else coded.withColumns({"place": place, "turn": F.lit(0)})
    queries = usable(vectors, id_col, vector_col).where(is_query("vec_id"))
    queries = queries.select("vec_id", "vector", "dim", turn.alias("turn"), every(rows).alias("place"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = {"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)}
        if len(left) and len(right):
            left, right = _once(left), _once(right)
            ids, query_ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
            bits = np.frombuffer(b"".join(left["code"]), np.uint64).reshape(len(left), -1)
            who, row, score = search_block(
                query_ids, even(np.stack(right["vector"].to_numpy())), ids, even(np.stack(left["vector"].to_numpy())),
                bits, left["fit"].to_numpy(), k, seed, epsilon,
            )
            found = {"query_id": query_ids[who], "vec_id": ids[row], "score": score}
        return pd.DataFrame(found)

    keys = ["dim", "place", "turn"]
    hits = data.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _once(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per id: the smallest vector of those that repeat it."""
    if rows["vec_id"].is_unique:
        return rows
    order = rows["vector"].map(tuple)
    return rows.assign(_order=order).sort_values(["vec_id", "_order"]).drop_duplicates("vec_id").drop(columns="_order")
