"""Near-duplicate vectors through an inverted multi-index.

Unit vectors are cut into halves, each with a codebook of its own; the product of both is a grid of cells, and a
vector lies in the cell of its two nearest centroids. For a vector ``x`` a centroid ``c`` of one half can only own a
vector within the link distance ``r`` if ``x`` is within ``r`` of the half-space nearer to ``c`` than to any other
centroid; so each half gives every centroid a least distance, and a cell's is the sum of both squares. The
multi-sequence traversal goes through the two sorted lists of least distances, nearest cells first, and stops where
the sum passes ``r^2``. No cell beyond holds a link, so the target recall is 1. What is visited is then verified by
cosine in double precision.

Neighbouring cells form areas. A vector is sent once to each area where it visits a cell, with a bit for each cell there,
and not once for each cell: what is shuffled grows with the number of areas, which are as large as a task can hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, isqrt, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import mix64, stored
from corpusloom.llm.components import connected, merged
from corpusloom.llm.rotated_codes import cosine, usable

SAMPLE = 20_000
CELL = 128
MOST = 512
TILE = 2048
STEP = 2048
HELD = 1 << 22
PASSING = 1 << 20
GROUPS = 3


def codebook(points: np.ndarray, size: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids by k-means on a sample; fewer if the sample has fewer distinct points."""
    distinct = np.unique(points, axis=0)
    size = min(size, len(distinct))
    centers = distinct[np.random.default_rng(seed).permutation(len(distinct))[:size]]
    for _ in range(rounds):
        near = _squares(points, centers).argmin(1)
        many = np.bincount(near, minlength=size)
        sums = np.stack([np.bincount(near, points[:, i], size) for i in range(points.shape[1])], 1) if points.shape[1] else centers
        centers = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centers)
    return np.unique(centers, axis=0)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :], 0)


def least_squares(x: np.ndarray, centers: np.ndarray, nearest: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(cell, least squared distance of each row to each centroid's region)."""
    d = _squares(x, centers)
    between = np.sqrt(_squares(centers, centers))
    near = np.argsort(d, axis=1)[:, : min(nearest, d.shape[1])]
    bound = np.zeros_like(d)
    for m in near.T:
        apart = between[m]
        ahead = (d - np.take_along_axis(d, m[:, None], 1)) / np.where(apart > 1e-9, 2 * apart, np.inf)
        bound = np.maximum(bound, ahead)
    return near[:, 0], np.maximum(bound - 1e-9, 0) ** 2


def traversal(first: np.ndarray, second: np.ndarray, limit: float) -> np.ndarray:
    """Cells (i * len(second) + j) with first[i] + second[j] <= limit, in the order of the sum.

    Both lists are walked sorted: for each of the first, a prefix of the second is within the limit.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    many = np.searchsorted(second[b], limit - first[a], "right")
    many[first[a] > limit] = 0
    i = np.repeat(a, many)
    j = b[np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)]
    order = np.argsort(first[i] + second[j], kind="stable")
    return (i * len(second) + j)[order]


def _binary(rows: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(rows.tobytes())])


def packed(x: np.ndarray) -> pa.Array:
    """Vectors as bytes: four a component where that is exact, else eight."""
    with np.errstate(over="ignore"):
        short = x.astype("<f4")
    return _binary(short if np.array_equal(short.astype(np.float64), x) else x.astype("<f8"))


def unpacked(values: pa.Array, dim: int) -> np.ndarray:
    size, out = pc.binary_length(values).to_numpy(zero_copy_only=False), np.empty((len(values), dim))
    for kind in ("<f4", "<f8"):
        at = np.flatnonzero(size == dim * np.dtype(kind).itemsize)
        if len(at):
            out[at] = np.frombuffer(b"".join(values.take(pa.array(at)).to_pylist()), kind).reshape(-1, dim)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _assigned(distinct: DataFrame, books: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``distinct`` with its own cell; vectors as bytes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for start in range(0, whole.num_rows, STEP):
                batch = whole.slice(start, STEP)
                vectors = np.stack(batch.column("vector").to_numpy(zero_copy_only=False))
                x, half = _unit(vectors), vectors.shape[1] // 2
                own1, _ = least_squares(x[:, :half], books[0])
                own2, _ = least_squares(x[:, half:], books[1])
                own = pa.array((own1 * len(books[1]) + own2).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), packed(vectors), own], ["rep", "copies", "vector", "cell"])

    return distinct.mapInArrow(run, "rep long, copies long, vector binary, cell long")


@dataclass(frozen=True)
class Areas:
    """Runs of neighbouring cells; a task holds the members of an area, or of a piece of it, and sees its visitors pass.

    ``of`` and ``used`` tell a cell's area and whether it has members, ``starts`` the first cell of each area. An area's
    members are dealt over its ``pieces``, its visitors over ``turns``; ``base`` is the number of its first group.
    """

    of: np.ndarray
    used: np.ndarray
    starts: np.ndarray
    pieces: np.ndarray
    turns: int

    @property
    def base(self) -> np.ndarray:
        return (np.cumsum(self.pieces) - self.pieces) * self.turns

    @property
    def groups(self) -> int:
        return int(self.pieces.sum()) * self.turns


def areas_of(members: np.ndarray, dim: int, groups: int) -> Areas:
    """Areas for cells with so many members.

    A vector is sent once a turn and once for each area that it visits, so both numbers are kept small: members fill what a
    task may hold, and there are about ``groups`` groups unless that takes more.
    """
    n = int(members.sum())
    most = max(1, min(HELD // dim, max(TILE, ceil(n / ceil(sqrt(2 * groups))))))
    _, of = np.unique((np.cumsum(members) - members) // most, return_inverse=True)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    pieces = np.maximum(np.ceil(np.bincount(of, members) / (2 * most)).astype(np.int64), 1)
    turns = max(min(ceil(groups / pieces.sum()), ceil(n / TILE)), ceil(n / PASSING), 1)
    return Areas(of, members > 0, starts, pieces, turns)


def _sent(cells: DataFrame, books: tuple[np.ndarray, np.ndarray], limit: float, areas: Areas) -> DataFrame:
    """Rows for the groups: members (``visits`` is null), and visitors with the cells of the area that they visit, as bits.

    A vector visits its own cell and higher ones: a link is seen from its lower side.
    """
    half, dim, size = books[0].shape[1], books[0].shape[1] + books[1].shape[1], len(areas.of)
    step, ends = max(1, min(STEP, (1 << 24) // size)), np.append(areas.starts[1:], size)
    names = ["home", "visits", "rep", "copies", "vector", "cell"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, step) for whole in parts for i in range(0, whole.num_rows, step)):
            own, rep = batch.column("cell").to_numpy(), batch.column("rep").to_numpy()
            piece, turn = mix64(rep.astype(np.uint64)), (mix64(rep.astype(np.uint64) ^ np.uint64(1 << 63)) % np.uint64(areas.turns)).astype(np.int64)
            columns = [batch.column(c) for c in names[2:]]
            home = areas.base[areas.of[own]] + (piece % areas.pieces[areas.of[own]].astype(np.uint64)).astype(np.int64) * areas.turns
            for i in range(areas.turns):
                yield pa.RecordBatch.from_arrays([pa.array(home + i), pa.nulls(len(own), pa.binary()), *columns], names)
            x = _unit(unpacked(batch.column("vector"), dim))
            near1, near2 = least_squares(x[:, :half], books[0])[1], least_squares(x[:, half:], books[1])[1]
            seen = np.zeros((len(own), size), bool)
            for row, o, a, b in zip(seen, own, near1, near2, strict=True):
                visits = traversal(a, b, limit)
                row[visits[visits >= o]] = True
            seen &= areas.used
            for area, (start, end) in enumerate(zip(areas.starts, ends, strict=True)):
                at = np.flatnonzero(seen[:, start:end].any(1))
                if not len(at):
                    continue
                there, bits = [c.take(pa.array(at)) for c in columns], _binary(np.packbits(seen[at, start:end], axis=1))
                for i in range(areas.pieces[area]):
                    home = areas.base[area] + i * areas.turns + turn[at]
                    yield pa.RecordBatch.from_arrays([pa.array(home), bits, *there], names)

    return cells.mapInArrow(run, "home long, visits binary, rep long, copies long, vector binary, cell long")


class _Members:
    """The members of an area (or a piece of it), and the links found so far."""

    def __init__(self, rows: pa.Table, dim: int, least: float, start: int) -> None:
        rows = rows.sort_by("cell").combine_chunks()
        self.reps, self.copies, self.cells = (rows[c].to_numpy() for c in ("rep", "copies", "cell"))
        self.vectors = unpacked(rows["vector"].combine_chunks(), dim)
        self.unit = _unit(self.vectors)
        self.begin = np.flatnonzero(np.diff(self.cells, prepend=-1))
        self.end = np.append(self.begin[1:], len(self.cells))
        self.total, self.labels = np.zeros(len(self.reps), np.int64), np.arange(len(self.reps))
        self.dim, self.least, self.start = dim, least, start

    def met(self, visitors: pa.RecordBatch) -> pa.RecordBatch:
        """Links of some visitors: their number, and one linked member."""
        asks, copies, own = (visitors.column(c).to_numpy() for c in ("rep", "copies", "cell"))
        q = unpacked(visitors.column("vector"), self.dim)
        unit, total, root = _unit(q), np.zeros(len(q), np.int64), np.full(len(q), -1)
        bits = np.frombuffer(b"".join(visitors.column("visits").to_pylist()), np.uint8).reshape(len(q), -1)
        bits = np.ascontiguousarray(np.unpackbits(bits, axis=1).T)
        for begin, end in zip(self.begin, self.end, strict=True):
            here = np.flatnonzero(bits[self.cells[begin] - self.start])
            for some in (here[i : i + 512] for i in range(0, len(here), 512)):
                for first in range(begin, end, TILE):
                    part = slice(first, min(first + TILE, end))
                    near = unit[some] @ self.unit[part].T
                    i, j = np.nonzero(near >= self.least - 1e-9)
                    true = near[i, j] >= self.least + 1e-9
                    i, j = some[i], j + first
                    close = np.flatnonzero(~true)
                    if len(close):
                        true[close] = cosine(q[i[close]], self.vectors[j[close]]) >= self.least
                    # Inside one cell both sides see a link: it counts where the visitor has the smaller id.
                    inside = own[i] == self.cells[begin]
                    true &= (asks[i] < self.reps[j]) | (~inside & (asks[i] != self.reps[j]))
                    i, j = i[true], j[true]
                    np.add.at(total, i, self.copies[j])
                    np.add.at(self.total, j, copies[i])
                    new = root[i] < 0
                    root[i[new]] = j[new]
                    self.labels = merged(self.labels, root[i], j)
        some = np.flatnonzero(total)
        return _found(asks[some], total[some], self.reps[root[some]])

    def all(self) -> pa.RecordBatch:
        """Links of the members, and the smallest member that each hangs together with."""
        some = np.flatnonzero(self.total)
        return _found(self.reps[some], self.total[some], self.reps[self.labels[some]])


def _found(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "n", "root"])


def _verified(sent: DataFrame, dim: int, least: float, areas: Areas) -> DataFrame:
    """(node, n, root): each group's members are held, its visitors come after them."""
    area = np.repeat(np.arange(len(areas.pieces)), areas.pieces * areas.turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, held, members = -1, [], None
        for batch in batches:
            homes, asks = batch.column("home").to_numpy(), pc.is_valid(batch.column("visits")).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(homes * 2 + asks)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(homes)], strict=True):
                if homes[start] != home:
                    if members:
                        yield members.all()
                    home, held, members = homes[start], [], None
                if not asks[start]:
                    held.append(batch.slice(start, end - start))
                    continue
                if held:
                    members, held = _Members(pa.Table.from_batches(held), dim, least, areas.starts[area[home]]), []
                if members:  # a piece may be empty
                    for i in range(start, end, STEP):
                        yield members.met(batch.slice(i, min(STEP, end - i)))
        if members:
            yield members.all()

    dealt = sent.repartitionById(areas.groups, F.col("home").cast("int"))
    return dealt.sortWithinPartitions("home", F.isnotnull("visits")).mapInArrow(run, "node long, n long, root long")


def _links(distinct: DataFrame, least: float) -> DataFrame:
    """(node, n, root) for vectors of one length: linked vectors counted with their copies."""
    n = distinct.count()
    share = min(1.0, SAMPLE / max(n, 1))
    drawn = distinct.where(F.pmod(F.xxhash64(F.lit(9), "rep"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    points = np.stack([np.array(r["vector"]) for r in drawn.select("vector").collect()] or [np.array(distinct.first()["vector"])])
    points = points / np.sqrt((points * points).sum(1))[:, None]
    size, dim = min(MOST, max(2, isqrt(n // CELL))), points.shape[1]
    books = codebook(points[:, : dim // 2], size), codebook(points[:, dim // 2 :], size)
    cells = stored(_assigned(distinct, books), "imi-cells")
    # At most MOST^2 cells: a bounded table.
    counts = cells.groupBy("cell").agg(F.count("*").alias("m")).toPandas()
    members = np.zeros(len(books[0]) * len(books[1]), np.int64)
    members[counts["cell"].to_numpy()] = counts["m"].to_numpy()
    areas = areas_of(members, dim, GROUPS * distinct.sparkSession.sparkContext.defaultParallelism)
    return _verified(_sent(cells, books, 2 - 2 * least + 1e-9, areas), dim, least, areas)


def near_duplicates(
    vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal vectors are compared once and counted with their copies. A vector that is null, empty, zero or not finite
    links with nothing, and so do vectors of different lengths. Repeated rows (same id, same vector) are one vector
    and give one row; a null id links with nothing and keeps its row with a null component. An empty table gives no row.
    """
    good = usable(vectors, id_col, vector_col)
    # -0.0 and 0.0 are the same component.
    plain = F.transform("vector", lambda x: x + F.lit(0.0))
    good = good.withColumn("vector", plain)
    key = F.struct(F.xxhash64("vector"), F.xxhash64(F.lit(1), F.reverse("vector")))
    good = good.withColumn("key", key)
    once = good.groupBy("key", "vec_id").agg(F.first("vector").alias("vector"), F.first("dim").alias("dim"))
    distinct = stored(
        once.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"), F.first("dim").alias("dim")),
        "imi-distinct",
    )
    found = None
    for row in distinct.select("dim").distinct().orderBy("dim").collect():
        part = _links(distinct.where(F.col("dim") == row["dim"]).select("rep", "copies", "vector"), least)
        found = part if found is None else found.union(part)
    everything = vectors.select(F.col(id_col).cast("long").alias("vec_id")).distinct()
    none = F.lit(0).cast("long").alias("n_links")
    if found is None:
        return everything.select("vec_id", none, F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found, "imi-links")
    parts = connected(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("node").agg(F.sum("n").alias("n")).join(parts, "node", "left")
    named = distinct.join(sums, F.col("rep") == F.col("node"), "left").select(
        "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    linked = good.select("key", "vec_id").distinct().join(named, "key").groupBy("vec_id").agg(
        F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id")
    )
    out = everything.join(linked, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id").alias("component_id")
    kept = F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component, kept)
