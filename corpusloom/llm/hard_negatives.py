"""Hard negatives from scores inside a window below each positive's, with bounds along a spanning tree of anchors.

Vectors become integers (``floor(scale * x)``), scores are their integer inner products. For an anchor ``c`` whose
parent ``p`` has the score ``s`` with a candidate ``x``, the score of ``c`` lies within ``s`` plus or minus
``|c - p| * |x|``. The anchors of a block form a minimum spanning tree, so edges are short. Each task walks the tree
from the root with an interval for every candidate (a point, if its score was computed) and computes scores only where the
interval meets a window: for positives from the k-th largest lower bound up, for negatives between ``low`` and
``high`` percent of a positive's score. What isn't computed lies outside, so results are exact.

Anchors and rows meet in blocks of bounded size whatever the labels are, so a label with a third of all rows isn't
a group of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stored
from corpusloom.scale import top_k

BLOCK = 4096
GROUP = 512
_EXACT = 2.0**45
_LONG = np.iinfo(np.int64)


def scaled(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(vectors * scale)


def spanning_tree(points: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(node, parent, distance to it) of a minimum spanning tree from node 0 on, parents first."""
    square = (points * points).sum(1)
    near, parent = np.full(len(points), np.inf), np.zeros(len(points), np.int64)
    done, node = np.zeros(len(points), bool), 0
    for _ in range(len(points)):
        done[node] = True
        yield node, int(parent[node]), float(np.linalg.norm(points[node] - points[parent[node]]))
        far = np.maximum(square + square[node] - 2 * (points @ points[node]), 0)
        closer = ~done & (far < near)
        near[closer], parent[closer] = far[closer], node
        node = int(np.argmin(np.where(done, np.inf, near)))


class Candidates:
    """Integer vectors with their ids and labels, ordered by id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.measured = 0

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Inner products of the chosen rows; whole numbers in doubles, or Python's where doubles can't hold them.

        Scores beyond a long are held at its limits.
        """
        self.measured += len(at)
        if not len(at):
            return np.zeros(0)
        if self.norms[at].max() * np.linalg.norm(anchor) < _EXACT:
            return self.vectors[at] @ anchor
        whole = [int(x) for x in anchor]
        dots = [sum(int(x) * y for x, y in zip(row, whole, strict=True)) for row in self.vectors[at].tolist()]
        return np.array([min(max(d, int(_LONG.min)), int(_LONG.max)) for d in dots], object)


def walked(
    anchors: np.ndarray, rows: Candidates, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray]
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, candidates, scores) along the tree; ``wanted`` (anchor, lower, upper) marks what must be computed."""
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    tree = list(spanning_tree(anchors))
    children = np.bincount([p for n, p, _ in tree if n], minlength=len(anchors))
    for node, parent, far in tree:
        reach = rows.norms * np.linalg.norm(anchors[node])
        reach = reach * (1 + 1e-9) + 1
        low, high = -reach, reach
        if node:
            slack = rows.norms * far * (1 + 1e-9) + 1
            low, high = np.maximum(low, bounds[parent][0] - slack), np.minimum(high, bounds[parent][1] + slack)
            children[parent] -= 1
            if not children[parent]:
                del bounds[parent]
        at = np.flatnonzero(wanted(node, low, high))
        score = rows.scores(at, anchors[node])
        if children[node]:
            low[at] = high[at] = score.astype(np.float64)
            bounds[node] = low, high
        yield node, at, score


def best_first(at: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Order by falling score; ``at`` is in order of the ids, which decide ties."""
    return np.argsort(-score, kind="stable")


def positives_in(ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, rows: Candidates, k: int) -> Iterator[tuple]:
    """(anchor number, row number, score) of the k best other rows of each anchor's label."""

    def wanted(node: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mine = (rows.labels == labels[node]) & (rows.ids != ids[node])
        floor = low[mine]
        bar = np.partition(floor, len(floor) - k)[len(floor) - k] if len(floor) > k else -np.inf
        return mine & (high >= bar)

    for node, at, score in walked(anchors, rows, wanted):
        for i in best_first(at, score)[:k].tolist():
            yield node, int(at[i]), score[i]


def negatives_in(
    labels: np.ndarray, anchors: np.ndarray, positives: list[list[int]], rows: Candidates, k: int, low: int, high: int
) -> Iterator[tuple]:
    """(anchor number, positive number, row number, score) of the k best rows in each positive's window."""

    def wanted(node: int, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        near = np.zeros(len(least), bool)
        for p in positives[node]:
            near |= (100.0 * most + 100 >= low * p) & (100.0 * least - 100 <= high * p)
        return near & (rows.labels != labels[node])

    for node, at, score in walked(anchors, rows, wanted):
        order = best_first(at, score)
        falling = [int(s) for s in score[order]]
        for turn, p in enumerate(positives[node]):
            start = _first(falling, lambda s, p=p: 100 * s <= high * p)
            for i in range(start, min(start + k, len(falling))):
                if 100 * falling[i] < low * p:
                    break
                yield node, turn, int(at[order[i]]), falling[i]


def _first(falling: list[int], holds: Callable[[int], bool]) -> int:
    """The first place whose value ``holds``; it then holds for all later ones."""
    a, b = 0, len(falling)
    while a < b:
        mid = (a + b) // 2
        a, b = (a, mid) if holds(falling[mid]) else (mid + 1, b)
    return a


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vector, dim), one row per id: of those that repeat it, the smallest label and vector."""
    vector, bad = F.col(vector_col).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    picked = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector"))
    picked = picked.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(~F.exists("vector", bad))
    once = picked.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return once.select("vec_id", "row.label", "row.vector", F.size("row.vector").alias("dim"))


def _matrix(frame: pd.DataFrame, scale: float) -> np.ndarray:
    return scaled(np.stack(frame["vector"].to_numpy()).astype(np.float64), scale)


def _finite(frame: pd.DataFrame, scale: float) -> tuple[pd.DataFrame, np.ndarray]:
    matrix = _matrix(frame, scale)
    good = np.isfinite(matrix).all(1)
    return (frame, matrix) if good.all() else (frame[good], matrix[good])


def _groups(left: pd.DataFrame, right: pd.DataFrame, scale: float) -> Iterator[tuple[pd.DataFrame, np.ndarray, Candidates]]:
    """The anchors of a task in groups (with their integer vectors), and its candidates."""
    if not len(left) or not len(right):
        return
    left, matrix = _finite(left, scale)
    rows = Candidates(left["vec_id"].to_numpy(), left["label"].to_numpy(), matrix)
    right, matrix = _finite(right, scale)
    # Anchors of one label lie near each other, so they share a group where they can.
    order = np.lexsort((right["vec_id"].to_numpy(), right["label"].to_numpy()))
    for i in range(0, len(order), GROUP):
        part = order[i : i + GROUP]
        yield right.iloc[part], matrix[part], rows


def mined(
    rows: DataFrame, is_anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor its best ``positives`` other rows of its label; for each of them the best ``negatives`` rows of
    other labels whose score lies within ``low`` to ``high`` percent of the positive's. Ties go to the smaller id. A
    positive without such a row gives none (as does any with a negative score: its window is empty). Rows with a null
    id or label, or a vector that is null or not finite (also after scaling), take no part; vectors of different
    lengths are not compared; rows that repeat an id count once (smallest label, then vector). Scores beyond a long
    are held at its limits. An empty table gives no row.
    """
    spark = rows.sparkSession
    each = stored(usable(rows, id_col, vector_col, label_col), "negatives-rows")
    sizes = each.agg(F.count("*").alias("n"), F.sum(is_anchor(F.col("vec_id")).cast("long")).alias("q")).first()
    slices, blocks = ceil(sizes["n"] / block) or 1, ceil((sizes["q"] or 0) / block) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int").alias("place")
    turn = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("turn")
    keys = ["dim", "place", "turn"]
    data = each.select("vec_id", "label", "vector", "dim", place, every(blocks).alias("turn")).groupBy(*keys)
    anchors = each.where(is_anchor(F.col("vec_id")))

    def find_positives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for mine, matrix, found in _groups(left, right, scale):
            ids = mine["vec_id"].to_numpy()
            hits = positives_in(ids, mine["label"].to_numpy(), matrix, found, positives)
            out += [(ids[a], found.ids[r], int(s)) for a, r, s in hits]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"])

    asks = anchors.select("vec_id", "label", "vector", "dim", turn, every(slices).alias("place")).groupBy(*keys)
    near = data.cogroup(asks).applyInPandas(find_positives, "anchor_id long, positive_id long, positive_score long")
    near = top_k(near, ["anchor_id"], [F.desc("positive_score"), F.col("positive_id")], positives)
    near = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("found"))
    near = near.select("anchor_id", F.col("found.positive_id").alias("pos"), F.col("found.positive_score").alias("pos_scores"))
    known = stored(anchors.join(near, anchors["vec_id"] == near["anchor_id"]).drop("anchor_id"), "negatives-anchors")

    def find_negatives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for mine, matrix, found in _groups(left, right, scale):
            ids, pos = mine["vec_id"].to_numpy(), mine["pos"].to_list()
            scores = [[int(s) for s in x] for x in mine["pos_scores"]]
            hits = negatives_in(mine["label"].to_numpy(), matrix, scores, found, negatives, low, high)
            out += [(ids[a], pos[a][p], found.ids[r], scores[a][p], s) for a, p, r, s in hits]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    asks = known.select("vec_id", "label", "vector", "dim", "pos", "pos_scores", turn, every(slices).alias("place")).groupBy(*keys)
    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    hits = data.cogroup(asks).applyInPandas(find_negatives, schema)
    ranked = top_k(hits, ["anchor_id", "positive_id"], [F.desc("negative_score"), F.col("negative_id")], negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def check_sql() -> str:
    """The same in SQL for the table ``embeddings``, as ``op13_hard_negatives`` reads it."""
    return """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
 p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
 n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score),
 r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS n FROM n)
 SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE n <= 3"""
