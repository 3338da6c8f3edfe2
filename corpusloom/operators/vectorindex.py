"""A stored vector index: cells of a trained coarse quantiser per repository, searched exactly or with a probe list.

Unit vectors of a repository are dealt to the nearest of its centres; the number of centres follows the number of vectors.
For a query ``q``, a centre ``c`` and a cell whose vectors lie within ``r`` of it, ``q . x <= q . c + r`` for each ``x`` in
the cell. A search makes one unit of work per query and cell, best bounds first. The exact search measures the first
cells of every query and then only those whose bound reaches its k-th score; the approximate one measures the
``probes`` cells with the nearest centres. A unit returns its k best rows, so no pair is shuffled, and vectors are never
copied: queries go to the cells.

Nothing is collected. The quantiser is fitted on a sample of about ``SAMPLE`` vectors per centre; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.embed import normalised
from corpusloom.scale import salted_join, top_k
from corpusloom.session import durable_path, slice_count

SAMPLE = 16
MOST_CELLS = 4096
ASSIGN = 16_384
PART = 4096
QUERY_SLICE = 4096
FIRST_CELLS = 8


@dataclass(frozen=True)
class VectorIndex:
    """``vectors``: repo_id, cell, part, chunk_id, unit; ``cells``: repo_id, cell, centre, reach, parts."""

    vectors: DataFrame
    cells: DataFrame


def _unit(vector: Column) -> Column:
    return normalised(F.transform(vector, lambda x: x.cast("double")))


def _tasks(spark: SparkSession) -> int:
    return max(slice_count(spark), spark.sparkContext.defaultParallelism)


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _centres(points: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from a seeded choice of points; an empty cell keeps its centre."""
    points = np.unique(points, axis=0)
    centres = points[np.random.default_rng(len(points)).permutation(len(points))[:count]]
    for _ in range(rounds):
        near = _nearest(points, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        held = np.bincount(near, minlength=len(centres))
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point and the distance to it."""
    near, far = np.zeros(len(points), np.int64), np.zeros(len(points))
    square = (centres * centres).sum(1)
    for i in range(0, len(points), step):
        part = points[i : i + step]
        near[i : i + step] = (square - 2 * part @ centres.T).argmin(1)
        far[i : i + step] = np.linalg.norm(part - centres[near[i : i + step]], axis=1)
    return near, far


def _empty(columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: np.zeros(0, object) for c in columns})


def _by(frame: pd.DataFrame, key: str) -> Iterator[tuple]:
    if len(frame):
        yield from frame.groupby(key, sort=False)


def _usable(chunks: DataFrame) -> DataFrame:
    rows = chunks.where("repo_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    return rows.select(F.col("repo_id").cast("string").alias("repo_id"), "chunk_id", _unit(F.col("embedding")).alias("unit"))


def whole_index(chunks: DataFrame) -> VectorIndex:
    """No quantiser: every repository is one cell in parts of ``PART`` rows. For vectors that are asked only once."""
    rows = _stored(_usable(chunks), durable_path(chunks.sparkSession, "vectors"))
    cells = rows.groupBy("repo_id").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.max(F.size("unit")).alias("dim"))
    cells = _stored(cells, durable_path(chunks.sparkSession, "vector-cells"))
    centre, reach = F.array_repeat(F.lit(0.0), F.col("dim")), F.lit(1.0)
    cells = cells.select("repo_id", F.lit(0).alias("cell"), centre.alias("centre"), reach.alias("reach"), "parts")
    vectors = salted_join(rows, cells.select("repo_id", "cell", "parts"), ["repo_id"], spread_by=["chunk_id"])
    part = F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")
    return VectorIndex(vectors.select("repo_id", "cell", part.alias("part"), "chunk_id", "unit"), cells)


def write_index(chunks: DataFrame, path: str | None = None) -> VectorIndex:
    """Index ``chunks`` (chunk_id, repo_id, embedding) at ``path``; rows without a vector or a repository are left out.

    Without a path the index is kept for this run in the durable folder. Vectors of a repository have one length.
    """
    spark = chunks.sparkSession
    path = path or durable_path(spark, "vector-index")
    rows = _stored(_usable(chunks), f"{path}/units")
    sizes = rows.groupBy("repo_id").agg(F.count("*").alias("n"))
    count = F.least(F.ceil(F.sqrt("n")), F.lit(MOST_CELLS)).cast("int")
    sizes = sizes.select("repo_id", "n", count.alias("wanted"), F.ceil(F.col("n") / ASSIGN).cast("int").alias("slices"))
    sizes = _stored(sizes, f"{path}/sizes")
    draw = F.pmod(F.xxhash64("chunk_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    sample = salted_join(rows, sizes, ["repo_id"], spread_by=["chunk_id"]).where(draw < F.col("wanted") * SAMPLE / F.col("n"))

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        found = _centres(np.stack(frame["unit"].to_numpy()), int(frame["wanted"].iloc[0]))
        return pd.DataFrame({"repo_id": frame["repo_id"].iloc[0], "cell": np.arange(len(found)), "centre": list(found)})

    # A repository whose sample is empty has one cell around the origin.
    trained = sample.groupBy("repo_id").applyInPandas(train, "repo_id string, cell int, centre array<double>")
    trained = _stored(trained, f"{path}/centres")
    groups = _tasks(spark)

    def placed(df: DataFrame) -> DataFrame:
        home = F.xxhash64("repo_id", "slice")
        return df.withColumns({"home": home, "task": F.pmod(home, F.lit(groups))})

    left = salted_join(rows, sizes.select("repo_id", "slices"), ["repo_id"], spread_by=["chunk_id"])
    left = placed(left.withColumn("slice", F.pmod(F.xxhash64("chunk_id"), F.col("slices")).cast("int")).drop("slices"))
    right = trained.join(sizes.select("repo_id", "slices"), "repo_id").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    right = placed(right.drop("slices"))

    def assign(held: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        known, out = dict(_by(centres, "home")), []
        for home, part in _by(held, "home"):
            points = np.stack(part["unit"].to_numpy())
            if home in known:
                cells = known[home].sort_values("cell")
                near, far = _nearest(points, np.stack(cells["centre"].to_numpy()))
                near = cells["cell"].to_numpy()[near]
            else:
                near, far = np.zeros(len(points), np.int64), np.linalg.norm(points, axis=1)
            out.append(part[["repo_id", "chunk_id", "unit"]].assign(cell=near, far=far))
        return pd.concat(out) if out else _empty(["repo_id", "chunk_id", "unit", "cell", "far"])

    kind = rows.schema["chunk_id"].dataType.simpleString()
    schema = f"repo_id string, chunk_id {kind}, unit array<double>, cell int, far double"
    dealt = _stored(left.groupBy("task").cogroup(right.groupBy("task")).applyInPandas(assign, schema), f"{path}/dealt")
    cells = dealt.groupBy("repo_id", "cell").agg(F.max("far").alias("reach"), F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.size(F.first("unit")).alias("dim"))
    cells = cells.join(trained, ["repo_id", "cell"], "left")
    centre = F.coalesce("centre", F.array_repeat(F.lit(0.0), F.col("dim")))
    cells = _stored(cells.select("repo_id", "cell", centre.alias("centre"), "reach", "parts"), f"{path}/cells")
    vectors = salted_join(dealt.drop("far"), cells.select("repo_id", "cell", "parts"), ["repo_id", "cell"], spread_by=["chunk_id"])
    part = F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")
    vectors = _stored(vectors.select("repo_id", "cell", part.alias("part"), "chunk_id", "unit"), f"{path}/vectors")
    return VectorIndex(vectors, cells)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    return VectorIndex(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/cells"))


def _units(queries: DataFrame, cells: DataFrame) -> DataFrame:
    """(query_id, repo_id, cell, bound, near, turn by bound, place by nearness) for each query and cell of its repository."""
    slices = ceil(queries.count() / QUERY_SLICE) or 1
    groups = _tasks(queries.sparkSession)
    home = F.xxhash64("repo_id", "slice")
    mine = queries.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int")).withColumn("home", home)
    held = cells.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("home", home)
    task = F.pmod("home", F.lit(groups))

    def meet(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        known, out = dict(_by(held, "home")), []
        for home, part in _by(asked, "home"):
            if home not in known:
                continue
            own = known[home]
            centres = np.stack(own["centre"].to_numpy())
            points = np.stack(part["unit"].to_numpy())
            dots = points @ centres.T
            far = (centres * centres).sum(1) - 2 * dots
            turn, place = np.argsort(-(dots + own["reach"].to_numpy()), axis=1), np.argsort(far, axis=1)
            for i, query in enumerate(part["query_id"]):
                frame = own[["repo_id", "cell", "parts"]].assign(query_id=query, bound=dots[i] + own["reach"].to_numpy())
                for name, order in (("turn", turn[i]), ("place", place[i])):
                    rank = np.empty(len(order), np.int64)
                    rank[order] = np.arange(1, len(order) + 1)
                    frame[name] = rank
                out.append(frame)
        columns = ["query_id", "repo_id", "cell", "parts", "bound", "turn", "place"]
        return pd.concat(out)[columns] if out else _empty(columns)

    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, repo_id string, cell int, parts int, bound double, turn int, place int"
    pairs = mine.withColumn("task", task).groupBy("task").cogroup(held.withColumn("task", task).groupBy("task"))
    return pairs.applyInPandas(meet, schema)


def _measured(units: DataFrame, queries: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """query_id, chunk_id, score: the k best rows of each unit (scores rounded, so that ties don't depend on batches)."""
    groups = _tasks(queries.sparkSession)
    home = F.xxhash64("repo_id", "cell", "part")
    asked = units.select("query_id", "repo_id", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = asked.join(queries.select("query_id", "unit"), "query_id").withColumn("home", home).withColumn("task", F.pmod("home", F.lit(groups)))
    wanted = units.select("repo_id", "cell").distinct()
    held = index.vectors.join(wanted, ["repo_id", "cell"], "left_semi").withColumn("home", home).withColumn("task", F.pmod("home", F.lit(groups)))

    def score(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        known, out = dict(_by(theirs, "home")), {"query_id": [], "chunk_id": [], "score": []}
        for home, part in _by(ours, "home"):
            if home not in known:
                continue
            own = known[home].sort_values("chunk_id")
            names, points = own["chunk_id"].to_numpy(), np.stack(own["unit"].to_numpy())
            for start in range(0, len(part), 512):
                some = part.iloc[start : start + 512]
                scores = np.round(np.stack(some["unit"].to_numpy()) @ points.T, 9)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                for query, row, at in zip(some["query_id"], scores, best, strict=True):
                    out["query_id"] += [query] * len(at)
                    out["chunk_id"] += names[at].tolist()
                    out["score"] += row[at].tolist()
        return pd.DataFrame(out) if out["query_id"] else _empty(list(out))

    kinds = [queries.schema["query_id"].dataType.simpleString(), index.vectors.schema["chunk_id"].dataType.simpleString()]
    schema = f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double"
    return asked.groupBy("task").cogroup(held.groupBy("task")).applyInPandas(score, schema)


def search(queries: DataFrame, index: VectorIndex, k: int, probes: int | None = None, first_cells: int = FIRST_CELLS) -> DataFrame:
    """query_id, chunk_id, score, rank: the k rows of the query's repository with the largest cosine, ties by chunk_id.

    ``queries`` has query_id, repo_id, vector. With ``probes`` only that many cells per query are looked at. A query without
    a vector or a repository gets nothing; a vector of length zero has cosine 0 with all.
    """
    spark = queries.sparkSession
    asked = queries.where("vector IS NOT NULL AND size(vector) > 0 AND repo_id IS NOT NULL")
    asked = asked.select("query_id", F.col("repo_id").cast("string").alias("repo_id"), _unit(F.col("vector")).alias("unit"))
    asked = _stored(asked, durable_path(spark, "vector-queries"))
    units = _stored(_units(asked, index.cells), durable_path(spark, "vector-units"))
    order = [F.desc("score"), F.col("chunk_id")]
    if probes is not None:
        return top_k(_measured(units.where(F.col("place") <= probes), asked, index, k), ["query_id"], order, k)
    if (units.agg(F.max("turn")).first()[0] or 0) <= first_cells:
        return top_k(_measured(units, asked, index, k), ["query_id"], order, k)
    first = top_k(_measured(units.where(F.col("turn") <= first_cells), asked, index, k), ["query_id"], order, k)
    first = _stored(first, durable_path(spark, "vector-first"))
    bar = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
    later = units.where(F.col("turn") > first_cells).join(bar, "query_id", "left").where("bar IS NULL OR bound + 1e-8 >= bar")
    later = _stored(later.drop("bar"), durable_path(spark, "vector-later"))
    both = first.drop("rank").unionByName(_measured(later, asked, index, k))
    return top_k(both, ["query_id"], order, k)
