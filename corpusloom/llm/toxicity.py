"""Toxicity severity by cumulative-link (proportional odds) regression on sparse text features.

``P(grade > k) = sigmoid(w . x - t_k)``: one weight vector ``w`` for all ordered thresholds
``t_0 <= t_1 <= ...``. Features are words and their character five-grams; ``x`` is ``log(1 + uses)``.
The features and the weights are learned on a sample of the labelled rows whose expected size is
``sample`` (drawn by a seeded hash of the id); everything else covers all rows and whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import documents_of, slices_of, stored

PUNCTUATION = b".,;:!?()[]{}\"'|*_<>/\\"
_FOLD = bytes.maketrans(
    bytes(range(65, 91)) + PUNCTUATION, bytes(range(97, 123)) + b" " * len(PUNCTUATION)
)
SAMPLE = 12_000
MEMO = 120_000
LONG = 62


@dataclass
class Model:
    """Weights by feature, and the thresholds (none: no grade was seen, all texts get severity 0)."""

    weights: dict[bytes, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def features_of(word: bytes) -> Iterator[bytes]:
    """The word, marked, and all its five-byte pieces; a piece comes as often as it is there."""
    framed = b"^" + word + b"$"
    yield framed
    for i in range(len(framed) - 4):
        yield framed[i : i + 5]


class _Uses(dict):
    """Word -> indices of its selected features (mostly none); forgets everything when it grows.

    Words above ``LONG`` bytes are read whole but not remembered."""

    def __init__(self, index: dict[bytes, int]) -> None:
        super().__init__()
        self.index = index

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = tuple({self.index[f] for f in features_of(word) if f in self.index})
        if len(word) <= LONG:
            if len(self) > MEMO:
                self.clear()
            self[word] = found
        return found

    def counts(self, text: str) -> Counter:
        uses: Counter = Counter()
        for found in filter(None, map(self.__getitem__, words_of(text))):
            uses.update(found)
        return uses


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 5) -> DataFrame:
    """(doc_id, text, toxic) of a sample of labelled rows; rows with a null id or label take no part."""
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    clean = clean.dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, clean.count()))
    drawn = clean.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return documents_of(docs).join(F.broadcast(drawn), "doc_id")


def selected(sample: DataFrame, limit: int = 4096, least: int = 5) -> DataFrame:
    """(feature, odds): the features whose presence tells most about the label, strongest first.

    ``sample`` has text and toxic. Counts are documents; the statistic is the signed square root of the
    likelihood ratio, and only features for the toxic side are taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in slices_of(batches, chars=1_000_000):
            rows = zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True)
            for text, toxic in rows:
                words = set(words_of(text))
                seen[toxic > 0].update({f for w in words for f in features_of(w)})
            if len(seen[0]) + len(seen[1]) > 250_000:
                yield flushed(seen)
        yield flushed(seen)

    def flushed(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
        names = list(seen[0].keys() | seen[1].keys())
        columns = [pa.array(names, pa.binary())]
        columns += [pa.array([c[n] for n in names], pa.int64()) for c in seen]
        for c in seen:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, ["feature", "clean", "toxic"])

    counts = sample.mapInArrow(run, "feature binary, clean long, toxic long")
    counts = counts.groupBy("feature").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    n = sample.agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("nb"), F.count("*").alias("n")).first()
    nb, na = float(n["nb"] or 0), float(n["n"] - (n["nb"] or 0))
    rate = (F.col("a") + F.col("b")) / F.lit(max(na + nb, 1.0))

    def part(got: str, of: float):
        want = rate * of
        return F.when(F.col(got) > 0, F.col(got) * F.log(F.col(got) / want)).otherwise(0.0)

    odds = F.log((F.col("b") + 0.5) / (nb + 1)) - F.log((F.col("a") + 0.5) / (na + 1))
    scored = counts.where(F.col("b") >= least).select("feature", odds.alias("odds"), (part("a", na) + part("b", nb)).alias("gain"))
    return scored.where("odds > 1").orderBy(F.desc("gain"), "feature").limit(limit).select("feature", "odds")


def graded(sample: DataFrame, index: dict[bytes, int], strong: set[int], heavy: int) -> DataFrame:
    """(grade, features, uses): 0 not toxic, 1 toxic, 2 toxic with ``heavy`` or more marked words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Uses(index)
        for batch in slices_of(batches, chars=1_000_000):
            grades, where, uses = [], [], []
            rows = zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True)
            for text, toxic in rows:
                found = [memo[w] for w in words_of(text)]
                dose = sum(1 for f in found if not strong.isdisjoint(f))
                counts = Counter(i for f in found for i in f)
                grades.append(int(toxic > 0) + int(toxic > 0 and dose >= heavy))
                where.append(list(counts.keys()))
                uses.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(grades, pa.int32()), pa.array(where, pa.list_(pa.int32())), pa.array(uses, pa.list_(pa.int32()))],
                ["grade", "features", "uses"],
            )

    return sample.select("text", "toxic").mapInArrow(run, "grade int, features array<int>, uses array<int>")


def fit(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int,
    ridge: float = 2e-5, rounds: int = 300,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch gradient steps with momentum (Adam) on sparse entries."""
    n, top = len(grades), int(grades.max()) if len(grades) else 0
    if top == 0:
        return np.zeros(width), np.zeros(0)
    above = grades[:, None] > np.arange(top)[None, :]
    share = np.clip(above.mean(0), 1e-4, 1 - 1e-4)
    first = np.log((1 - share) / share)
    gaps = np.log(np.maximum(np.diff(first), 1e-2))
    theta = np.concatenate([np.zeros(width), first[:1], gaps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    values = np.log1p(values.astype(float))
    index = np.arange(n)
    for step in range(1, rounds + 1):
        w, t = theta[:width], theta[width] + np.concatenate([[0.0], np.cumsum(np.exp(theta[width + 1 :]))])
        score = np.bincount(rows, values * w[columns], n)
        over = 1 / (1 + np.exp(np.clip(t[None, :] - score[:, None], -40, 40)))  # P(grade > k)
        full = np.concatenate([np.ones((n, 1)), over, np.zeros((n, 1))], 1)
        chance = np.maximum(full[index, grades] - full[index, grades + 1], 1e-12)
        slope = over * (1 - over)
        edge = np.concatenate([np.zeros((n, 1)), slope, np.zeros((n, 1))], 1)
        by_score = -(edge[index, grades] - edge[index, grades + 1]) / chance / n
        by_t = np.zeros((n, top + 2))
        by_t[index, grades] += edge[index, grades] / chance / n
        by_t[index, grades + 1] -= edge[index, grades + 1] / chance / n
        by_t = by_t[:, 1 : top + 1].sum(0)
        tail = np.cumsum(by_t[::-1])[::-1]
        grad = np.concatenate(
            [np.bincount(columns, values * by_score[rows], width) + ridge * w, tail[:1], tail[1:] * np.exp(theta[width + 1 :])]
        )
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:width], theta[width] + np.concatenate([[0.0], np.cumsum(np.exp(theta[width + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = 4096, heavy: int = 4) -> Model:
    """Learn from labelled documents. The labels say toxic or not; the upper grade is the toxic text with
    ``heavy`` or more words that carry a strong toxic feature. What reaches the driver is bounded by
    ``sample`` and ``features``. Without a toxic label the model gives every text severity 0."""
    drawn = stored(labelled(docs, labels, sample), "toxic-sample")
    found = [(bytes(r["feature"]), r["odds"]) for r in selected(drawn, features).collect()]
    index = {f: i for i, (f, _) in enumerate(found)}
    strong = {i for i, (_, odds) in enumerate(found) if odds > 4}
    local = graded(drawn, index, strong, heavy).toPandas()
    sizes = local["features"].map(len).to_numpy(int) if len(local) else np.zeros(0, int)
    rows = np.repeat(np.arange(len(local)), sizes)
    flat = [np.concatenate(local[c].to_list()).astype(int) if len(rows) else np.zeros(0, int) for c in ("features", "uses")]
    weights, thresholds = fit(rows, flat[0], flat[1], local["grade"].to_numpy(int), len(found))
    return Model({f: float(weights[i]) for f, i in index.items() if weights[i]}, [float(t) for t in thresholds])


def severity(model: Model):
    """A column function: text -> struct(severity, grade, rejected)."""
    names = list(model.weights)
    index = {f: i for i, f in enumerate(names)}
    weights = np.array([model.weights[f] for f in names])
    thresholds = np.array(model.thresholds)

    @F.pandas_udf("severity double, grade int, rejected boolean")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = _Uses(index)
        for texts in parts:
            etas = np.zeros(len(texts))
            for i, text in enumerate(texts):
                uses = memo.counts(text) if text else None
                if uses:
                    at = np.fromiter(uses.keys(), int, len(uses))
                    etas[i] = weights[at] @ np.log1p(np.fromiter(uses.values(), float, len(uses)))
            over = 1 / (1 + np.exp(np.clip(thresholds[None, :] - etas[:, None], -700, 700)))
            chances = -np.diff(np.concatenate([np.ones((len(etas), 1)), over, np.zeros((len(etas), 1))], 1), axis=1)
            rejected = over[:, 0] > 0.5 if len(thresholds) else np.zeros(len(etas), bool)
            yield pd.DataFrame({"severity": over.sum(1), "grade": chances.argmax(1).astype("int32"), "rejected": rejected})

    return score


def graded_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade), grade (likeliest), rejected (more likely toxic than not).

    One row per row; a null or empty text has no feature and gets the base severity. Null ids and
    repeated rows are kept as they are; an empty table gives no row.
    """
    scored = documents_of(docs).select("doc_id", severity(model)("text").alias("s"))
    return scored.select("doc_id", "s.severity", "s.grade", "s.rejected")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rejected rows, all columns as they were."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.where(~severity(model)(text)["rejected"])
