"""Training order: every token sequence gets a global slot by a keyed permutation, and shards hold them in order.

Documents become sequences of ``length`` ids (the last one of a document is filled up), and each sequence a record
of fixed size: doc_id (8 bytes), part (4), number of ids (4), then the ids. The records are numbered 0 to n - 1, and a
Feistel network with keyed rounds permutes the numbers: it is a bijection of a power of four, and cycle-walking
(applying it until the result is below n) makes it one of 0 to n - 1. So slots need no sort and no table, and anyone
with the key can tell where a record went. Range partitions of slots are written as shards of
``records`` records: slot s is in shard ``s // records`` at byte ``(s % records) * stride``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bytepair import RANKS, public_path, vocabulary
from corpusloom.llm.common import documents_of, mix64, slices_of, stored, tasks

HEAD = np.dtype([("doc_id", "<i8"), ("part", "<i4"), ("n", "<i4")])
NO_ID = -(1 << 63)
ROUNDS = 6


@dataclass(frozen=True)
class Layout:
    """Fixed sizes of a materialisation."""

    length: int = 512
    records: int = 1024
    wide: bool = False

    @property
    def ids(self) -> np.dtype:
        return np.dtype("<u4" if self.wide else "<u2")

    @property
    def stride(self) -> int:
        return HEAD.itemsize + self.length * self.ids.itemsize


def slots(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The permutation of 0 .. n - 1 with this key, at ``numbers``."""
    half = 1
    while 1 << (2 * half) < n:
        half += 1
    mask = np.uint64((1 << half) - 1)
    seeds = mix64(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(key & ((1 << 64) - 1)) * np.uint64(ROUNDS))
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> np.uint64(half), out[walking] & mask
        for seed in seeds:
            left, right = right, left ^ (mix64(right + seed) & mask)
        out[walking] = (left << np.uint64(half)) | right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def record(doc_id: int | None, part: int, ids: np.ndarray, layout: Layout, fill: int) -> bytes:
    head = np.array([(NO_ID if doc_id is None else doc_id, part, len(ids))], HEAD).tobytes()
    padded = np.full(layout.length, fill, layout.ids)
    padded[: len(ids)] = ids
    return head + padded.tobytes()


def sequences(docs: DataFrame, layout: Layout, path: str) -> DataFrame:
    """(part_id, local, record): the records of all documents; an empty text has one of its end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        end = words.size
        for batch in slices_of(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*words.plain_ids(text), end], np.int64)
                out += [record(doc_id, i, ids[a : a + layout.length], layout, end) for i, a in enumerate(range(0, len(ids), layout.length))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    made = documents_of(docs).mapInArrow(run, "record binary")
    return made.withColumn("place", F.monotonically_increasing_id())


def ordered(docs: DataFrame, key: int = 17, layout: Layout = Layout(), path: str | None = None) -> DataFrame:
    """One row per shard: shard, first_slot, records, stride, crc, data (``records`` records of ``stride`` bytes).

    A null or empty text gives one record that holds the end id alone; a null doc_id is written as ``NO_ID``; repeated
    rows give a record each. An empty table gives no shard.
    """
    path = path or public_path(RANKS)
    held = stored(sequences(docs, layout, path), "sequences")
    # monotonically_increasing_id: the writing task in the upper bits, the row in the lower 33.
    task = F.shiftright("place", 33)
    counts = {r["t"]: r["n"] for r in held.groupBy(task.alias("t")).agg(F.count("*").alias("n")).collect()}
    firsts = dict(zip(sorted(counts), accumulate([0, *(counts[t] for t in sorted(counts))]), strict=False))
    n = sum(counts.values())

    @F.pandas_udf("long")
    def slot(place: pd.Series) -> pd.Series:
        at = place.to_numpy()
        base = pd.Series(at >> 33).map(firsts).to_numpy(np.int64) if len(at) else at
        return pd.Series(slots(base + (at & ((1 << 33) - 1)), n, key))

    placed = held.select(slot("place").alias("slot"), "record").withColumn("shard", F.floor(F.col("slot") / layout.records))
    spread = placed.repartitionByRange(tasks(docs.sparkSession), "shard").sortWithinPartitions("slot")
    return spread.mapInArrow(_written(layout), "shard long, first_slot long, records long, stride long, crc long, data binary")


def _written(layout: Layout):
    """Sorted records of whole shards to one row per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, first = None, [], 0
        for batch in batches:
            numbers = batch.column("shard").to_numpy(False)
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if numbers[a] != shard:
                    if parts:
                        yield row(shard, first, parts)
                    shard, parts, first = int(numbers[a]), [], batch.column("slot")[a].as_py()
                parts += batch.column("record").slice(a, b - a).to_pylist()
        if parts:
            yield row(shard, first, parts)

    def row(shard: int, first: int, parts: list[bytes]) -> pa.RecordBatch:
        import zlib

        data = b"".join(parts)
        values = [shard, first, len(parts), layout.stride, zlib.crc32(data)]
        columns = [pa.array([v], pa.int64()) for v in values] + [pa.array([data], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["shard", "first_slot", "records", "stride", "crc", "data"])

    return run


def write_files(shards: DataFrame, folder: str) -> DataFrame:
    """Write each shard as a raw file of its own; returns (shard, path, first_slot, records, crc).

    ``folder`` is a URI of a store that all executors share. A file is written under another name and then moved, so
    a task that runs again replaces it by the same bytes and a reader never sees half a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            paths = []
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data"), strict=True):
                name = f"{base}/shard-{shard:09d}.bin"
                with store.open_output_stream(f"{name}.part") as out:
                    out.write(data.as_buffer())
                store.move(f"{name}.part", name)
                paths.append(name)
            keep = [batch.column(c) for c in ("first_slot", "records", "crc")]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(paths), *keep], ["shard", "path", "first_slot", "records", "crc"])

    return shards.mapInArrow(run, "shard long, path string, first_slot long, records long, crc long")


def read(data: bytes, layout: Layout, start: int = 0, count: int | None = None) -> list[tuple[int | None, int, np.ndarray]]:
    """(doc_id, part, ids) of consecutive records of one shard from record ``start``: a resumed read is a seek."""
    stop = len(data) // layout.stride if count is None else min(len(data) // layout.stride, start + count)
    out = []
    for i in range(start, stop):
        at = i * layout.stride
        head = np.frombuffer(data, HEAD, 1, at)[0]
        ids = np.frombuffer(data, layout.ids, int(head["n"]), at + HEAD.itemsize)
        out.append((None if head["doc_id"] == NO_ID else int(head["doc_id"]), int(head["part"]), ids))
    return out
