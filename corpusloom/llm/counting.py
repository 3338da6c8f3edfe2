"""Token counts, with huge documents encoded in overlapping chunks that are spliced where both agree.

A cut may change the tokens near it, so neighbouring chunks share an overlap. Both encodings are known with offsets
in bytes; they are spliced at a boundary that both have and that is proven stable: a place between a character that
isn't white space and one that is. No alternative of the splitting pattern matches across such a place, and no merge
crosses pieces of the pattern, so the tokens before it don't depend on what follows, nor those after it on what
precedes. Where an overlap holds no such place, the document is encoded again with wider chunks and overlaps, until
one chunk holds it whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.bytepair import MERGES_JSON, Vocabulary, public_path, vocabulary
from corpusloom.llm.common import documents_of, slices_of, stored, tasks

CHUNK = 1 << 15
OVERLAP = 512
WIDER = 4
_STABLE = re.compile(r"(?<=\S)(?=[ \t\r\n])")
_PIECES = "key long, at long, last boolean, n long, head array<struct<place:long,n:long>>, tail array<struct<place:long,n:long>>"


def chunks(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str, bool]]:
    """(number, first byte, chunk, is last): consecutive chunks share ``overlap`` characters."""
    start = at = first = 0
    while True:
        piece = text[start : start + size + overlap]
        last = start + size + overlap >= len(text)
        yield at, first, piece, last
        if last:
            return
        first += len(text[start : start + size].encode("utf-8", "replace"))
        start += size
        at += 1


def boundaries(words: Vocabulary, piece: str, first: int, overlap: int) -> tuple[int, list[dict], list[dict]]:
    """Tokens of a chunk, and its stable boundaries (absolute byte, tokens before) in its two overlaps."""
    ids = np.array(words.ids(piece), np.int64)
    ends = np.cumsum(words.bytes[ids]) if len(ids) else ids

    def within(text: str, base: int) -> list[dict]:
        places = [base + len(text[: m.start()].encode("utf-8", "replace")) for m in _STABLE.finditer(text) if m.start()]
        spots = np.searchsorted(ends, places)
        return [{"place": first + p, "n": int(s) + 1} for p, s in zip(places, spots.tolist(), strict=True) if s < len(ends) and ends[s] == p]

    tail = piece[-overlap:]
    return len(ids), within(piece[:overlap], 0), within(tail, len(piece[: len(piece) - len(tail)].encode("utf-8", "replace")))


def _spliced(long: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """(key, n_tokens; null where some overlap has no common stable boundary) for rows (key, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows = [(key, *c) for c in chunks(text, size, overlap)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "at", "first", "text", "last"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        spots = pa.list_(pa.struct([("place", pa.int64()), ("n", pa.int64())]))
        for batch in slices_of(batches):
            found = [boundaries(words, t, f, overlap) for t, f in zip(batch.column("text").to_pylist(), batch.column("first").to_pylist(), strict=True)]
            n, head, tail = zip(*found, strict=True)
            made = [pa.array(n, pa.int64()), pa.array(head, spots), pa.array(tail, spots)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("at"), batch.column("last"), *made], ["key", "at", "last", "n", "head", "tail"])

    pieces = long.select("key", "text").mapInArrow(cut, "key long, at long, first long, text string, last boolean")
    dealt = pieces.repartition(tasks(long.sparkSession), "key", "at")
    coded = dealt.mapInArrow(encode, _PIECES)
    following = F.lead("head").over(Window.partitionBy("key").orderBy("at"))
    common = F.expr("get(filter(tail, t -> exists(next, h -> h.place = t.place)), 0)")
    other = F.expr("get(filter(next, h -> h.place = here.place), 0).n")
    joined = coded.withColumn("next", following).withColumn("here", common)
    part = F.when(F.col("last"), F.col("n")).otherwise(F.col("here.n") - other)
    sums = joined.select("key", part.alias("part")).groupBy("key")
    return sums.agg(F.when(F.count("part") == F.count("*"), F.sum("part")).alias("n_tokens"))


def counted(docs: DataFrame, limit: int = 512, path: str | None = None, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    A null text counts as empty (0 bytes, 0 tokens). Repeated rows give equal rows, a null doc_id is kept, an empty
    table gives no row.
    """
    path = path or public_path(MERGES_JSON)
    rows = documents_of(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in slices_of(batches):
            n = [len(words.ids(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    whole = F.length("text") <= size + overlap
    short = rows.where(whole).select("doc_id", "n_bytes", "text").mapInArrow(encode, "doc_id long, n_bytes long, n_tokens long")
    long = rows.where(~whole)
    facts = long.select("key", "doc_id", "n_bytes")
    left, found = long.dropDuplicates(["key"]), None
    while True:
        round_ = stored(_spliced(left, path, size, overlap), "token-counts")
        good = round_.where("n_tokens IS NOT NULL")
        found = good if found is None else found.union(good)
        failed = round_.where("n_tokens IS NULL").select("key")
        if failed.isEmpty():
            break
        size, overlap = size * WIDER, overlap * WIDER
        left = left.join(failed, "key", "left_semi")
    counts = short.union(facts.join(found, "key").select("doc_id", "n_bytes", "n_tokens"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
