"""Small helpers that several operators share: columns by name, durable tables, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import checkpointed, durable_path, durable_root

__all__ = [
    "WORD",
    "checkpointed",
    "documents_of",
    "durable_root",
    "lower_ascii",
    "mix64",
    "slices_of",
    "stored",
    "table",
    "tasks",
    "words_in",
]

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def documents_of(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator needs, with a null text read as an empty one.

    Extra columns of the input, whatever their names, go no further than this.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, *more)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_in(text: Column) -> Column:
    """Number of words; white space is the six ASCII characters only."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    Cuts the lineage: later stages, and tasks that run again, read files every executor can see.
    """
    path = durable_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """How many pieces a shuffle should have at least."""
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions", "200")),
        spark.sparkContext.defaultParallelism,
    )


def slices_of(
    batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = 4_000_000
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one holds about ``chars`` bytes of text (at least one row)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + chars, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A keyed hash's finisher on unsigned 64-bit arrays (the split-mix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
