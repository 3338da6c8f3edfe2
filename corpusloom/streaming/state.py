"""Tables that streams keep on storage, so that a stream may stop at any moment and go on later.

A stream has one place for its checkpoint, given by the caller. Whatever it writes is tied to a micro-batch of that
checkpoint: a micro-batch that runs again after a crash replaces its own rows and sees the tables as they were before it.
One stream writes a table at a time; any number may read it.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.schemas import struct_of

LOG = "version bigint, stream string, batch bigint, base boolean, part string"


def stream_key(checkpoint: str) -> str:
    """A short name of the stream whose checkpoint lies at ``checkpoint``."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


class BatchTable:
    """Rows that a stream adds, a folder for each micro-batch; running one again replaces its folder."""

    def __init__(self, spark: SparkSession, root: str, schema: str, checkpoint: str) -> None:
        self.root, self.schema, self.stream = root.rstrip("/"), schema, stream_key(checkpoint)
        spark.createDataFrame([], struct_of(schema)).write.mode("ignore").parquet(f"{self.root}/stream=none/batch=-1")

    def write(self, rows: DataFrame, batch: int) -> None:
        columns = struct_of(self.schema).names
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.root}/stream={self.stream}/batch={batch}")

    def read(self, spark: SparkSession) -> DataFrame:
        return self._all(spark).drop("stream", "batch")

    def before(self, spark: SparkSession, batch: int) -> DataFrame:
        """What other streams wrote, and this one in earlier micro-batches (whole folders are left out)."""
        rows = self._all(spark).where((F.col("stream") != self.stream) | (F.col("batch") < batch))
        return rows.drop("stream", "batch")

    def _all(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{self.schema}, stream string, batch bigint").parquet(self.root)


class StateTable:
    """The latest row of each key, by ``order``; the stream itself holds no state.

    A micro-batch writes one part with its own latest rows; every ``fold``-th part is a base with all rows, so a
    micro-batch costs what it changes and a reader meets at most ``fold`` parts. A part counts once the log names it:
    the log is the pointer, it is written last, and no part that it names is ever overwritten.
    ``expired`` (SQL over the columns) names rows that a base leaves out, such as jobs ended long ago; None keeps all.
    A later row of such a key starts anew. Rows of equal order and key should be equal; of others the larger one stays.
    """

    def __init__(
        self, spark: SparkSession, root: str, schema: str, keys: list[str], order: list[str], checkpoint: str,
        fold: int = 16, expired: str | None = None,
    ) -> None:
        self.root, self.schema, self.keys, self.order = root.rstrip("/"), schema, keys, order
        self.stream, self.fold, self.expired = stream_key(checkpoint), fold, expired
        spark.createDataFrame([], struct_of(LOG)).write.mode("ignore").parquet(f"{self.root}/log")

    def latest(self, rows: DataFrame) -> DataFrame:
        """One row per key: an aggregate that is combined before its shuffle, so a hot key costs nothing."""
        columns = struct_of(self.schema).names
        ranked = [*self.order, *[c for c in columns if c not in self.keys and c not in self.order]]
        best = rows.groupBy(*self.keys).agg(F.max(F.struct(*ranked)).alias("_row"))
        return best.select(*self.keys, *[F.col(f"_row.{c}").alias(c) for c in ranked]).select(*columns)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._merged(spark, self._parts(spark))

    def before(self, spark: SparkSession, batch: int) -> DataFrame:
        """The table as it was before micro-batch ``batch`` of this stream."""
        return self._merged(spark, self._parts(spark, batch))

    def commit(self, changes: DataFrame, batch: int) -> None:
        """Merge the rows of a micro-batch; doing it twice gives the same table."""
        spark = changes.sparkSession
        parts = self._parts(spark, batch)
        version = 1 + max((p["version"] for p in parts), default=0)
        base = version % self.fold == 0
        rows = self.latest(changes)
        if base:
            rows = self.latest(rows.unionByName(self._merged(spark, parts)))
            if self.expired:
                rows = rows.where(~F.coalesce(F.expr(self.expired), F.lit(False)))
        part = f"part-{version}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.root}/{part}")
        entry = spark.createDataFrame([(version, self.stream, batch, base, part)], struct_of(LOG))
        entry.coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def _parts(self, spark: SparkSession, batch: int | None = None) -> list:
        """The newest base and the parts after it: at most ``fold`` rows of the log come to the driver.

        A version that was committed twice (the stream stopped before its own checkpoint did) counts once.
        """
        log = spark.read.schema(LOG).parquet(f"{self.root}/log")
        if batch is not None:
            log = log.where((F.col("stream") != self.stream) | (F.col("batch") < batch))
        start = log.agg(F.coalesce(F.max(F.expr("IF(base, version, NULL)")), F.lit(0)).alias("_start"))
        named = log.groupBy("version").agg(F.max("part").alias("part"))
        return named.join(F.broadcast(start), F.col("version") >= F.col("_start")).select("version", "part").collect()

    def _merged(self, spark: SparkSession, parts: list) -> DataFrame:
        if not parts:
            return spark.createDataFrame([], struct_of(self.schema))
        paths = [f"{self.root}/{p['part']}" for p in parts]
        return self.latest(spark.read.schema(self.schema).parquet(*paths))
