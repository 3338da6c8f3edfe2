"""Reading the given Parquet tables with their explicit schemas."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.schemas import TABLES, struct_of


# Tables whose rows are costly to process (long texts, many path rules), with a key to spread by.
SPREAD_BY = {"documents": "doc_id", "customer": "c_custkey"}


class Tables:
    """Lazy access to the tables of one folder: ``Tables(spark, dir).orders``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root

    def path(self, name: str) -> str:
        return os.path.join(self.root, f"{name}.parquet")

    def __getattr__(self, name: str) -> Any:
        if name not in TABLES:
            raise AttributeError(name)
        table = self.spark.read.schema(struct_of(TABLES[name])).parquet(self.path(name))
        return self._spread(table, SPREAD_BY[name]) if name in SPREAD_BY else table

    def _spread(self, table: DataFrame, key: str) -> DataFrame:
        """Use every core for a table that arrives in fewer splits than there are cores.

        A large table already has more splits than that and is read as it is, without a shuffle.
        """
        cores = self.spark.sparkContext.defaultParallelism
        if table.rdd.getNumPartitions() * 2 > cores:
            return table
        return table.repartition(cores, key)

    def event_times(self) -> DataFrame:
        """``events`` with ``ts`` as an instant (watermarks and epoch functions need one)."""
        return self.events.withColumn("ts", F.col("ts").cast("timestamp"))
