"""Landed source trees as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X


def read_tree(spark: SparkSession, root: str, repo_levels: int = 1) -> DataFrame:
    """All files below ``root`` as ``repo_id, path, size, content``.

    The first ``repo_levels`` folders under ``root`` name the repository. Select without
    ``content`` to list files: the scan then reads no bytes.
    """
    scan = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", "length", "content")
    )
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    plain = F.regexp_replace("path", "^[a-z0-9]+:/*", "")
    parts = F.split(F.expr("substring(p, %d)" % (len(base) + 2)), "/")
    name = F.array_join(F.slice(parts, 1, repo_levels), "/") if repo_levels else F.lit("")
    rest = F.slice(parts, F.lit(repo_levels + 1), F.greatest(F.size(parts) - repo_levels, F.lit(0)))
    return scan.withColumn("p", plain).select(
        name.alias("repo_id"),
        F.array_join(rest, "/").alias("path"),
        F.col("length").alias("size"),
        "content",
    )


def read_text(content: Column) -> Column:
    """File bytes as text; undecodable bytes become U+FFFD."""
    return X.decoded(content)
