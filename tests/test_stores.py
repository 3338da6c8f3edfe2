"""Stores that grow by increments."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

from corpusloom.sources import stores


def test_blob_store_takes_each_content_once(spark, tmp_path):
    path = str(tmp_path / "blobs")
    files = lambda *texts: spark.createDataFrame([(t,) for t in texts], "text string")
    stores.store_blobs(files(), path)
    assert stores.open_blobs(spark, path).count() == 0
    stores.store_blobs(files("a", "a", "", None, "b" * 100_000), path, digits=1)
    before = {f for f in glob.glob(f"{path}/bucket=*/*.parquet")}
    stores.store_blobs(files("a", "c", "c", None), path, digits=1)
    added = {f for f in glob.glob(f"{path}/bucket=*/*.parquet")} - before
    assert before <= set(glob.glob(f"{path}/bucket=*/*.parquet")) and len(added) == 1
    stores.store_blobs(files("a", "c"), path, digits=1)
    rows = stores.open_blobs(spark, path).select("content", F.left("sha", F.lit(1)) == F.col("bucket")).collect()
    assert sorted(r[0] for r in rows) == sorted(["", "a", "c", "b" * 100_000]) and all(r[1] for r in rows)


def test_snapshot_files_follow_repositories_not_tasks(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    rows = spark.range(0, 4000, 1, 16).select(F.concat(F.lit("r"), (F.col("id") % 5).cast("string")).alias("repo_id"), "id")
    stores.replace_snapshot(rows, path)
    assert len(glob.glob(f"{path}/repo_id=*/*.parquet")) == 5
    stores.replace_snapshot(rows.where("repo_id = 'r1' AND id < 100"), path)
    counts = {r["repo_id"]: r["count"] for r in spark.read.parquet(path).groupBy("repo_id").count().collect()}
    assert counts == {"r0": 800, "r1": 20, "r2": 800, "r3": 800, "r4": 800}
