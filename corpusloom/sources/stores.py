"""The engine's stored tables: content-addressed blobs, per-repo snapshots, the agent log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import text as X
from corpusloom.scale import skewed_join


# --- blobs ------------------------------------------------------------------------------------


def blobs_of(files: DataFrame) -> DataFrame:
    """One row per distinct content (``sha, content``) of files with a ``text`` column."""
    shas = files.select(X.blob_sha(F.col("text")).alias("sha"), F.col("text").alias("content"))
    return shas.dropDuplicates(["sha"])


def new_blobs(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Blobs not stored yet; ``stored`` needs only ``sha``."""
    return incoming.join(stored.select("sha"), "sha", "left_anti")


def unstored_blobs(files: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per distinct content of ``files`` that ``stored`` (needs only ``sha``) lacks; a null text has none.

    Hashes meet first: neither texts nor stored contents take part. Where few are new, adaptive execution
    broadcasts them by their measured size, and only their texts move.
    """
    rows = files.select(X.blob_sha(F.col("text")).alias("sha"), F.col("text").alias("content")).where("sha IS NOT NULL")
    new = rows.select("sha").distinct().join(stored.select("sha"), "sha", "left_anti")
    return rows.join(new, "sha", "left_semi").dropDuplicates(["sha"])


def append_blobs(incoming: DataFrame, stored: DataFrame, path: str) -> None:
    """Insert if absent: stored contents are never rewritten."""
    new_blobs(incoming, stored).write.mode("append").parquet(path)


BLOB_STORE = "sha string, content string, bucket string"


def open_blobs(spark: SparkSession, path: str) -> DataFrame:
    """A store that ``store_blobs`` keeps. A filter on ``bucket`` (the first digits of ``sha``) prunes folders."""
    spark.createDataFrame([], BLOB_STORE).write.mode("ignore").partitionBy("bucket").parquet(path)
    return spark.read.schema(BLOB_STORE).parquet(path)


def store_blobs(files: DataFrame, path: str, digits: int = 2) -> None:
    """Add the contents of ``files`` to the store at ``path``, each once.

    Buckets are the first hexadecimal ``digits`` of the hash, so they are even. Rows are rebalanced by bucket before
    they are written: an increment adds about a file to each bucket that it touches, and adaptive execution splits
    buckets too large for a task. One job writes a store at a time; one that failed may simply run again.
    """
    stored = open_blobs(files.sparkSession, path)
    new = unstored_blobs(files, stored).withColumn("bucket", F.left("sha", F.lit(digits)))
    new.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(path)


# --- snapshots --------------------------------------------------------------------------------


def replace_snapshot(rows: DataFrame, path: str) -> None:
    """Overwrite only the repositories present in ``rows``; others keep their files.

    Each repository is a partition of the table and is committed as a whole; a retried job writes
    the same result again. Rows are rebalanced by repository first: a small one is one file, a large one as many as
    its size asks for, whatever the number of tasks.
    """
    (
        rows.hint("rebalance", "repo_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("repo_id")
        .parquet(path)
    )


def list_files(files: DataFrame, repo_id: str | None = None) -> DataFrame:
    """File listing sorted by path; with ``repo_id`` the scan reads one partition."""
    picked = files if repo_id is None else files.where(F.col("repo_id") == repo_id)
    return picked.select("repo_id", "path", "language", "size", "line_count", "blob_sha").orderBy(
        "repo_id", "path"
    )


def look_up(requests: DataFrame, files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Files and contents for a set of ``repo_id, path`` keys; unknown keys give no row."""
    found = files.join(requests.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
    return with_content(found, blobs)


def with_content(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Attach ``content`` by ``blob_sha``. Popular contents (licences, copies) are spread out."""
    return skewed_join(
        files, blobs.select(F.col("sha").alias("blob_sha"), "content"), ["blob_sha"]
    )


# --- reading line ranges ----------------------------------------------------------------------


def read_ranges(
    requests: DataFrame, files: DataFrame, blobs: DataFrame, max_lines: int | None = None
) -> DataFrame:
    """Numbered line ranges for ``request_id, repo_id, path, start_line, end_line``.

    At most ``max_lines`` lines per request (all without it; ``more`` tells of a cut); ``status`` is ok, not_found, out_of_range or bad_range.
    """
    cited = requests.join(files.select("repo_id", "path", "blob_sha"), ["repo_id", "path"], "left")
    known = with_content(cited.where("blob_sha IS NOT NULL"), blobs)
    missing = cited.where("blob_sha IS NULL").withColumn("content", F.lit(None).cast("string"))
    parts = X.lines(F.col("content"))
    total = F.greatest(F.size(parts), F.lit(1))
    start = F.coalesce("start_line", F.lit(1))
    wanted = F.least(F.coalesce(F.col("end_line"), total), total)
    end = wanted if max_lines is None else F.least(wanted, start + max_lines - 1)
    status = (
        F.when(F.col("content").isNull(), "not_found")
        .when(start > total, "out_of_range")
        .when(wanted < start, "bad_range")
        .otherwise("ok")
    )
    body = F.when(
        status == "ok", X.numbered(F.slice(parts, start, F.greatest(end - start + 1, F.lit(0))), start)
    )
    return known.unionByName(missing).select(
        "request_id",
        "repo_id",
        "path",
        status.alias("status"),
        F.when(status == "ok", start).alias("start_line"),
        F.when(status == "ok", end).alias("end_line"),
        F.when(F.col("content").isNotNull(), total).alias("total_lines"),
        F.coalesce(wanted > end, F.lit(False)).alias("more"),
        body.alias("body"),
    )


def file_content(requests: DataFrame, files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Plain content of a line range; the end is moved into the file instead of refused."""
    found = requests.join(
        files.select("repo_id", "path", "language", "size", "blob_sha"), ["repo_id", "path"]
    )
    parts = X.lines(F.col("content"))
    total = F.greatest(F.size(parts), F.lit(1))
    start = F.coalesce("start_line", F.lit(1))
    end = F.least(F.greatest(F.coalesce(F.col("end_line"), total), start), total)
    whole = (start == 1) & (end == total)
    cut = F.array_join(F.slice(parts, start, F.greatest(end - start + 1, F.lit(0))), "\n")
    return with_content(found, blobs).where(start <= total).select(
        "request_id",
        "repo_id",
        "path",
        "language",
        "size",
        total.alias("lines"),
        start.alias("start_line"),
        end.alias("end_line"),
        F.when(whole, F.col("content")).otherwise(cut).alias("content"),
    )


# --- agent log --------------------------------------------------------------------------------


def append_log(calls: DataFrame, path: str) -> None:
    """Append call rows, one partition per day so that old days can be dropped."""
    (
        calls.withColumn("arguments", X.scrubbed(F.col("arguments")))
        .withColumn("day", F.to_date("ts"))
        .write.mode("append")
        .partitionBy("day")
        .parquet(path)
    )


def retained(log: DataFrame, now: Column, days: int = fixed.LOG_RETENTION_DAYS) -> DataFrame:
    """Rows younger than the retention time; whole older days of a stored log are not even read."""
    since = now - F.expr(f"INTERVAL {days} DAYS")
    young = log.where(F.col("day") >= F.to_date(since)) if "day" in log.columns else log
    return young.where(F.col("ts") > since)


# --- citations in stored payloads -------------------------------------------------------------


def cited_paths(payloads: DataFrame) -> DataFrame:
    """Every file named under ``path`` or ``paths`` in JSON ``payload`` texts (directories left out)."""
    string = r'"((?:[^"\\]|\\.)*)"'
    single = F.regexp_extract_all("payload", F.lit(r'(?<!\\)"path"\s*:\s*' + string), 1)
    lists = F.regexp_extract_all("payload", F.lit(r'(?<!\\)"paths"\s*:\s*\[([^\]]*)\]'), 1)
    listed = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(string), 1)))
    rows = payloads.select("repo_id", F.explode(F.concat(single, listed)).alias("raw"))
    path = F.get_json_object(F.concat(F.lit('{"p":"'), "raw", F.lit('"}')), "$.p")
    return rows.select("repo_id", path.alias("path")).where("path NOT LIKE '%/'").distinct()
