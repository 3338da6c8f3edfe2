"""Streaming plans over the given tables, run until everything available is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import embed, ops
from corpusloom.plans.operations import _QUOTA
from corpusloom.plans.registry import query
from corpusloom.schemas import TABLES, struct_of
from corpusloom.session import durable_path
from corpusloom.streaming import jobs as op
from corpusloom.streaming.state import BatchTable

c = F.col


def event_stream(t, name="events"):
    """A given table, one file or a folder of files, as a stream of its files (a plain path must be a folder, a pattern may be both)."""
    return t.spark.readStream.schema(struct_of(TABLES[name])).parquet(t.path(name)[:-1] + "[t]")


def step_events(events):
    return events.selectExpr(
        "event_id", "CAST(ts AS TIMESTAMP) AS ts", "CAST(user_id % 30 AS STRING) AS job_id", "CASE WHEN event_type = 'purchase' THEN 'job' ELSE 'step' END AS kind",
        "event_type AS step", "CASE WHEN event_type = 'purchase' AND event_id % 50 < 5 THEN 'done' ELSE 'running' END AS status", "value / 100 AS fraction", "props AS message",
    )


_EV = """ev AS (SELECT event_id, ts, CAST(user_id % 30 AS VARCHAR) AS job_id, event_type AS step, value / 100 AS fraction, props AS message,
 event_type = 'purchase' AND event_id % 50 < 5 AS ended FROM events)"""


def _job_tables(t):
    """The tables of the job stream after everything that has landed."""
    place = durable_path(t.spark, "job-state")
    steps, ends = (op.step_table(t.spark, f"{place}/steps", f"{place}/checkpoint"), op.job_table(t.spark, f"{place}/jobs", f"{place}/checkpoint"))
    op.run_available(op.job_states(step_events(event_stream(t)), steps, ends), f"{place}/checkpoint")
    return steps.read(t.spark), ends.read(t.spark)


@query(
    "l1_job_state",
    f"""WITH {_EV} SELECT job_id, step, 'running' AS status, round(arg_max(fraction, (ts, event_id)), 6) AS fraction, arg_max(message, (ts, event_id)) AS message,
 epoch_us(max(ts)) AS updated_us, arg_max(event_id, (ts, event_id)) AS event_id FROM ev WHERE step <> 'purchase' GROUP BY 1, 2""",
)
def l1(t):
    """Snapshot of every step, kept current by the stream: only changed steps are written."""
    steps, _ = _job_tables(t)
    return steps.select("job_id", "step", "status", F.round("fraction", 6).alias("fraction"), "message", F.unix_micros("updated_at").alias("updated_us"), "event_id")


@query(
    "l1_ended_jobs",
    f"WITH {_EV} SELECT job_id, 'done' AS status, epoch_us(max(ts)) AS ended_us, arg_max(event_id, (ts, event_id)) AS event_id FROM ev WHERE ended GROUP BY 1",
)
def l1_ended(t):
    _, ends = _job_tables(t)
    return ends.select("job_id", "status", F.unix_micros("ended_at").alias("ended_us"), "event_id")


def _collected(t, df, schema, name):
    """Run a stream into a table and read it back."""
    place = durable_path(t.spark, name)
    op.run_available(df.writeStream.format("parquet").option("path", f"{place}/rows"), f"{place}/checkpoint")
    return t.spark.read.schema(schema).parquet(f"{place}/rows")


@query("l2_quota_stream", f"WITH RECURSIVE {_QUOTA} SELECT user_id, event_id, accepted FROM w")
def l2_stream(t):
    requests = event_stream(t).selectExpr("user_id % 40 AS user_id", "CAST(ts AS TIMESTAMP) AS ts", "unix_micros(CAST(ts AS TIMESTAMP)) AS ts_us", "event_id")
    return _collected(t, op.quota_stream(requests, 3, 21_600), "user_id bigint, event_id bigint, accepted boolean", "quota")


@query(
    "l3_silent_jobs_stream",
    """SELECT user_id AS job_id, epoch_us(max(ts)) AS last_us, 'failed' AS status FROM events GROUP BY 1
 HAVING NOT bool_or(event_id % 97 = 0) AND max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events)""",
)
def l3_stream(t):
    beats = event_stream(t).selectExpr("user_id AS job_id", "CAST(ts AS TIMESTAMP) AS ts", "CASE WHEN event_id % 97 = 0 THEN 'done' ELSE 'running' END AS status")
    return _collected(t, op.silent_jobs(beats, 30), "job_id bigint, last_us bigint, status string", "silent")


@query(
    "l6_health_stream",
    """SELECT server, event_id, online FROM (SELECT user_id % 3 AS server, event_id, event_type <> 'error' AS online, lag(event_type <> 'error') OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS p FROM events) WHERE p <> online""",
)
def l6_stream(t):
    probes = event_stream(t).selectExpr("user_id % 3 AS server", "CAST(ts AS TIMESTAMP) AS ts", "event_id", "event_type <> 'error' AS online")
    place = durable_path(t.spark, "health")
    last = op.probe_table(t.spark, f"{place}/last", f"{place}/checkpoint")
    changes = BatchTable(t.spark, f"{place}/changes", "server bigint, event_id bigint, online boolean", f"{place}/checkpoint")
    op.run_available(op.health_changes(probes, last, changes), f"{place}/checkpoint")
    return changes.read(t.spark)


@query(
    "l5_new_snapshots",
    "SELECT DISTINCT 'github.com/o/r' || user_id AS url_key, event_type AS commit_sha FROM events",
)
def l5(t):
    landed = event_stream(t).selectExpr("CAST(ts AS TIMESTAMP) AS ts", "concat('github.com/o/r', user_id) AS url_key", "event_type AS commit_sha")
    schema = "ts timestamp, url_key string, commit_sha string"
    return _collected(t, op.new_snapshots(landed, "60 days"), schema, "snapshots").select("url_key", "commit_sha")


@query(
    "l5_incremental_embedding",
    "SELECT sha256(encode('hash-16' || chr(0) || 'File: ' || lang || '/' || chr(10) || text)) AS embed_hash, 16 AS dims FROM documents GROUP BY 1",
)
def l5_embedding(t):
    place = durable_path(t.spark, "vectors")
    vectors = BatchTable(t.spark, f"{place}/rows", "embed_hash string, embedding array<double>", f"{place}/checkpoint")
    rows = event_stream(t, "documents").select(
        F.concat("lang", F.lit("/")).alias("path"), F.lit(None).cast("string").alias("symbol"), c("text").alias("content")
    )
    chunks = embed.with_embed_hash(rows, "hash-16").select("embed_hash", "text")
    stream = op.ingest_stream(chunks, vectors, lambda todo: embed.hashing_embeddings(todo, "embed_hash", 16))
    op.run_available(stream, f"{place}/checkpoint")
    return vectors.read(t.spark).select("embed_hash", F.size("embedding").alias("dims"))


@query("l3_sweep_twice", "SELECT o_orderkey AS job_id FROM orders WHERE o_orderkey < 0")
def sweep_twice(t):
    """A second sweep changes nothing: rows swept by the second run (none)."""
    from corpusloom.plans.operations import _NOW, jobs, repos

    now = F.expr(_NOW)
    once = ops.swept_jobs(jobs(t), repos(t), now).drop("swept", "silent_minutes", "abandon_analysis")
    return ops.swept_jobs(once, repos(t), now).where("swept").select("job_id")
