"""Structured Streaming twins of the job, quota, health and ingestion operators.

Every stream ends in tables that equal the batch result over the same rows; the tests compare them. The caller names the
places of checkpoints and tables, so a stream may be stopped at any moment and started again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.embed import to_embed
from corpusloom.operators.ops import status_changes
from corpusloom.streaming.state import BatchTable, StateTable


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything that has landed, then stop. Started again with the same ``checkpoint`` it goes on there."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def in_order(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch, sorted. They may come as many Arrow batches in any order, so they are
    gathered first; the source's limit for a micro-batch bounds them."""
    return pd.concat(list(frames)).sort_values(by)


# --- job state (snapshot plus events) -----------------------------------------------------------

STEPS = "job_id string, step string, status string, fraction double, message string, updated_at timestamp, event_id bigint"
JOBS = "job_id string, status string, ended_at timestamp, event_id bigint"


def step_rows(events: DataFrame) -> DataFrame:
    """Rows of the snapshot from step events; works on a stream and on a table."""
    return events.where("kind = 'step'").select(
        "job_id", "step", "status", "fraction", "message", F.col("ts").alias("updated_at"), "event_id"
    )


def ended_rows(events: DataFrame) -> DataFrame:
    """Ends of jobs: their stream of events is over."""
    done = events.where("kind = 'job' AND status IN ('done', 'failed')")
    return done.select("job_id", "status", F.col("ts").alias("ended_at"), "event_id")


def step_table(spark: SparkSession, root: str, checkpoint: str, expired: str | None = None) -> StateTable:
    return StateTable(spark, root, STEPS, ["job_id", "step"], ["updated_at", "event_id"], checkpoint, expired=expired)


def job_table(spark: SparkSession, root: str, checkpoint: str, expired: str | None = None) -> StateTable:
    return StateTable(spark, root, JOBS, ["job_id"], ["ended_at", "event_id"], checkpoint, expired=expired)


def job_states(events: DataFrame, steps: StateTable, jobs: StateTable) -> DataStreamWriter:
    """Keeps two tables: the latest state of each step and the end of each job, both by (time, event_id).

    The stream itself has no state. Events may come late or twice: the newest in event time wins whenever it comes.
    """

    def write(batch: DataFrame, number: int) -> None:
        steps.commit(step_rows(batch), number)
        jobs.commit(ended_rows(batch), number)

    return events.writeStream.foreachBatch(write)


# --- quota ------------------------------------------------------------------------------------


def quota_stream(requests: DataFrame, limit: int, seconds: int, user_type: str = "bigint") -> DataFrame:
    """Accept or reject each request (``user_id, ts, ts_us, event_id``) on arrival.

    The state per user is at most ``limit`` times; it is dropped once the watermark shows the user
    silent for the whole window. Requests of one micro-batch are decided in time order; one that comes in
    a later micro-batch than a younger request is decided against what was accepted until then.
    """
    duration = seconds * 1_000_000

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept, last = list(state.get[0]) if state.exists else [], 0
        frame = in_order(frames, ["ts_us", "event_id"])
        flags = []
        for now in frame["ts_us"]:
            kept = [x for x in kept if x > now - duration]
            flags.append(len(kept) < limit)
            last = int(now)
            if flags[-1]:
                kept.append(last)
        yield pd.DataFrame({"user_id": key[0], "event_id": frame["event_id"].values, "accepted": flags})
        state.update((kept,))
        state.setTimeoutTimestamp(max((last + duration) // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    return (
        requests.withWatermark("ts", "1 minute")
        .groupBy("user_id")
        .applyInPandasWithState(
            decide, f"user_id {user_type}, event_id bigint, accepted boolean", "history array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


# --- silent jobs --------------------------------------------------------------------------------


def silent_jobs(heartbeats: DataFrame, minutes: int) -> DataFrame:
    """Jobs without a sign of life for ``minutes`` of event time: one row when they fall silent.

    ``heartbeats``: ``job_id, ts, status``; a terminal status ends the watch.
    """
    limit = minutes * 60_000_000

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, ended = state.get
            state.remove()
            if not ended:
                yield pd.DataFrame({"job_id": [key[0]], "last_us": [last], "status": ["failed"]})
            return
        # The end is remembered, so later signs of life change nothing, in the same micro-batch or in another.
        last, ended = state.get if state.exists else (0, False)
        for frame in frames:
            last = max(last, int(frame["ts_us"].max()))
            ended = ended or bool(frame["status"].isin(["done", "failed"]).any())
        state.update((last, ended))
        state.setTimeoutTimestamp(max((last + limit) // 1000, state.getCurrentWatermarkMs() + 1))

    return (
        heartbeats.withWatermark("ts", "1 minute")
        .withColumn("ts_us", F.unix_micros("ts"))
        .groupBy("job_id")
        .applyInPandasWithState(watch, "job_id bigint, last_us bigint, status string", "last bigint, ended boolean", "append", GroupStateTimeout.EventTimeTimeout)
    )


# --- health -----------------------------------------------------------------------------------

PROBES = "server bigint, ts timestamp, event_id bigint, online boolean"


def probe_table(spark: SparkSession, root: str, checkpoint: str, expired: str | None = None) -> StateTable:
    return StateTable(spark, root, PROBES, ["server"], ["ts", "event_id"], checkpoint, expired=expired)


def health_changes(probes: DataFrame, last: StateTable, changes: BatchTable) -> DataStreamWriter:
    """Probes (``server, ts, event_id, online``) that differ from the server's last one, added to ``changes``.

    ``last`` keeps one probe per server between micro-batches. Inside a micro-batch rows are cut into ordered slices
    and only the last value of a slice crosses to the next, so a server that sends all probes is no single task.
    Rows of one micro-batch are compared in time order, the first with what ``last`` holds. One that is older
    than that is compared with it too, and doesn't replace it.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = batch.select("server", "ts", "event_id", "online").withColumn("_new", F.lit(True))
        rows = new.unionByName(last.before(batch.sparkSession, number).withColumn("_new", F.lit(False)))
        found = status_changes(rows, ["server"], ["_new", "ts", "event_id"], "online").where("_new")
        changes.write(found, number)
        last.commit(batch, number)

    return probes.writeStream.foreachBatch(write)


# --- incremental ingestion ----------------------------------------------------------------------


def new_snapshots(landed: DataFrame, delay: str = "1 day") -> DataFrame:
    """Landed snapshots, each ``(url_key, commit_sha)`` once; the watermark only bounds the state."""
    return landed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["url_key", "commit_sha"])


def ingest_stream(landed: DataFrame, vectors: BatchTable, embed: Callable[[DataFrame], DataFrame]) -> DataStreamWriter:
    """Chunks (``embed_hash, text``) embedded once per distinct text: stored vectors are looked up by hash, the texts of
    the other hashes are embedded and added to ``vectors``."""

    def write(batch: DataFrame, number: int) -> None:
        vectors.write(embed(to_embed(batch, vectors.before(batch.sparkSession, number))), number)

    return landed.writeStream.foreachBatch(write)
