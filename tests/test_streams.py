"""Streams that are stopped and started again give what a batch over the same rows gives."""

from __future__ import annotations

import random

import pytest
from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import functions as F

from corpusloom.streaming import jobs
from corpusloom.streaming.state import BatchTable, StateTable

START = 1_700_000_000_000_000
EVENTS = "event_id bigint, ts timestamp, job_id string, kind string, step string, status string, fraction double, message string"


def event_rows(n: int) -> list[tuple]:
    draw = random.Random(3)
    rows = []
    for i in range(n):
        kind = "job" if draw.random() < 0.1 else "step"
        status = draw.choice(["done", "failed", "running"])
        text = draw.choice([None, "", "x" * 50])
        rows.append((i, START + draw.randrange(40) * 1_000_000, f"j{draw.randrange(5)}", kind, draw.choice("abc"), status, draw.random(), text))
    return rows


def land(spark, rows: list[tuple], folder: str) -> None:
    """One more file in ``folder``."""
    plain = EVENTS.replace("ts timestamp", "us bigint")
    frame = spark.createDataFrame(rows, plain).withColumn("ts", F.timestamp_micros("us")).drop("us")
    frame.select(*[c.split()[0] for c in EVENTS.split(", ")]).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder: str):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def newest(rows: list[tuple], keep, key) -> dict:
    best: dict = {}
    for row in rows:
        if keep(row) and (key(row) not in best or best[key(row)][1::-1] < row[1::-1]):
            best[key(row)] = row
    return best


class Stopped(Exception):
    pass


class StopsAfter:
    """A table that fails at its ``turn``-th commit, before or after it was made."""

    def __init__(self, table, turn: int, after: bool) -> None:
        self.table, self.turn, self.after = table, turn, after

    def __getattr__(self, name):
        return getattr(self.table, name)

    def commit(self, rows, batch):
        self.turn -= 1
        if self.turn == 0 and not self.after:
            raise Stopped
        self.table.commit(rows, batch)
        if self.turn == 0:
            raise Stopped


def tables(spark, place, fold=3):
    steps, ends = jobs.step_table(spark, f"{place}/steps", f"{place}/state"), jobs.job_table(spark, f"{place}/jobs", f"{place}/state")
    steps.fold = ends.fold = fold
    return steps, ends


@pytest.mark.parametrize("after", [False, True])
def test_job_states_go_on_after_every_stop(spark, tmp_path, after):
    """Events late and twice; files land one by one, the stream stops in every second micro-batch and starts again."""
    rows, place = event_rows(240), str(tmp_path)
    for i in range(0, 240, 40):
        land(spark, rows[i : i + 40] + rows[max(0, i - 5) : i], f"{place}/in")
        steps, ends = tables(spark, place)
        if i % 80:
            with pytest.raises(PySparkException):
                jobs.run_available(jobs.job_states(stream(spark, f"{place}/in"), StopsAfter(steps, 1, after), ends), f"{place}/state")
        jobs.run_available(jobs.job_states(stream(spark, f"{place}/in"), steps, ends), f"{place}/state")
        seen = rows[: i + 40]
        want = newest(seen, lambda r: r[3] == "step", lambda r: (r[2], r[4]))
        got = {(r["job_id"], r["step"]): r for r in steps.read(spark).collect()}
        assert {k: (r["event_id"], r["status"], r["fraction"], r["message"]) for k, r in got.items()} == {
            k: (r[0], r[5], r[6], r[7]) for k, r in want.items()
        }
        done = newest(seen, lambda r: r[3] == "job" and r[5] != "running", lambda r: r[2])
        assert {r["job_id"]: (r["event_id"], r["status"]) for r in ends.read(spark).collect()} == {k: (r[0], r[5]) for k, r in done.items()}
    assert len(steps._parts(spark)) <= 3


def test_state_table_expires_and_keeps_other_streams(spark, tmp_path):
    place = str(tmp_path / "t")
    make = lambda checkpoint: StateTable(spark, place, "k string, n int", ["k"], ["n"], checkpoint, fold=2, expired="n < 3")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, n int")
    first, second = make("/a"), make("/b")
    assert first.read(spark).count() == 0
    first.commit(rows(("x", 1), ("x", 1), ("y", 5), (None, 4)), 0)
    assert {tuple(r) for r in first.read(spark).collect()} == {("x", 1), ("y", 5), (None, 4)}
    second.commit(rows(("z", 7)), 0)  # the second part is a base: x is gone
    assert {tuple(r) for r in second.read(spark).collect()} == {("y", 5), ("z", 7), (None, 4)}
    second.commit(rows(("z", 7)), 0)  # the same micro-batch again
    assert {tuple(r) for r in second.read(spark).collect()} == {("y", 5), ("z", 7), (None, 4)}
    assert {tuple(r) for r in second.before(spark, 0).collect()} == {("x", 1), ("y", 5), (None, 4)}
    second.commit(rows(), 1)
    assert second.read(spark).count() == 3


def test_health_changes_over_restarts(spark, tmp_path):
    """One server sends most probes; each file is a run of its own, one micro-batch runs twice."""
    draw, place = random.Random(5), str(tmp_path)
    probes = [(0 if i % 5 else 1 + i % 3, START + i * 1_000_000, i, draw.random() < 0.5) for i in range(200)]
    schema = "server bigint, us bigint, event_id bigint, online boolean"
    for i in range(0, 200, 50):
        frame = spark.createDataFrame(probes[i : i + 50][::-1], schema).withColumn("ts", F.timestamp_micros("us")).drop("us")
        frame.coalesce(1).write.mode("append").parquet(f"{place}/in")
        landed = spark.readStream.schema("server bigint, event_id bigint, online boolean, ts timestamp").parquet(f"{place}/in")
        last = jobs.probe_table(spark, f"{place}/last", f"{place}/state")
        changes = BatchTable(spark, f"{place}/changes", "server bigint, event_id bigint, online boolean", f"{place}/state")
        if i == 100:
            with pytest.raises(PySparkException):
                jobs.run_available(jobs.health_changes(landed, StopsAfter(last, 1, True), changes), f"{place}/state")
        jobs.run_available(jobs.health_changes(landed, last, changes), f"{place}/state")
    before, want = {}, set()
    for server, _, event_id, online in probes:
        if before.get(server, online) != online:
            want.add((server, event_id, online))
        before[server] = online
    assert sorted(tuple(r) for r in changes.read(spark).collect()) == sorted(want)


def test_ingestion_embeds_a_text_once_over_restarts(spark, tmp_path):
    place, calls = str(tmp_path), []
    for texts in (["a", "b", "a"], ["b", "c"], ["c", "a"]):
        frame = spark.createDataFrame([(t, t * 3) for t in texts], "embed_hash string, text string")
        frame.coalesce(1).write.mode("append").parquet(f"{place}/in")
        landed = spark.readStream.schema("embed_hash string, text string").parquet(f"{place}/in")
        vectors = BatchTable(spark, f"{place}/vectors", "embed_hash string, embedding array<double>", f"{place}/state")

        def embed(todo):
            calls.append({r["text"] for r in todo.collect()})
            return todo.select("embed_hash", F.array(F.length("text").cast("double")).alias("embedding"))

        jobs.run_available(jobs.ingest_stream(landed, vectors, embed), f"{place}/state")
    assert calls == [{"aaa", "bbb"}, {"ccc"}, set()]
    assert sorted(r["embed_hash"] for r in vectors.read(spark).collect()) == ["a", "b", "c"]


def test_quota_stream_resumes_with_its_state(spark, tmp_path):
    """Rows land in four files, the stream is stopped after each; accepted requests are remembered."""
    place = str(tmp_path)
    draw = random.Random(9)
    rows = sorted((START + draw.randrange(3600) * 1_000_000, i, draw.randrange(3)) for i in range(120))
    for part in range(0, 120, 30):
        frame = spark.createDataFrame(rows[part : part + 30], "ts_us bigint, event_id bigint, user_id bigint")
        frame.withColumn("ts", F.timestamp_micros("ts_us")).coalesce(1).write.mode("append").parquet(f"{place}/in")
        landed = spark.readStream.schema("ts_us bigint, event_id bigint, user_id bigint, ts timestamp").parquet(f"{place}/in")
        writer = jobs.quota_stream(landed, 4, 600).writeStream.format("parquet").option("path", f"{place}/quota")
        jobs.run_available(writer, f"{place}/quota-state")
    found = {r["event_id"]: r["accepted"] for r in spark.read.parquet(f"{place}/quota").collect()}
    kept: dict = {}
    for now, event_id, user in rows:
        alive = [x for x in kept.get(user, []) if x > now - 600_000_000]
        assert found[event_id] == (len(alive) < 4)
        kept[user] = alive + [now] * found[event_id]
