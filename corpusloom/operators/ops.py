"""Jobs, usage, quotas and conversations."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import fixed
from corpusloom.functions import text as X
from corpusloom.scale import ordered_slices, previous_value, running_sum, salted_join, skewed_join, top_k
from corpusloom.session import checkpointed

# --- usage ------------------------------------------------------------------------------------

USAGE = ["calls", "prompt_tokens", "completion_tokens", "latency_ms"]


def usage_sums(price_in: float = 0.0, price_out: float = 0.0) -> list[Column]:
    """Aggregates for token usage; missing values count as 0."""
    sums = {k: F.coalesce(F.sum(F.coalesce(F.col(k), F.lit(0))), F.lit(0)) for k in USAGE}
    total = sums["prompt_tokens"] + sums["completion_tokens"]
    price = X.cost(sums["prompt_tokens"], sums["completion_tokens"], price_in, price_out)
    return [*[v.alias(k) for k, v in sums.items()], total.alias("total_tokens"), price.alias("est_cost")]


def sum_usage(rows: DataFrame, keys: list[str], price_in: float = 0.0, price_out: float = 0.0) -> DataFrame:
    return rows.groupBy(*keys).agg(*usage_sums(price_in, price_out))


def chat_usage(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """Per user and repository: questions asked, and usage of the answers."""
    answer = F.col("role") != "user"
    per_thread = messages.groupBy("thread_id").agg(
        F.count_if(~answer).alias("questions"), *[F.coalesce(F.sum(F.when(answer, F.col(k))), F.lit(0)).alias(k) for k in USAGE]
    )
    rows = threads.join(per_thread, "thread_id", "left")
    return rows.groupBy("user_id", "repo_id").agg(F.coalesce(F.sum("questions"), F.lit(0)).alias("questions"), *usage_sums())


def analysis_usage(jobs: DataFrame, analyses: DataFrame) -> DataFrame:
    """Analysis usage of the repositories each user started, with a total row per user (NULL repo)."""
    starters = jobs.where("user_id IS NOT NULL").select("user_id", "repo_id").distinct()
    rows = salted_join(starters, analyses.select("repo_id", *USAGE), ["repo_id"], spread_by=["user_id"])
    return rows.groupingSets([["user_id", "repo_id"], ["user_id"]], "user_id", "repo_id").agg(*usage_sums())


# --- jobs -------------------------------------------------------------------------------------


def job_progress(steps: DataFrame) -> DataFrame:
    """Weighted progress per job in percent from ``job_id, step, fraction`` (steps not seen count 0)."""
    weight = X.lookup(fixed.STEP_WEIGHTS, F.col("step"))
    total = sum(fixed.STEP_WEIGHTS.values())
    done = F.sum(weight * F.least(F.greatest(F.col("fraction"), F.lit(0.0)), F.lit(1.0)))
    value = F.least(F.lit(100), F.floor(F.coalesce(done, F.lit(0.0)) * 100 / total))
    return steps.groupBy("job_id").agg(value.cast("bigint").alias("progress"))


def analysis_status(sections: DataFrame) -> DataFrame:
    """done, partial or failed per repo over wanted sections (``section, status, requested``)."""
    wanted = ~F.col("section").isin(fixed.ON_DEMAND_SECTIONS) | F.coalesce("requested", F.lit(False)) | (F.col("status") == "done")
    rows = sections.where(wanted)
    done = F.count_if(F.col("status") == "done")
    status = F.when(done == F.count("*"), "done").when(done > 0, "partial").otherwise("failed")
    return rows.groupBy("repo_id").agg(done.alias("done"), F.count("*").alias("sections"), status.alias("status"))


def latest_job(jobs: DataFrame) -> DataFrame:
    """The newest job per repository, as an aggregate combined map-side."""
    rest = [c for c in jobs.columns if c != "repo_id"]
    best = jobs.groupBy("repo_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "job_id")).alias("j"))
    return best.select("repo_id", "j.*")


def new_work(requests: DataFrame, repositories: DataFrame) -> DataFrame:
    """What a request means for the stored snapshots: new, retry, cached or in_progress."""
    known = repositories.select("url_key", "commit_sha", "repo_id", "status")
    rows = salted_join(requests, known, ["url_key", "commit_sha"], "left", spread_by=["request_id"])
    outcome = (
        F.when(F.col("repo_id").isNull(), "new").when(F.col("status") == "failed", "retry").when(F.col("status") == "ready", "cached").otherwise("in_progress")
    )
    return rows.select("request_id", "url_key", "commit_sha", "repo_id", outcome.alias("outcome"))


def dashboard(links: DataFrame, repositories: DataFrame, jobs: DataFrame, analyses: DataFrame) -> DataFrame:
    """Each user's repositories, newest link first, with latest job and analysis status."""
    latest = latest_job(jobs).select("repo_id", "job_id", F.col("status").alias("job_status"))
    side = repositories.select("repo_id", F.col("status").alias("repo_status")).join(latest, "repo_id", "left")
    side = side.join(analyses.select("repo_id", F.col("status").alias("analysis_status")), "repo_id", "left")
    rows = salted_join(links.select("user_id", "repo_id", "linked_at"), side, ["repo_id"], spread_by=["user_id"])
    return rows.orderBy("user_id", F.desc("linked_at"), "repo_id")


def swept_jobs(jobs: DataFrame, repositories: DataFrame, now: Column) -> DataFrame:
    """Jobs silent for too long get their end status; all others stay. Running it twice changes nothing.

    Running jobs: 30 minutes; queued ones: 6 hours. A ready repository keeps its index: its job ends
    as done and its analysis is abandoned; any other repository and job fail.
    """
    seen = F.coalesce("heartbeat_at", "started_at", "created_at")
    limit = (
        F.when(F.col("status") == "running", now - F.expr(f"INTERVAL {fixed.STALE_MINUTES} MINUTES"))
        .when(F.col("status") == "queued", now - F.expr(f"INTERVAL {fixed.QUEUED_TIMEOUT_MINUTES} MINUTES"))
    )
    ready = repositories.select("repo_id", (F.col("status") == "ready").alias("_ready"))
    rows = skewed_join(jobs, ready, ["repo_id"], "left", shuffled=True)
    swept = F.coalesce(seen < limit, F.lit(False))
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(seen)) / 60_000_000)
    return rows.withColumn("swept", swept).withColumns(
        {
            "silent_minutes": F.when(F.col("swept"), minutes),
            "abandon_analysis": F.col("swept") & F.coalesce("_ready", F.lit(False)),
            "status": F.when(F.col("swept"), F.when(F.coalesce("_ready", F.lit(False)), "done").otherwise("failed")).otherwise(F.col("status")),
            "heartbeat_at": F.when(F.col("swept"), now).otherwise(F.col("heartbeat_at")),
        }
    ).drop("_ready")


def abandoned_sections(sections: DataFrame, repos: DataFrame, message: str) -> DataFrame:
    """Unfinished wanted sections of abandoned analyses become failed."""
    hit = salted_join(sections, repos.select("repo_id").distinct().withColumn("_hit", F.lit(True)), ["repo_id"], "left", spread_by=["section"])
    wanted = ~F.col("section").isin(fixed.ON_DEMAND_SECTIONS) | F.coalesce("requested", F.lit(False))
    fails = F.col("_hit").isNotNull() & wanted & (F.col("status") != "done")
    return hit.withColumn("error", F.when(fails, F.lit(message))).withColumn("status", F.when(fails, "failed").otherwise(F.col("status"))).drop("_hit")


def resumed_jobs(jobs: DataFrame, now: Column, model_online: bool) -> DataFrame:
    """Paused jobs: given up after 48 hours, the rest resumed once the model is back."""
    waiting = F.col("status") == "waiting_for_model"
    late = waiting & (F.col("waiting_since") < now - F.expr(f"INTERVAL {fixed.MAX_WAIT_HOURS} HOURS"))
    action = F.when(F.coalesce(late, F.lit(False)), "give_up").when(waiting & F.lit(model_online), "resume").when(waiting, "wait")
    status = F.when(action == "give_up", "done").when(action == "resume", "running").otherwise(F.col("status"))
    return jobs.withColumn("action", action).withColumn("status", status)


def last_logs(logs: DataFrame, keep: int = fixed.MAX_LOGS_PER_STEP) -> DataFrame:
    """The newest log lines of each step."""
    return top_k(logs, ["job_id", "step"], [F.desc("ts"), F.desc("event_id")], keep)


def status_changes(probes: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Probes whose ``value`` differs from the one before (the first is no change)."""
    rows = previous_value(probes, keys, order, value, "previous")
    return rows.where(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


# --- quotas -----------------------------------------------------------------------------------


def quota_decisions(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Which requests (``user_id, ts_us, event_id``) a sliding window accepts; rejected ones do not count.

    The decision depends on earlier ones, so each user's requests are cut into ordered slices. A
    slice is folded with the accepted times it inherits (at most ``limit``); slices whose inherited
    times turn out different are folded again until nothing changes. Users inside one slice need no
    second look, and no task ever holds more than one slice.
    """
    duration = seconds * 1_000_000
    rows = ordered_slices(requests.select("user_id", "ts_us", "event_id"), ["user_id"], ["ts_us", "event_id"])
    key = ["user_id", "_slice"]
    user = requests.schema["user_id"].dataType.simpleString()
    slices = rows.select(*key).distinct()
    by_user = Window.partitionBy("user_id").orderBy("_slice")
    many = slices.groupBy("user_id").count().where("count > 1").select("user_id")
    state = checkpointed(slices.join(many, "user_id", "left_semi").withColumn("history", F.array().cast("array<bigint>")))

    def fold(times: list, history: list) -> tuple[list, list]:
        kept, flags = deque(history), []
        for now in times:
            while kept and kept[0] <= now - duration:
                kept.popleft()
            flags.append(len(kept) < limit)
            if flags[-1]:
                kept.append(now)
        return flags, list(kept)

    def inherited(state_rows: pd.DataFrame) -> list:
        return list(state_rows["history"].iloc[0]) if len(state_rows) else []

    def outgoing(group: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if group.empty or known.empty:
            return pd.DataFrame({"user_id": [], "_slice": [], "out": []})
        group = group.sort_values(["ts_us", "event_id"])
        _, kept = fold(group["ts_us"].tolist(), inherited(known))
        return pd.DataFrame({"user_id": [group["user_id"].iloc[0]], "_slice": [group["_slice"].iloc[0]], "out": [kept]})

    def decide(group: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ts_us", "event_id"])
        flags, _ = fold(group["ts_us"].tolist(), inherited(known))
        return group[["user_id", "ts_us", "event_id"]].assign(accepted=flags)

    spanning = rows.join(many, "user_id", "left_semi")
    while not state.isEmpty():
        known = state.toDF(*state.columns)  # fresh column ids: both sides come from one frame
        ends = spanning.groupBy(*key).cogroup(known.groupBy(*key)).applyInPandas(outgoing, f"user_id {user}, _slice int, out array<bigint>")
        passed = ends.withColumn("history", F.coalesce(F.lag("out").over(by_user), F.array().cast("array<bigint>"))).drop("out")
        passed = checkpointed(passed)
        settled = passed.join(known.withColumnRenamed("history", "before"), key).where("history <> before").isEmpty()
        state = passed
        if settled:
            break
    known = state.toDF(*state.columns)
    cogrouped = rows.groupBy(*key).cogroup(known.groupBy(*key))
    return cogrouped.applyInPandas(decide, f"user_id {user}, ts_us bigint, event_id bigint, accepted boolean")


def quota_status(decisions: DataFrame, now_us: Column, limit: int, seconds: int) -> DataFrame:
    """Used, remaining and seconds until the oldest use leaves the window, per user at ``now``."""
    duration = seconds * 1_000_000
    live = decisions.where(F.col("accepted") & (F.col("ts_us") > now_us - duration) & (F.col("ts_us") <= now_us))
    used = live.groupBy("user_id").agg(F.count("*").alias("used"), F.min("ts_us").alias("_oldest"))
    rows = decisions.select("user_id").distinct().join(used, "user_id", "left")
    n = F.coalesce("used", F.lit(0))
    reset = F.floor((F.col("_oldest") + duration - now_us) / 1_000_000) + 1
    return rows.select(
        "user_id", n.alias("used"), F.greatest(F.lit(0), F.lit(limit) - n).alias("remaining"),
        F.when(n >= limit, reset).otherwise(F.lit(0)).alias("reset_in_seconds"),
    )


def budgeted_calls(calls: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """Calls with ``used`` tokens before them; ``allowed`` while that is below the budget."""
    return running_sum(calls, keys, order, "tokens", "used").withColumn("allowed", F.col("used") < limit)


# --- conversations ----------------------------------------------------------------------------


def conversation_context(messages: DataFrame, turns: int) -> DataFrame:
    """Messages (``thread_id, pos, role, text``) as the model sees them: the newest 2·turns verbatim,
    older ones as clipped digest lines. One row per message, so long threads stay distributed."""
    newest = top_k(messages.select("thread_id", "pos"), ["thread_id"], [F.desc("pos")], 2 * turns)
    cut = newest.groupBy("thread_id").agg(F.min("pos").alias("_cut"))
    rows = salted_join(messages, cut, ["thread_id"], "left", spread_by=["pos"])
    recent = F.coalesce(F.col("pos") >= F.col("_cut"), F.lit(False))
    asked = F.col("role") == "user"
    line = F.when(asked, F.concat(F.lit("- Q: "), X.clipped(F.col("text"), fixed.QUESTION_CLIP))).otherwise(
        F.concat(F.lit("- A: "), X.clipped(F.col("text"), fixed.ANSWER_CLIP))
    )
    return rows.select("thread_id", "pos", "role", recent.alias("verbatim"), F.when(recent, F.col("text")).otherwise(line).alias("text"))


def compacted(messages: DataFrame, max_chars: int, keep: int = fixed.KEEP_RECENT_OUTPUTS) -> DataFrame:
    """Tool outputs shortened until a thread fits: oldest first to 400 characters, the newest
    ``keep`` only afterwards and to 2,000.

    Only lengths are sorted, summed and stored. Texts meet the verdicts where they lie and stream past them: no task
    holds or sorts texts. Messages that agree in place, role and length share a verdict.
    """
    size = F.col("_size")
    rows = messages.select("thread_id", "pos", "role", F.length("text").alias("_size")).where("thread_id IS NOT NULL")
    totals = rows.groupBy("thread_id").agg(F.sum(size).alias("_total"))
    tools = rows.where("role = 'tool'")
    newest = top_k(tools.select("thread_id", "pos"), ["thread_id"], [F.desc("pos")], keep, "_n").drop("_n").distinct()
    rows = rows.join(newest.withColumn("_new", F.lit(True)), ["thread_id", "pos"], "left")
    rows = salted_join(rows, totals, ["thread_id"], spread_by=["pos"])
    old = (F.col("role") == "tool") & F.col("_new").isNull() & (size > fixed.OLD_OUTPUT_CHARS)
    saving = F.when(old, size - fixed.OLD_OUTPUT_CHARS - len(fixed.OLD_OUTPUT_NOTE)).otherwise(F.lit(0))
    rows = running_sum(rows.withColumn("_saving", saving), ["thread_id"], ["pos"], "_saving", "_saved")
    all_saved = rows.groupBy("thread_id").agg(F.sum("_saving").alias("_all"))
    rows = salted_join(rows, all_saved, ["thread_id"], spread_by=["pos"])
    cut_old = (F.col("_saving") != 0) & (F.col("_total") - F.col("_saved") > max_chars)
    cut_new = F.col("_new").isNotNull() & (size > fixed.RECENT_OUTPUT_CHARS) & (F.col("_total") - F.col("_all") > max_chars)
    cut = F.when(cut_old, "old").when(cut_new, "new").when((cut_old | cut_new).isNull(), "unknown")
    verdicts = rows.select("thread_id", "pos", "role", F.coalesce(size, F.lit(-1)).alias("_size"), cut.alias("_cut"))
    verdicts = checkpointed(verdicts.where("_cut IS NOT NULL").groupBy("thread_id", "pos", "role", "_size").agg(F.max("_cut").alias("_cut")))

    def short(n: int, note: str) -> Column:
        return F.concat(F.left("text", F.lit(n)), F.lit(note))

    text = F.when(F.col("_cut") == "old", short(fixed.OLD_OUTPUT_CHARS, fixed.OLD_OUTPUT_NOTE)).when(
        F.col("_cut") == "new", short(fixed.RECENT_OUTPUT_CHARS, fixed.RECENT_OUTPUT_NOTE)
    )
    # Plain keys: messages that are grouped by them already need no further shuffle.
    texts = messages.where("thread_id IS NOT NULL").withColumn("_size", F.coalesce(F.length("text"), F.lit(-1)))
    known = texts.where("pos IS NOT NULL")
    placed = verdicts.where("pos IS NOT NULL").hint("shuffle_hash")
    met = known.join(placed, ["thread_id", "pos", "role", "_size"], "left").select("thread_id", "pos", "role", "text", "_cut")
    met = met.unionByName(texts.where("pos IS NULL").join(verdicts.where("pos IS NULL").drop("pos"), ["thread_id", "role", "_size"], "left").select("thread_id", "pos", "role", "text", "_cut"))
    shortened = F.when(F.col("_cut").isNull(), F.lit(False)).when(F.col("_cut") != "unknown", F.lit(True))
    return met.select("thread_id", "pos", "role", F.coalesce(text, F.col("text")).alias("text"), shortened.alias("shortened"))


def thread_titles(messages: DataFrame) -> DataFrame:
    """The first question of a thread, squeezed and clipped."""
    asked = messages.where("role = 'user'")
    return asked.groupBy("thread_id").agg(F.min_by(X.clipped(F.col("text"), fixed.TITLE_CHARS), "pos").alias("title"))


# --- ordered sets and pages -------------------------------------------------------------------


def ordered_union(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Distinct ``keys`` of several frames; ``priority`` is the first frame that has them."""
    parts = [df.select(*keys).withColumn("priority", F.lit(i)) for i, df in enumerate(sources)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*keys).agg(F.min("priority").alias("priority"))


def page_after(rows: DataFrame, order: list[str], last: list | None, size: int = fixed.PAGE_SIZE) -> DataFrame:
    """The next page after the key ``last`` in ``order``: a filter and a top-n, no offset scan."""
    size = min(max(size, 1), fixed.MAX_PAGE_SIZE)
    if last is not None:
        key = [F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, last, strict=True)]
        rows = rows.where(F.struct(*order) > F.struct(*key))
    return rows.orderBy(*order).limit(size)

