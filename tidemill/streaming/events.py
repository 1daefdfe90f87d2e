"""Streams: folds of event streams, windows, a rate limit and deadlines by state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(events: DataFrame, late: str) -> DataFrame:
    """With a watermark if the rows are a stream; times without a zone are taken as the session's."""
    if not events.isStreaming:
        return events
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def fold_runs(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One row per user, kept up to date: counts, first and last time, first click, errors. Works on batches alike."""
    rows = timed(events, late)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.min(F.when(F.col("event_type") == "click", F.col("ts"))).alias("first_click"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"))


def windowed(events: DataFrame, size: str = "1 day", late: str = "10 minutes") -> DataFrame:
    rows = timed(events, late)
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = timed(events, late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def rate_limited(events: DataFrame, limit: int = 20, window_ms: int = 60_000, late: str = "10 minutes") -> DataFrame:
    """user_id, event_id, accepted of a stream, in order of event time within a trigger; the state is the accepted times of the last window.

    It goes when the watermark, not the clock, has passed the window, so a replay that pauses forgets nothing.
    """

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])  # a key's rows of one trigger may come in several frames
        accepted = []
        for t in rows["ms"]:
            log = [x for x in log if t - x < window_ms]
            ok = len(log) < limit
            if ok:
                log.append(int(t))
            accepted.append(ok)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "accepted": accepted})
        state.update((log,))
        state.setTimeoutTimestamp(max(int(rows["ms"].max()) + window_ms, state.getCurrentWatermarkMs() + 1))

    rows = timed(events, late).withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, accepted boolean", "log array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def overdue(orders: DataFrame, now, accept_minutes: int = 15, start_minutes: int = 30) -> DataFrame:
    """``orders`` (status, funds, created_at, accepted_at) with the action that is due at ``now``."""
    due = lambda c, m: F.lit(now) >= F.col(c) + F.make_interval(mins=F.lit(m))
    late = ((F.col("status") == "pending_accept") & due("created_at", accept_minutes)) | ((F.col("status") == "accepted") & due("accepted_at", start_minutes))
    return orders.withColumn("action", F.when((F.col("funds") == "held") & late, "cancel"))


def once(events: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """Each event once, however often it comes within the watermark's delay; state is kept that long only. Batches alike."""
    return timed(events, late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def runs_with_spans(runs: DataFrame, spans: DataFrame, late: str = "10 minutes", within: str = "30 minutes") -> DataFrame:
    """run_id, status, started, span_id, at: each span once with its run, if it began ``within`` of the run's start.

    Both are streams (or batches) with a time ``ts``: runs have run_id and status, spans run_id and span_id. Rows later than
    the watermark are dropped; the bound on time lets either side's state go. Runs without spans wait until no span can
    come any more and then have one row with nulls.
    """
    left = once(runs, ["run_id"], late).select("run_id", "status", F.col("ts").alias("started"))
    right = once(spans, ["run_id", "span_id"], late).select(F.col("run_id").alias("of_run"), "span_id", F.col("ts").alias("at"))
    near = (F.col("of_run") == F.col("run_id")) & (F.col("at") >= F.col("started")) & (F.col("at") <= F.col("started") + F.expr(f"INTERVAL {within}"))
    return left.join(right, near, "left").drop("of_run")
