"""Folds over the ordered rows of each key: rate limits and state machines.

Rows are dealt by key and sorted; a task walks through them and only holds the state of the key it is at, however many
rows the key has.
"""

from __future__ import annotations

import functools
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Which action leads from which status to which.
TRANSITIONS = {
    "pending_accept": {"accept": "accepted", "reject": "rejected", "cancel": "cancelled"},
    "accepted": {"start": "in_progress", "cancel": "cancelled"},
    "in_progress": {"complete": "completed", "cancel": "cancelled"},
    "completed": {},
    "cancelled": {},
    "rejected": {},
}


_START = object()


def _same(a, b) -> bool:
    """Whether two keys are one; all nulls are."""
    return a == b or (a is not _START and pd.isna(a) and pd.isna(b))


def ordered(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key, *order)


def rate_limit(hits: DataFrame, key: str, ms: str, tie: str, limit: int = 20, window_ms: int = 60_000) -> DataFrame:
    """key, tie, accepted, null keys being one key: a hit is accepted if fewer than ``limit`` accepted ones lie in the window before it."""

    def run(frames):
        at, log = _START, deque()
        for f in frames:
            accepted = []
            for k, t in zip(f[key], f[ms]):
                if at is _START or not _same(k, at):
                    at, log = k, deque()
                while log and t - log[0] >= window_ms:
                    log.popleft()
                ok = len(log) < limit
                if ok:
                    log.append(t)
                accepted.append(ok)
            yield pd.DataFrame({key: f[key], tie: f[tie], "accepted": accepted})

    kinds = dict(hits.dtypes)
    return ordered(hits.select(key, ms, tie), key, ms, tie).mapInPandas(run, f"`{key}` {kinds[key]}, `{tie}` {kinds[tie]}, accepted boolean")


def refunds(action: str, actor: str, status: str, funds: str) -> bool:
    if funds != "held" or status == "completed":
        return False
    return action == "reject" or (action == "cancel" and (actor in ("streamer", "system") or status in ("pending_accept", "accepted")))


def run_orders(actions: DataFrame, key: str, order: str, action: str, actor: str) -> DataFrame:
    """key, status, funds, applied: what each order has come to after its actions; actions that do not fit are ignored."""

    def run(frames):
        at, status, funds, applied = _START, "pending_accept", "held", 0
        for f in frames:
            done = []
            for k, a, who in zip(f[key], f[action], f[actor]):
                if at is _START or not _same(k, at):
                    if at is not _START:
                        done.append((at, status, funds, applied))
                    at, status, funds, applied = k, "pending_accept", "held", 0
                if (new := after(status, funds, a, who)) is not None:
                    (status, funds), applied = new, applied + 1
            yield pd.DataFrame(done, columns=[key, "status", "funds", "applied"]).convert_dtypes()
        if at is not _START:
            yield pd.DataFrame([(at, status, funds, applied)], columns=[key, "status", "funds", "applied"]).convert_dtypes()

    kind = dict(actions.dtypes)[key]
    return ordered(actions.select(key, order, action, actor), key, order).mapInPandas(run, f"`{key}` {kind}, status string, funds string, applied int")


#: What an order can have come to, and what each action of an actor leads to from there: a table of targets and one of steps taken.
STATES = [(status, funds) for status in TRANSITIONS for funds in ("held", "released", "refunded")]


def after(status: str, funds: str, action: str | None, actor: str | None) -> tuple[str, str] | None:
    """Status and funds after an action; null if it does not fit."""
    new = TRANSITIONS[status].get(action)
    if new is None:
        return None
    return new, "released" if action == "complete" and funds == "held" else "refunded" if refunds(action, actor, status, funds) else funds


@functools.cache
def transition(action: str | None, actor: str | None) -> tuple[np.ndarray, np.ndarray]:
    """From each state to which, and whether the action counts there."""
    found = [after(*s, action, actor) for s in STATES]
    return np.array([i if f is None else STATES.index(f) for i, f in enumerate(found)], np.int8), np.array([f is not None for f in found], np.int64)


def run_orders_apart(actions: DataFrame, key: str, order: list[str], action: str, actor: str) -> DataFrame:
    """As ``run_orders``, for keys of any number of actions: no task has a key whole.

    What a stretch of actions does is a table from each of the 18 states to one of them, and tables compose in any
    grouping, so every partition of the ordered rows folds its stretch of a key into one table, and a key's tables, one
    for each partition that holds some of it, are applied one after the other. ``order`` has to tell a key's actions apart.
    """
    own = actions.select(F.col(key).alias("k"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(action).alias("a"), F.col(actor).alias("w"))
    by = ["k", *[f"o{i}" for i in range(len(order))]]
    dealt = own.repartitionByRange(*by).sortWithinPartitions(*by).select("k", "a", "w", F.spark_partition_id().alias("part"))

    def fold(frames):
        at, part = _START, 0
        for f in frames:
            done = []
            part = int(f["part"].iloc[0]) if len(f) else part
            for k, a, w in zip(f["k"], f["a"], f["w"]):
                if at is _START or not _same(k, at):
                    if at is not _START:
                        done.append((at, part, state.tolist(), steps.tolist()))
                    at, state, steps = k, np.arange(len(STATES), dtype=np.int8), np.zeros(len(STATES), np.int64)
                to, counts = transition(a, w)
                steps = steps + counts[state]
                state = to[state]
            yield pd.DataFrame(done, columns=["k", "part", "state", "steps"])
        if at is not _START:
            yield pd.DataFrame([(at, part, state.tolist(), steps.tolist())], columns=["k", "part", "state", "steps"])

    kind = dict(own.dtypes)["k"]
    tables = dealt.mapInPandas(fold, f"k {kind}, part int, state array<tinyint>, steps array<bigint>")
    held = tables.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("part", "state", "steps"))).alias("t"))  # one for each partition at most
    start = F.struct(F.lit(STATES.index(("pending_accept", "held"))).cast("tinyint").alias("state"), F.lit(0).cast("bigint").alias("steps"))
    end = held.select("k", F.aggregate("t", start, lambda s, t: F.struct(F.get(t["state"], s["state"].cast("int")).alias("state"), (s["steps"] + F.get(t["steps"], s["state"].cast("int"))).alias("steps"))).alias("e"))
    name = lambda i: F.get(F.array(*[F.lit(s[i]) for s in STATES]), F.col("e.state").cast("int"))
    return end.select(F.col("k").alias(key), name(0).alias("status"), name(1).alias("funds"), F.col("e.steps").cast("int").alias("applied"))


def admit(orders: DataFrame, key: str, at: str, tie: str, price: str, most: int, budget: float) -> DataFrame:
    """key, tie, reason: why an order is refused, null if it is taken. Only orders that were taken count against the budget and the ``most`` that may be held; one without a price is refused."""

    def run(frames):
        held_by, held, spent = _START, 0, 0.0
        for f in frames:
            reasons = []
            for k, p in zip(f[key], f[price]):
                if held_by is _START or not _same(k, held_by):
                    held_by, held, spent = k, 0, 0.0
                # a price that is not known is never within the budget
                reason = "tickets_insufficient" if pd.isna(p) or spent + p > budget else "queue_full" if held >= most else None
                if reason is None:
                    held, spent = held + 1, spent + p
                reasons.append(reason)
            yield pd.DataFrame({key: f[key], tie: f[tie], "reason": pd.Series(reasons, dtype=object, index=f.index)})

    kinds = dict(orders.dtypes)
    return ordered(orders.select(key, at, tie, price), key, at, tie).mapInPandas(run, f"`{key}` {kinds[key]}, `{tie}` {kinds[tie]}, reason string")
