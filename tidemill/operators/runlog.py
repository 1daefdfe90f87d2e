"""Statistics of a run log, price of usage, span trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import tree

WINDOW_RUNS = 500


def nearest_rank(value: Column, p: float) -> Column:
    """The value at ceil(p n) of the group's sorted values; null of none. For groups of bounded size; ``prefix.percentiles`` is for any."""
    held = F.sort_array(F.collect_list(value))
    return F.get(held, F.greatest(F.ceil(F.lit(p) * F.size(held)) - 1, F.lit(0)).cast("int"))


def newest(runs: DataFrame, n: int = WINDOW_RUNS) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def run_stats(runs: DataFrame, n: int = WINDOW_RUNS) -> DataFrame:
    """One row of totals over the newest ``n`` runs, so that lists of values stay small."""
    rows = newest(runs, n)
    ok, cached = F.col("status") == "ok", F.col("cache_entry_id").isNotNull()
    model, used = ok & ~cached, F.col("prompt_tokens").isNotNull()
    tokens = F.when(used, F.col("prompt_tokens") + F.coalesce("completion_tokens", F.lit(0)))
    total = lambda c, w: F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0))
    cost, saved = total("cost_usd", used), total("saved_usd", used)
    return rows.agg(
        F.count("*").alias("runs"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "error", "aborted", "blocked")],
        F.count_if("fell_back").alias("fell_back"),
        F.count_if(model).alias("latency_count"),
        *[nearest_rank(F.when(model, F.col(c)), p).alias(name) for c, p, name in (("ttft_ms", 0.5, "ttft_p50"), ("ttft_ms", 0.95, "ttft_p95"), ("total_ms", 0.5, "total_p50"), ("total_ms", 0.95, "total_p95"))],
        F.floor(F.avg(tokens) + 0.5).alias("avg_tokens"),
        cost.alias("cost_usd"),
        saved.alias("saved_usd"),
        F.try_divide(saved, cost + saved).alias("savings_rate"),
        F.count_if(cached).alias("cache_hits"),
        # hits of any status over answered runs only
        F.try_divide(F.count_if(cached), F.count_if(ok)).alias("hit_rate"),
        total("cache_saved_ms", cached).alias("cache_saved_ms"),
        nearest_rank(F.when(cached, F.col("total_ms")), 0.5).alias("hit_p50"),
        F.count_if(F.col("difficulty").isNotNull()).alias("assessed"),
        F.count_if(F.col("difficulty") == "complex").alias("complex"),
        *[F.count_if(F.col("model_tier") == t).alias(f"tier_{t}") for t in ("standard", "strong")],
        F.count_if("escalated").alias("escalated"),
        F.count_if(F.col("escalated") & (F.col("model_tier") == "strong")).alias("escalation_kept"),
    )


def by_task(runs: DataFrame, n: int = WINDOW_RUNS) -> DataFrame:
    tokens = F.when(F.col("prompt_tokens").isNotNull(), F.col("prompt_tokens") + F.coalesce("completion_tokens", F.lit(0)))
    return newest(runs, n).groupBy("task_type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("errors"), F.floor(F.avg(tokens) + 0.5).alias("avg_tokens"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd")).orderBy(F.desc("n"), "task_type")


def priced(usage: DataFrame, prices: DataFrame, model_col: str = "model", default: tuple[float, float] = (0.25, 1.5)) -> DataFrame:
    """``usage`` with the cost of its tokens; models without a price have the default. ``prices``: model, input_per_m, output_per_m."""
    held = F.broadcast(prices) if prices.count() <= 10_000 else prices
    rows = usage.join(held, usage[model_col] == held["model"], "left").drop(held["model"])
    cost = (F.col("prompt_tokens") * F.coalesce("input_per_m", F.lit(default[0])) + F.col("completion_tokens") * F.coalesce("output_per_m", F.lit(default[1]))) / 1_000_000
    return rows.withColumn("cost_usd", cost).drop("input_per_m", "output_per_m")


def close_spans(spans: DataFrame, at: int) -> DataFrame:
    """Open spans end at ``at``; those that were fine become a warning."""
    open_ = F.col("ended_at").isNull()
    return spans.withColumn("status", F.when(open_ & (F.col("status") == "ok"), "warning").otherwise(F.col("status"))).withColumn("ended_at", F.coalesce("ended_at", F.lit(at)))


def trace_summary(spans: DataFrame) -> DataFrame:
    end, gen = F.coalesce("ended_at", "started_at"), F.col("kind") == "generation"
    total = lambda c: F.coalesce(F.sum(F.when(gen, F.col(c))), F.lit(0))
    return spans.groupBy("run_id").agg(
        F.min("started_at").alias("started_at"), (F.max(end) - F.min("started_at")).alias("duration_ms"), F.count("*").alias("spans"), F.count_if(gen).alias("llm_calls"), F.count_if(F.col("kind") == "tool").alias("tool_calls"),
        total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens"), total("cost_usd").alias("cost_usd"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "warning").alias("warnings"),
    )


def waterfall(spans: DataFrame) -> DataFrame:
    """run_id, span_id, depth, offset_pct, width_pct, ttft_pct, duration_ms, pos: spans in the order of their tree (``tree.walk``), with shares of the run's time.

    A span without its parent is a root; spans on a circle of parents have no row.
    """
    walked = tree.walk(spans, "started_at").select(F.col("run").alias("run_id"), F.col("id").alias("span_id"), "depth", "pos")
    end = F.coalesce("ended_at", "started_at")
    runs = spans.groupBy(F.col("run_id").alias("_run")).agg(F.min("started_at").alias("_from"), F.max(end).alias("_to"))
    span = F.greatest(F.col("_to") - F.col("_from"), F.lit(1))
    took = end - F.col("started_at")
    ttft = F.when(F.col("first_token_at").isNotNull() & (took > 0), F.least(F.lit(100.0), (F.col("first_token_at") - F.col("started_at")) * 100 / F.when(took > 0, took)))
    shares = spans.join(runs, F.col("run_id").eqNullSafe(F.col("_run"))).select("run_id", "span_id", ((F.col("started_at") - F.col("_from")) * 100 / span).alias("offset_pct"), (took * 100 / span).alias("width_pct"), ttft.alias("ttft_pct"), took.alias("duration_ms"))
    a, b = walked.alias("a"), shares.alias("b")
    return a.join(b, F.col("a.run_id").eqNullSafe(F.col("b.run_id")) & (F.col("a.span_id") == F.col("b.span_id"))).select("a.run_id", "a.span_id", "a.depth", "b.offset_pct", "b.width_pct", "b.ttft_pct", "b.duration_ms", "a.pos")
