"""Decision rules as columns: routes, provider errors, cache use, policy, relevance scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Which tasks run where, and from which length on input counts as long.
CLOUD_TASKS, LOCAL_TASKS, LONG_INPUT = ("analyze", "refactor", "investigate"), ("summarize", "polish", "continue", "translate", "tags", "chat"), 2000


def route(task: Column, strategy: Column, length: Column, cloud: Column, local_runtime: Column) -> Column:
    """local or cloud."""
    auto = F.when(task.isin(*CLOUD_TASKS), F.when(cloud, "cloud").otherwise("local")).when(cloud & (length >= LONG_INPUT) & task.isin(*LOCAL_TASKS), "cloud").otherwise("local")
    return F.when(~local_runtime, "cloud").when(strategy == "only-local", "local").when(strategy == "only-cloud", F.when(cloud, "cloud").otherwise("local")).otherwise(auto)


def error_code(status: Column, text: Column) -> Column:
    """The first class that fits the status or the message."""
    # fixed values: what messages of each class hold
    has = lambda p: text.rlike("(?i)" + p)
    at = lambda *codes: F.coalesce(status.isin(*codes), F.lit(False))
    limited = at(429) | has("resource_exhausted|exceeded your current quota|quota|rate limit|too many requests")
    spent = has("quota|resource_exhausted|billing|free.?tier") | (has("rpd|tokens?") & ~has(r"per minute|rpm|retry in \d"))
    return (
        F.when(limited, F.when(spent, "quota_exhausted").otherwise("rate_limited"))
        .when(at(401, 403) | has("invalid.?api.?key|unauthor"), "auth")
        .when(at(404) | has("no longer available|model .+ not found|does not exist|not found"), "model_unavailable")
        .when(has("context.?length|maximum context|too many tokens|token.?limit|prompt is too long"), "context_too_long")
        .when(F.coalesce(status >= 500, F.lit(False)) | has("overloaded|unavailable|service.?unavailable|bad gateway|gateway timeout"), "provider_unavailable")
        .otherwise("unknown")
    )


def failure_code(kind: Column, status: Column, text: Column, local: Column) -> Column:
    """The class of a failure: ``kind`` is the error's name, or http for a reply with a status; ``local`` whether the local runtime failed."""
    unreached = (kind == "TypeError") | ((kind == "Error") & text.rlike("(?i)fetch failed|network"))
    return (
        F.when(kind == "TimeoutError", "timeout")
        .when(kind == "AbortError", "aborted")
        .when(unreached, F.when(local, "ollama_offline").otherwise("network"))
        .when(kind.isin("Error", "http"), error_code(F.when(kind == "http", status), text))
        .otherwise("unknown")
    )


def retryable(code: Column) -> Column:
    return ~code.isin("auth", "model_unavailable", "context_too_long")


def falls_back_to_local(code: Column) -> Column:
    return code.isin("quota_exhausted", "rate_limited", "provider_unavailable", "network")


def lowers_tier(code: Column) -> Column:
    return falls_back_to_local(code) | (code == "model_unavailable")


def falls_back_to_cloud(code: Column) -> Column:
    return code.isin("ollama_offline", "model_unavailable", "network")


def store_skip_reason(status: Column, output_chars: Column, error: Column, sensitive: Column, stages: Column, ungrounded: Column) -> Column:
    """Why an answer is not kept; null if it is."""
    flagged = F.get(F.filter(stages, lambda s: s != "input"), F.lit(0))
    return F.when((status != "ok") | (output_chars == 0), F.concat(F.lit("status "), status)).when(error.isNotNull(), F.concat(F.lit("provider error "), error)).when(sensitive, "sensitive input").when(flagged.isNotNull(), F.concat(flagged, F.lit(" guardrail hit"))).when(ungrounded > 0, "ungrounded references")


def decide_hits(candidates: DataFrame, threshold: float | Column) -> DataFrame:
    """For each query: the closest stored answer with the same terms at the threshold or above, the closest at all, and how many the terms ruled out.

    Rows: query_id, entry_id, pos, similarity, terms_match. Of equals the first counts.
    """
    near = F.col("similarity") >= threshold
    key = lambda where: F.max(F.when(where, F.struct("similarity", (-F.col("pos")).alias("p"), "entry_id")))
    return candidates.groupBy("query_id").agg(key(near & F.col("terms_match"))["entry_id"].alias("hit"), key(F.lit(True))["entry_id"].alias("best"), F.count_if(near & ~F.col("terms_match")).alias("rejected_by_terms"))


def order_reason(kind: Column, known: tuple[str, ...], violation: Column, seed: Column, game: Column, details: Column) -> Column:
    """The first reason to refuse an order; null if there is none."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(~kind.isin(*known), "kind_not_allowed").when(violation.isNotNull(), violation).when((kind == "seed") & blank(seed), "seed_required").when(blank(game), "game_required").when(blank(details) & (kind != "seed"), "details_required")


def rerank_scores(raw: Column, count: Column) -> Column:
    """Scores 0 to 3 in the order of the candidates, 0 for those left out, from a model's JSON with or without a fence."""
    body = F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    items = F.coalesce(F.from_json(body, "scores array<struct<id:string,score:double>>")["scores"], F.array().cast("array<struct<id:string,score:double>>"))
    index = lambda x: F.regexp_replace(F.regexp_replace(x["id"], r"(?i)^\[?P", ""), r"\]$", "").try_cast("int")
    last = lambda i: F.element_at(F.filter(items, lambda x: (index(x) == i) & x["score"].isNotNull()), -1)["score"]
    own = lambda i: F.when(F.exists(items, lambda x: (index(x) == i) & x["score"].isNotNull()), F.greatest(F.lit(0), F.least(F.lit(3), F.floor(last(i) + 0.5).cast("int")))).otherwise(F.lit(0))
    return F.transform(F.sequence(F.lit(1), count), own)


def prune_cache(entries: DataFrame, now: Column, most: int = 2000) -> DataFrame:
    """Entries that have not expired, the most recently used ``most`` of them."""
    alive = entries.where(F.col("expires_at") > now)
    return alive.orderBy(F.coalesce("last_hit_at", "created_at").desc(), "id").limit(most)


def check_mentions(text: Column, groups: list[list[str]]) -> Column:
    """Whether each group has an alternative that the text holds, in any case."""
    low = F.lower(text)
    return F.array(*[F.greatest(*[F.contains(low, F.lit(a.lower())) for a in g]) if len(g) > 1 else F.contains(low, F.lit(g[0].lower())) for g in groups])
