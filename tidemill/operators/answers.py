"""The store of answers: look up by exact key or by similarity with the same terms, remember, expire, evict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fields, text as tx
from .rules import decide_hits, prune_cache

MOST, HOURS = 2000, 24


def lifetime_hours(setting: str | None) -> float:
    """The hours of a setting, or a day if it is none."""
    try:
        hours = float(setting or "")
    except ValueError:
        return HOURS
    return hours if 0 < hours < float("inf") else HOURS


def alive(entries: DataFrame, now: Column) -> DataFrame:
    return entries.where(F.col("expires_at") > now)


def exact_hits(requests: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """query_id, entry_id: the newest entry of the request's key and partition that came from an allowed side.

    ``requests``: query_id, exact_key, partition_key, allowed (array); ``entries``: id, exact_key, partition_key, target,
    created_at, expires_at. Of equals the least id counts.
    """
    pairs = requests.join(alive(entries, now).withColumnRenamed("id", "entry_id"), ["exact_key", "partition_key"]).where(F.array_contains("allowed", F.col("target")))
    newest = F.max_by(F.struct("entry_id"), F.struct("created_at", (-F.col("entry_id")).alias("n")))
    return pairs.groupBy("query_id").agg(newest.alias("e")).select("query_id", F.col("e.entry_id").alias("entry_id"))


def similar_pairs(requests: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """query_id, entry_id, pos, similarity, terms_match of all live entries of the request's partition and model from an allowed side.

    One row of ``requests`` (query_id, partition_key, model, vector, terms, allowed) meets the entries of its partition,
    which the store keeps to ``MOST`` at most.
    """
    held = alive(entries, now).select(F.col("id").alias("entry_id"), "partition_key", "model", "target", F.col("vector").alias("_v"), F.col("terms").alias("_t"))
    pairs = requests.join(held, ["partition_key", "model"]).where(F.array_contains("allowed", F.col("target")))
    return pairs.select("query_id", "entry_id", F.col("entry_id").alias("pos"), "model", tx.cosine(F.col("vector"), F.col("_v")).alias("similarity"), F.col("terms").eqNullSafe(F.col("_t")).alias("terms_match"))


def lookup(requests: DataFrame, entries: DataFrame, now: Column, threshold: float | None = None) -> DataFrame:
    """query_id, mode, hit, best, rejected_by_terms: what each request is answered with.

    Requests of mode ``exact`` are looked up by key, those of mode ``semantic`` by similarity at the model's threshold;
    requests that ask to bypass the store find nothing.
    """
    asked = requests.where(~F.coalesce("bypass", F.lit(False)))
    exact = exact_hits(asked.where("mode = 'exact'"), entries, now).select("query_id", F.col("entry_id").alias("hit"), F.lit(None).cast("long").alias("best"), F.lit(0).cast("long").alias("rejected_by_terms"))
    pairs = similar_pairs(asked.where("mode = 'semantic'"), entries.where("mode = 'semantic'"), now)
    least = fields.reuse_threshold(F.col("model"), threshold)
    near = decide_hits(pairs.withColumn("least", least), F.col("least"))
    found = exact.unionByName(near.select("query_id", "hit", "best", "rejected_by_terms"))
    return requests.select("query_id", "mode").join(found, "query_id", "left").withColumn("rejected_by_terms", F.coalesce("rejected_by_terms", F.lit(0)))


def mark_hits(entries: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """``entries`` with one more hit, and its time, for each time an entry is in ``hits`` (hit)."""
    counted = hits.where("hit is not null").groupBy(F.col("hit").alias("id")).agg(F.count("*").alias("_n"))
    rows = entries.join(counted, "id", "left")
    return rows.withColumns({"hits": F.coalesce("hits", F.lit(0)) + F.coalesce("_n", F.lit(0)), "last_hit_at": F.when(F.col("_n").isNotNull(), now).otherwise(F.col("last_hit_at"))}).drop("_n")


def remember(entries: DataFrame, new: DataFrame, now: Column, hours: float = HOURS, threshold: float | None = None, most: int = MOST) -> DataFrame:
    """The store after ``new`` entries: those of the same exact key go, as do similar ones of the same terms where ``replace`` asks for it, those that expired, and the least recently used beyond ``most``. Inputs are kept redacted."""
    key = ["exact_key", "partition_key"]
    rest = entries.join(new.where("mode = 'exact'").select(*key).distinct(), key, "left_anti")
    asked = new.where("mode = 'semantic' and replace").select(F.col("id").alias("query_id"), "partition_key", "model", "vector", "terms", F.array(F.lit("local"), F.lit("cloud")).alias("allowed"))
    alike = similar_pairs(asked, entries.where("mode = 'semantic'"), now).where((F.col("similarity") >= fields.reuse_threshold(F.col("model"), threshold)) & F.col("terms_match"))
    rest = rest.join(alike.select(F.col("entry_id").alias("id")).distinct(), "id", "left_anti")
    fresh = new.drop("replace").withColumns({"input": F.substring(tx.redact(F.col("input")), 1, 2000), "created_at": now, "expires_at": now + F.make_interval(secs=F.lit(hours * 3600.0)), "last_hit_at": F.lit(None).cast("timestamp"), "hits": F.lit(0).cast("long")})
    return prune_cache(rest.unionByName(fresh.select(*entries.columns)), now, most)


def evict_run(entries: DataFrame, source_run: str, served_from: int | None) -> DataFrame:
    """Without what a run produced and what it was served from."""
    return entries.where((F.col("source_run_id") != source_run) & (F.col("id") != (-1 if served_from is None else served_from)))
