"""Offers, featured shortcuts, feeds and inboxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as tx


def price(prices: Column, kind: Column) -> Column:
    return F.try_element_at(prices, kind)


def offered_kinds(prices: Column, kinds: tuple[str, ...]) -> Column:
    """Those of ``kinds`` that have a price, in their order."""
    return F.filter(F.array(*map(F.lit, kinds)), lambda k: F.map_contains_key(prices, k))


def offered_games(offers: Column, kinds: tuple[str, ...]) -> Column:
    """Games of the offers that price at least one of ``kinds``."""
    return F.transform(F.filter(offers, lambda o: F.size(offered_kinds(o["kindPrices"], kinds)) > 0), lambda o: o["game"])


def visible_goods(goods: DataFrame, streamers: DataFrame, kinds: tuple[str, ...], banned: str | None = None) -> DataFrame:
    """Listed goods of a known kind whose streamer is there and whose words no rule bans."""
    rows = goods.where(F.col("listed") & F.col("kind").isin(*kinds))
    if banned:
        rows = rows.where(~F.concat_ws("\n", "title", "game", "details").rlike(banned))
    return rows.join(streamers.select(F.col("id").alias("streamer_id")), "streamer_id", "left_semi")


def featured(streamers: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """One row: the first offer with a price, of a streamer who is live if there is one. ``streamers``: pos, id, live, offers."""
    rows = streamers.select("pos", "id", "live", F.posexplode("offers").alias("i", "o")).withColumn("offered", offered_kinds(F.col("o.kindPrices"), kinds)).where(F.size("offered") > 0)
    return rows.orderBy(F.desc("live"), "pos", "i").limit(1).select("id", F.col("o.game").alias("game"), F.get("offered", F.lit(0)).alias("kind"))


def hottest(orders: DataFrame, group: str, kind: str, kinds: tuple[str, ...]) -> DataFrame:
    """The most frequent kind of each group; of equals the first in ``kinds``."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col(kind))
    counted = orders.groupBy(group, kind).agg(F.count("*").alias("n"))
    best = counted.groupBy(group).agg(F.max(F.struct("n", (-rank).alias("r"), kind)).alias("b"))
    return best.select(group, F.col(f"b.{kind}").alias(kind), "b.n")


def flatten_feed(stars: DataFrame) -> DataFrame:
    """One row for each event of each star, with its place within the star, the newest first."""
    newest = F.reverse(F.array_sort(F.col("events")))
    return stars.select("slug", F.posexplode(newest).alias("pos", "e")).select("slug", "pos", "e.*")


def by_month(feed: DataFrame, date: str = "date", most: int = 20) -> DataFrame:
    """month, n, items: how many rows a month has and the newest ``most`` of them, its page of the feed. No task holds a month."""
    rows = feed.select(F.to_date(date).alias("date"), "title").withColumn("month", F.date_format("date", "yyyy-MM"))
    newest = rows.withColumn("_n", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("date"), F.desc("title")))).where(F.col("_n") <= most)
    items = newest.groupBy("month").agg(F.sort_array(F.collect_list(F.struct("date", "title")), asc=False).alias("items"))
    counts = rows.groupBy(F.col("month").alias("_month")).agg(F.count("*").alias("n"))
    return counts.join(items, F.col("month").eqNullSafe(F.col("_month"))).select("month", "n", "items")


def refund_all(orders: DataFrame, viewer: str) -> DataFrame:
    """viewer, refund, cancelled: the sum and number of each viewer's orders (funds, price) that still hold funds."""
    held = F.coalesce(F.col("funds") == "held", F.lit(False))
    return orders.groupBy(viewer).agg(F.sum(F.when(held, F.coalesce("price", F.lit(0.0))).otherwise(0.0)).alias("refund"), F.count_if(held).alias("cancelled"))


def new_items(items: DataFrame, inbox: DataFrame, stars: DataFrame) -> DataFrame:
    """Items of known stars whose id the inbox lacks: id, slug, title, link, summary, published."""
    rows = items.join(stars.select("slug"), "slug", "left_semi").withColumn("id", F.substring(F.sha2(F.concat_ws("::", "slug", "link"), 256), 1, 16))
    first = Window.partitionBy("id").orderBy("published", "title")
    fresh = rows.join(inbox.select("id"), "id", "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    published = F.coalesce(F.try_to_timestamp("published").cast("date"), F.current_date())
    return fresh.select("id", "slug", "title", "link", tx.strip_html(F.col("summary")).alias("summary"), published.alias("published"), F.lit("pending").alias("status"))
