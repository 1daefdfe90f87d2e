"""URL filter with DataFrame functions only: rules for hosts and paths, else logistic regression on hashed character n-grams.

The model is trained on the driver from the small labelled table below. Features are the character n-grams (3 to 5) of the
host and of the path, each with marks at its ends, hashed to 4096 buckets by the first three digits of their MD5; a URL's
score is the sum of their weights over the root of their number, plus a constant.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import let

BUCKETS, NGRAMS = 4096, (3, 4, 5)
#: (verdict, host and path); the longest that fits wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Hosts and paths with 1 for those to block.
LABELLED = (
    ("docs.library.example.org/guide/start", 0), ("www.university.example.edu/research/papers", 0), ("news.daily.example.org/en/2021/story.html", 0), ("wiki.example.org/page/History", 0),
    ("blog.writer.example.org/en/1204", 0), ("m.forum.example.org/de/335", 0), ("www.museum.example.org/fr/collection/", 0), ("archive.example.org/es/book/17.html", 0),
    ("data.city.example.gov/reports/2020", 0), ("help.software.example.org/manual/install", 0), ("journal.science.example.org/issue/4/article/9", 0), ("www.recipes.example.org/en/soup", 0),
    ("school.example.edu/courses/algebra", 0), ("garden.example.net/en/trees/", 0), ("books.example.net/de/roman/7.html", 0), ("www.weather.example.net/en/today", 0),
    ("travel.example.net/en/lisbon", 0), ("m.history.example.net/de/4411", 0), ("health.example.org/en/advice/sleep", 0), ("code.example.org/project/readme", 0),
    ("lyrics.example.net/it/12", 0), ("review.films.example.org/en/88", 0), ("law.example.gov/statute/12", 0), ("www.letters.example.org/en/33.html", 0),
    ("ads.banner.example.net/click", 1), ("ads-track.example.net/en/1", 1), ("m.ads-track.example.org/es/2", 1), ("track.pixel.example.net/t.gif", 1),
    ("adserver.example.org/serve/728x90", 1), ("www.casino-bonus.example.net/win", 1), ("poker-casino.example.org/free-spins", 1), ("xxx-cams.example.net/live", 1),
    ("adult-xxx.example.org/en/video", 1), ("cheap-pills.example.net/order/viagra", 1), ("viagra-shop.example.org/buy", 1), ("warez-crack.example.net/download/keygen.exe", 1),
    ("free-torrent.example.org/download/crack", 1), ("click-track.example.net/redirect", 1), ("spam-offers.example.org/win-prize", 1), ("promo-ads.example.net/banner/33", 1),
    ("payday-loans.example.org/apply-now", 1), ("seo-links.example.net/buy-backlinks", 1), ("tracker.example.org/pixel/track", 1), ("doubleads.example.net/de/12", 1),
    ("ads.media.example.org/banner/300x250", 1), ("adserver.example.net/click?x", 1), ("banner-ads.example.org/serve/1", 1), ("ads2.example.net/en/click/7", 1), ("track.clicks.example.org/pixel.gif", 1), ("pixel-track.example.net/t", 1),
    ("casino-slots.example.net/en/bonus", 1), ("win-casino.example.org/free-bonus", 1), ("online-poker.example.net/casino/spins", 1), ("slots-bet.example.org/win", 1), ("xxx-video.example.org/live-cams", 1), ("adult-cams.example.net/xxx", 1),
    ("buy-pills.example.org/cheap-viagra", 1), ("cheap-viagra.example.net/order", 1), ("pharma-pills.example.org/order/cheap", 1), ("crack-keygen.example.org/download", 1), ("torrent-warez.example.net/free/keygen.exe", 1), ("download-crack.example.org/setup.exe", 1),
    ("win-prize.example.net/spam/offers", 1), ("loans-payday.example.net/apply", 1), ("backlinks-seo.example.org/buy-links", 1), ("clickbait.example.net/wont-believe/12", 1), ("popup.example.net/ads/pop", 1), ("host-malware.example.net/exe/setup", 1),
    ("library.city.example.org/guide/hours", 0), ("research.university.example.edu/papers/12", 0), ("daily.example.org/news/world/2024", 0), ("en.wiki.example.org/page/River", 0), ("writer.example.net/blog/en/77", 0), ("forum.garden.example.org/de/991", 0),
    ("museum.example.org/en/history/room", 0), ("recipes.kitchen.example.net/fr/soupe", 0), ("www.example.edu/courses/history", 0), ("docs.code.example.net/project/guide", 0), ("weather.example.org/today/north", 0), ("books.library.example.org/en/novel/9.html", 0),
    ("travel.example.org/de/berlin", 0), ("health.city.example.gov/advice", 0), ("law.example.org/statute/44", 0), ("films.example.net/review/en/5", 0), ("music.letters.example.org/it/9", 0), ("school.example.org/courses/physics", 0),
    ("news.science.example.net/2023/stars", 0), ("www.trees.example.org/garden/oak", 0), ("history.example.edu/papers/rome", 0), ("archive.example.org/en/letters/1844", 0), ("maps.example.org/rivers", 0), ("poems.example.net/es/3.html", 0),
    ("bet-slots.example.org/casino", 1), ("popup-ads.example.net/fr/19", 1), ("malware-host.example.org/setup.exe", 1), ("clickbait-farm.example.net/you-wont-believe", 1),
)


def bucket(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:3], 16)


def features(host: str, path: str) -> list[int]:
    out = []
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        out += [bucket(mark + part[i : i + n]) for n in NGRAMS for i in range(len(part) - n + 1)]
    return out


@functools.cache
def model(rows: tuple = LABELLED, rounds: int = 400, rate: float = 0.5, decay: float = 1e-4) -> tuple[float, tuple[float, ...]]:
    """Constant and weights, in whole millionths of 1 so that SQL can state them."""
    data = []
    for url, label in rows:
        host, slash, path = url.partition("/")
        found = features(host, slash + path)
        data.append((found, 1 / math.sqrt(len(found)), label))
    weights, constant = [0.0] * BUCKETS, 0.0
    for _ in range(rounds):
        for found, scale, label in data:
            z = constant + scale * sum(weights[k] for k in found)
            error = 1 / (1 + math.exp(-z)) - label
            constant -= rate * 0.1 * error
            for k in found:
                weights[k] -= rate * (scale * error + decay * weights[k])
    return round(constant, 6), tuple(round(w, 6) for w in weights)


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none, or no url."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<verdict, rule> of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(domain + start).alias("rule"))).otherwise(out)
    return out


def block_score(host: Column, path: Column) -> Column:
    """The model's log odds that a URL is to be blocked."""
    constant, weights = model()
    held = F.from_json(F.lit(json.dumps(weights)), "array<double>")  # one literal, folded by the optimizer

    def grams(mark: str, part: Column) -> Column:
        def cut(chars: Column) -> Column:
            at = lambda n: F.when(F.size(chars) >= n, F.transform(F.slice(chars, F.lit(1), F.size(chars) - n + 1), lambda c, i: F.concat(F.lit(mark), *[F.get(chars, i + k) for k in range(n)])))
            return F.concat(*[F.coalesce(at(n), F.array().cast("array<string>")) for n in NGRAMS])

        return let(F.split(F.concat(F.lit("^"), part, F.lit("$")), ""), cut)

    weight = lambda g: F.get(held, F.conv(F.substring(F.md5(g.cast("binary")), 1, 3), 16, 10).cast("int"))
    mean = lambda every: F.when(F.size(every) > 0, F.aggregate(every, F.lit(0.0), lambda a, g: a + weight(g)) / F.sqrt(F.size(every).cast("double"))).otherwise(F.lit(0.0))
    return F.lit(constant) + let(F.concat(grams("h", host), grams("p", path)), mean)


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per row of ``pages``; no shuffle.

    A null url, or one without ``://``, has an empty host and path; no rule fits it, and the model judges it. Of rules that
    fit the longest counts; a score of just 0 blocks. Urls may be of any length, at a cost in proportion. Repeated rows
    stay, as do rows without an id; an empty table gives no rows; further columns are not carried, whatever their names.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("_url"))
    rows = rows.select("page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("_z", F.round(block_score(F.col("host"), F.col("path")), 6))
    own = F.when(F.col("_z") >= 0, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), own).alias("verdict"), F.col("_z").alias("score"))


def judge_sql() -> str:
    """The same for DuckDB."""
    constant, weights = model()
    held = "[" + ",".join(f"{w:.6f}::DOUBLE" for w in weights) + "]"
    grams = " || ".join(f"list_transform(range(1, greatest(length({part}) - {n} + 2, 1)), lambda i: '{mark}' || substr({part}, i, {n}))" for mark, part in (("h", "hh"), ("p", "pp")) for n in NGRAMS)
    cases = " ".join(f"WHEN (host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}') THEN '{v} {d}{p}'" for v, d, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    return f"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, '^' || host || '$' AS hh, '^' || path || '$' AS pp, CASE {cases} END AS r FROM b),
d AS (SELECT *, list_transform({grams}, lambda g: w[('0x' || md5(g)[1:3])::INT + 1]) AS own FROM c, (SELECT {held} AS w)),
e AS (SELECT *, round({constant} + CASE WHEN len(own) > 0 THEN list_sum(own) / sqrt(len(own)) ELSE 0 END, 6) AS score FROM d)
SELECT page_id, host, path, split_part(r, ' ', 2) AS rule, coalesce(split_part(r, ' ', 1), CASE WHEN score >= 0 THEN 'block' ELSE 'allow' END) AS verdict, score FROM e"""
