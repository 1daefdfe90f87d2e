"""Queries whose inputs are built of the rows of a table by arithmetic on their keys, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import plans, templates, text as tx
from ..operators import folds, market, rules, runlog
from ..scratch import shared_path
from ..sources import stores, versioned
from .more import FSM, _sql_case
from .special import table

E = "event_id"


def _k():
    return F.col(E)


def _pick(key, values):
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


# -- texts


def grounding_check(spark, sf_dir):
    """Claims about every order, of which the evidence holds two numbers, and for most the batch."""
    k, a, b = F.col("o_orderkey"), F.col("o_orderkey") % 50 + 1, F.col("o_custkey") % 40 + 1
    batch = F.concat(F.lit("B-"), F.lpad((k % 9).cast("string"), 6, "0"), F.lit("-01"))
    output = F.concat(F.lit("Batch "), batch, F.lit(" fell by "), (k % 30).cast("string"), F.lit(" % of all"))
    evidence = F.concat_ws(" ", a.cast("string"), b.cast("string"), F.when(k % 3 > 0, batch), F.lit("2024-09-09"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(tx.ungrounded(output, evidence), ",").alias("ungrounded"))


GROUNDING = """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 30 AS p, (o_orderkey % 50 + 1)::DOUBLE AS a, (o_custkey % 40 + 1)::DOUBLE AS b FROM orders),
 g AS (SELECT k, p, p = 0 OR p = a OR p = b OR (a <> b AND (abs(a - b) = p OR abs(a / b * 100 - p) <= 0.05 OR abs(b / a * 100 - p) <= 0.05 OR floor(a / b * 100 + 0.5) = p OR floor(b / a * 100 + 0.5) = p)) AS ok FROM o)
SELECT k AS o_orderkey, concat_ws(',', CASE WHEN k % 3 = 0 THEN 'B-' || lpad((k % 9)::VARCHAR, 6, '0') || '-01' END, CASE WHEN NOT ok THEN p || '%' END) AS ungrounded FROM g"""

DIGITS = "一二三四五六七八九"


def zh_numeral(spark, sf_dir):
    """Numerals up to 99, and what is none, read back."""
    n = _k() % 102
    digit = lambda x: F.substring(F.lit(DIGITS), x.cast("int"), F.lit(1))
    tens, ones = F.floor(n / 10), n % 10
    numeral = F.when(n == 0, "零").when(n == 100, "百").when(n == 101, "十十").when(n < 10, digit(n)).otherwise(F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.lit("十"), F.when(ones > 0, digit(ones)).otherwise("")))
    return table(spark, sf_dir, "events").select(E, tx.chinese_number(numeral).cast("long").alias("n"))


def section_split(spark, sf_dir):
    """The parts of a note that is made of each document's numbers."""
    k = F.col("doc_id")
    note = F.concat(F.lit("---\ntitle: Note "), k, F.lit("\ntype: sop\ncodes: A-"), k % 7, F.lit(", C-D\n---\nintro\n## Steps "), k % 3, F.lit("\nOpen "), F.col("n_chars"), F.lit(". Close.\n## Empty\n\n"), F.when(k % 3 > 0, "## Notes\n- one\n- two\n").otherwise(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.sections(note)).alias("i", "s"), tx.front_matter(note).alias("m"))
    return rows.select("doc_id", "i", F.col("s.heading").alias("heading"), F.col("s.body").alias("body"), F.col("m")["title"].alias("title"), F.array_join(tx.comma_list(F.col("m")["codes"]), "|").alias("codes"))


_NOTE = "'Note ' || doc_id AS title, 'A-' || doc_id % 7 || '|C-D' AS codes FROM documents"
SECTIONS = f"SELECT doc_id, 0 AS i, 'Steps ' || doc_id % 3 AS heading, 'Open ' || n_chars || '. Close.' AS body, {_NOTE} UNION ALL SELECT doc_id, 1, 'Notes', '- one' || chr(10) || '- two', {_NOTE} WHERE doc_id % 3 > 0"


def usd_format(spark, sf_dir):
    usd = F.when(_k() % 6 == 0, 0.0).when(_k() % 6 == 1, 0.00005).when(_k() % 6 == 2, (_k() % 90 + 1) / 10000).when(_k() % 6 == 3, (_k() % 90 + 1) / 100).when(_k() % 6 == 4, _k() % 1000 + 1.25)
    n = F.when(_k() % 4 == 0, _k() % 9999).when(_k() % 4 == 1, 10_000 + 100 * (_k() % 9000)).when(_k() % 4 == 2, 1_000_000 + 100_000 * (_k() % 50))
    return table(spark, sf_dir, "events").select(E, plans.format_usd(usd.cast("double")).alias("usd"), plans.format_tokens(n).alias("tokens"))


FORMATS = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '$0' WHEN 1 THEN '<$0.0001' WHEN 2 THEN printf('$%.4f', (event_id % 90 + 1) / 10000.0::DOUBLE) WHEN 3 THEN printf('$%.3f', (event_id % 90 + 1) / 100.0::DOUBLE) WHEN 4 THEN printf('$%.2f', event_id % 1000 + 1.25::DOUBLE) ELSE '—' END AS usd,
 CASE event_id % 4 WHEN 0 THEN format('{:,}', event_id % 9999) WHEN 1 THEN printf('%.1fk', (10000 + 100 * (event_id % 9000)) / 1000.0::DOUBLE) WHEN 2 THEN printf('%.1fM', (1000000 + 100000 * (event_id % 50)) / 1000000.0::DOUBLE) ELSE '—' END AS tokens FROM events"""


# -- plans and scores

PLAN = '{"inScope": %s, "summary": "Etch drifts %s.", "findings": [{"text": "Yield fell", "refs": ["B-%s"]}], "causes": [{"text": "RF drift", "confidence": "%s", "refs": []}], "actions": [{"text": "Clean", "priority": "P0", "owner": "process"}], "dataToConfirm": ["pressure"]}'
EMPTY_PLAN = '{"inScope": %s, "summary": "No.", "findings": [], "causes": [], "actions": [], "dataToConfirm": []}'


def plan_markdown(spark, sf_dir):
    """Plans with the number of every benchmark item: fenced, broken, of an unknown level, out of scope, and empty."""
    k = F.col("item_id").cast("string")
    full = lambda level: F.format_string(PLAN, F.lit("true"), k, k, F.lit(level))
    raw = F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("```json\n"), full("high"), F.lit("\n```"))).when(F.col("item_id") % 5 == 1, "{broken").when(F.col("item_id") % 5 == 2, full("certain")).when(F.col("item_id") % 5 == 3, F.lit(EMPTY_PLAN % "false")).otherwise(F.lit(EMPTY_PLAN % "true"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", plans.parse_plan(raw).alias("p"))
    return rows.select("item_id", F.col("p").isNotNull().alias("ok"), plans.render_plan(F.col("p")).alias("text"), F.array_join(plans.ungrounded_refs(F.col("p"), F.lit("B-10 B-20")), ",").alias("loose"))


PLAN_MARKDOWN = """SELECT item_id, item_id % 5 IN (0, 3) AS ok, CASE item_id % 5 WHEN 0 THEN 'Etch drifts ' || item_id || '.' || chr(10) || chr(10) || '## Findings' || chr(10) || '- Yield fell (B-' || item_id || ')' || chr(10) || chr(10) || '## Likely causes' || chr(10) || '- [high] RF drift' || chr(10) || chr(10)
 || '## Actions' || chr(10) || '- P0 · Clean — process' || chr(10) || chr(10) || '## Data to confirm' || chr(10) || '- pressure' WHEN 3 THEN 'No.' END AS text, CASE item_id % 5 WHEN 0 THEN CASE WHEN contains('B-10 B-20', 'B-' || item_id) THEN '' ELSE 'B-' || item_id END WHEN 3 THEN '' END AS loose FROM benchmark"""


def rerank_scores(spark, sf_dir):
    """Scores for three candidates in a reply: one out of range, one given twice, one with a half; some replies hold no JSON."""
    score = lambda x: x.cast("string")
    body = F.concat(F.lit('{"scores": [{"id": "P2", "score": '), score(_k() % 6), F.lit('}, {"id": "[p1]", "score": '), score(_k() % 4 + 0.5), F.lit('}, {"id": "P2", "score": '), score(_k() % 3), F.lit('}, {"id": "P9", "score": 3}]}'))
    raw = F.when(_k() % 7 == 0, "no json").when(_k() % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return table(spark, sf_dir, "events").select(E, F.array_join(F.transform(rules.rerank_scores(raw, F.lit(3)), lambda x: x.cast("string")), ",").alias("scores"))


RERANK = "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '0,0,0' ELSE least(3, event_id % 4 + 1) || ',' || event_id % 3 || ',0' END AS scores FROM events"

#: (kind of the failure, status, message, class): what a provider may answer.
FAILURES = (
    ("http", 429, "slow down", "rate_limited"), ("http", 429, "quota exceeded", "quota_exhausted"), ("Error", None, "Rate limit: tokens per minute", "rate_limited"), ("http", 401, "", "auth"),
    ("Error", None, "invalid api key", "auth"), ("http", 404, "", "model_unavailable"), ("Error", None, "maximum context length", "context_too_long"), ("http", 503, "", "provider_unavailable"),
    ("Error", None, "odd", "unknown"), ("Error", None, "Too many requests: tokens", "quota_exhausted"), ("TimeoutError", None, "took too long", "timeout"), ("AbortError", None, "stopped", "aborted"),
    ("TypeError", None, "x is undefined", "network"), ("Error", None, "fetch failed", "network"), ("other", None, "what", "unknown"),
)


def error_classes(spark, sf_dir):
    """A failure for every event, half of them of the local runtime."""
    found = F.get(F.array(*[F.struct(F.lit(a).alias("kind"), F.lit(b).cast("int").alias("status"), F.lit(c).alias("text")) for a, b, c, _ in FAILURES]), (_k() % len(FAILURES)).cast("int"))
    code = rules.failure_code(found["kind"], found["status"], found["text"], _k() % 2 == 0)
    return table(spark, sf_dir, "events").select(E, code.alias("code"), rules.retryable(code).alias("again"), rules.falls_back_to_local(code).alias("to_local"), rules.lowers_tier(code).alias("lower"), rules.falls_back_to_cloud(code).alias("to_cloud"))


ERRORS = (
    "SELECT event_id, code, code NOT IN ('auth', 'model_unavailable', 'context_too_long') AS again, code IN ('quota_exhausted', 'rate_limited', 'provider_unavailable', 'network') AS to_local, code IN ('quota_exhausted', 'rate_limited', 'provider_unavailable', 'network', 'model_unavailable') AS lower, "
    "code IN ('ollama_offline', 'model_unavailable', 'network') AS to_cloud FROM (SELECT event_id, CASE WHEN c = 'network' AND event_id % 2 = 0 THEN 'ollama_offline' ELSE c END AS code FROM (SELECT event_id, "
    + _sql_case(f"event_id % {len(FAILURES)}", [(i, f[3]) for i, f in enumerate(FAILURES)])
    + " AS c FROM events))"
)


def order_reasons(spark, sf_dir):
    """The first reason to refuse each order; what it lacks follows from its key."""
    k = F.col("o_orderkey")
    blank = lambda n, text: F.when(k % n == 0, F.lit(None).cast("string")).when(k % n == 1, "  ").otherwise(text)
    reason = rules.order_reason(_pick(k, ("duo", "seed", "bad", "duo")), ("duo", "seed"), F.when(k % 5 == 0, "gambling"), blank(3, "s"), blank(7, "chess"), blank(11, "x"))
    return table(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))


REASONS = """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 2 THEN 'kind_not_allowed' WHEN o_orderkey % 5 = 0 THEN 'gambling' WHEN o_orderkey % 4 = 1 AND o_orderkey % 3 < 2 THEN 'seed_required' WHEN o_orderkey % 7 < 2 THEN 'game_required' WHEN o_orderkey % 4 <> 1 AND o_orderkey % 11 < 2 THEN 'details_required' END AS reason FROM orders"""

# -- offers

KINDS = ("duo", "coach", "review")


def _prices(k):
    """duo for even keys, coach for every third, review for every fifth, and something else."""
    pairs = [("duo", k % 2 == 0, k % 50), ("coach", k % 3 == 0, k % 70), ("review", k % 5 == 0, k % 90), ("other", k % 1 == 0, k)]
    return F.map_from_entries(F.array_compact(F.array(*[F.when(test, F.struct(F.lit(name).alias("k"), price.alias("v"))) for name, test, price in pairs])))


def kind_lookup(spark, sf_dir):
    prices = _prices(F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", market.price(prices, F.lit("coach")).alias("price"), F.array_join(market.offered_kinds(prices, KINDS), ",").alias("offered"))


_OFFERED = "concat_ws(',', CASE WHEN {0} % 2 = 0 THEN 'duo' END, CASE WHEN {0} % 3 = 0 THEN 'coach' END, CASE WHEN {0} % 5 = 0 THEN 'review' END)"
KIND_LOOKUP = f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 70 END AS price, {_OFFERED.format('p_partkey')} AS offered FROM part"


def _streamers(spark, sf_dir):
    k = F.col("s_suppkey")
    offer = lambda n: F.struct(F.concat(F.lit("game "), (k + n) % 9).alias("game"), _prices(k + n).alias("kindPrices"))
    return table(spark, sf_dir, "supplier").select(k.alias("pos"), F.col("s_name").alias("id"), (k % 4 == 3).alias("live"), F.array(offer(0), offer(1), offer(2)).alias("offers"))


def offer_games(spark, sf_dir):
    """The games in which each supplier, as a streamer, prices a kind."""
    return _streamers(spark, sf_dir).select("id", F.array_join(market.offered_games(F.col("offers"), ("duo", "coach")), ",").alias("games"))


_ANY = "(({0}) % 2 = 0 OR ({0}) % 3 = 0)"
OFFER_GAMES = "SELECT s_name AS id, concat_ws(',', " + ", ".join(f"CASE WHEN {_ANY.format(f's_suppkey + {n}')} THEN 'game ' || (s_suppkey + {n}) % 9 END" for n in range(3)) + ") AS games FROM supplier"


def featured_offer(spark, sf_dir):
    return market.featured(_streamers(spark, sf_dir), ("coach", "duo"))


FEATURED = f"SELECT id, 'game ' || k % 9 AS game, CASE WHEN k % 3 = 0 THEN 'coach' ELSE 'duo' END AS kind FROM (SELECT s_name AS id, s_suppkey AS pos, s_suppkey % 4 = 3 AS live, n, s_suppkey + n AS k FROM supplier, range(3) r(n)) WHERE {_ANY.format('k')} ORDER BY live DESC, pos, n LIMIT 1"


def feed_months(spark, sf_dir):
    """How many events each month has, and the newest of them."""
    feed = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), F.col(E).cast("string").alias("title"))
    return market.by_month(feed, most=3).select("month", "n", F.array_join(F.transform("items", lambda x: x["title"]), ",").alias("newest"))


FEED_MONTHS = """SELECT month, count(*) AS n, string_agg(title, ',' ORDER BY rk) FILTER (WHERE rk <= 3) AS newest FROM (SELECT strftime(ts, '%Y-%m') AS month, CAST(event_id AS VARCHAR) AS title,
 row_number() OVER (PARTITION BY strftime(ts, '%Y-%m') ORDER BY CAST(ts AS DATE) DESC, CAST(event_id AS VARCHAR) DESC) AS rk FROM events) GROUP BY month"""


def rejoin_refund(spark, sf_dir):
    """What each customer gets back when all orders that still hold funds are cancelled."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("viewer"), F.when(F.col("o_orderstatus") == "O", "held").when(F.col("o_orderstatus") == "F", "released").otherwise("refunded").alias("funds"), F.col("o_totalprice").alias("price"))
    return market.refund_all(o, "viewer").select("viewer", F.round("refund", 2).alias("refund"), "cancelled")


REFUND = "SELECT o_custkey AS viewer, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS refund, count(*) FILTER (WHERE o_orderstatus = 'O') AS cancelled FROM orders GROUP BY o_custkey"

# -- traces


def _spans(spark, sf_dir):
    """Events as spans of seven runs: the first run is chains of a thousand, the others are trees of three to a node; some parents are missing."""
    run, j = _k() % 7, F.floor(_k() / 7)
    chain, branch = F.when(j % 1000 > 0, j - 1), F.when((j > 0) & (j % 41 > 0), F.floor((j - 1) / 3)).when(j > 0, -j)
    start = F.when(run == 0, j).otherwise((j * 7919) % 10007)
    return table(spark, sf_dir, "events").select(run.alias("run_id"), j.alias("span_id"), F.when(run == 0, chain).otherwise(branch).cast("long").alias("parent_id"), start.alias("started_at"), F.when(j % 5 > 0, start + j % 100).alias("ended_at"), F.when(j % 4 == 0, start + 10).alias("first_token_at"))


def trace_waterfall(spark, sf_dir):
    """All runs in the order of their trees, to any depth."""
    out = runlog.waterfall(_spans(spark, sf_dir))
    return out.select("run_id", "span_id", "depth", "pos", *[F.round(c, 4).alias(c) for c in ("offset_pct", "width_pct", "ttft_pct")])


_SPANS = """WITH RECURSIVE s AS (SELECT event_id % 7 AS run_id, event_id // 7 AS j, CASE WHEN event_id % 7 = 0 THEN event_id // 7 ELSE (event_id // 7 * 7919) % 10007 END AS started_at FROM events),
 t AS (SELECT run_id, j AS span_id, started_at, CASE WHEN run_id = 0 THEN CASE WHEN j % 1000 > 0 THEN j - 1 END WHEN j > 0 AND j % 41 > 0 THEN (j - 1) // 3 END AS up, CASE WHEN j % 5 > 0 THEN started_at + j % 100 END AS ended_at, CASE WHEN j % 4 = 0 THEN started_at + 10 END AS first_at FROM s),
 o AS (SELECT *, lpad(row_number() OVER (PARTITION BY run_id, up ORDER BY started_at, span_id)::VARCHAR, 8, '0') AS step, (coalesce(ended_at, started_at) - started_at)::DOUBLE AS took, min(started_at) OVER (PARTITION BY run_id) AS begun, greatest(max(coalesce(ended_at, started_at)) OVER (PARTITION BY run_id) - min(started_at) OVER (PARTITION BY run_id), 1)::DOUBLE AS span FROM t),
 walk AS (SELECT run_id, span_id, 0::BIGINT AS depth, step AS path FROM o WHERE up IS NULL UNION ALL SELECT o.run_id, o.span_id, w.depth + 1, w.path || '/' || o.step FROM o JOIN walk w ON o.run_id = w.run_id AND o.up = w.span_id)"""
WATERFALL = _SPANS + """
SELECT run_id, span_id, depth, row_number() OVER (PARTITION BY run_id ORDER BY path) AS pos, round((started_at - begun) * 100 / span, 4) AS offset_pct, round(took * 100 / span, 4) AS width_pct, round(CASE WHEN first_at IS NOT NULL AND took > 0 THEN least(100.0, (first_at - started_at) * 100 / took) END, 4) AS ttft_pct
FROM walk JOIN o USING (run_id, span_id)"""


def orphans_to_root(spark, sf_dir):
    """Spans with their parents, none where the parent is missing."""
    s = _spans(spark, sf_dir)
    there = s.select(F.col("run_id").alias("r"), F.col("span_id").alias("up"))
    return s.join(there, (F.col("run_id") == F.col("r")) & (F.col("parent_id") == F.col("up")), "left").select("run_id", "span_id", F.col("up").alias("parent"))


ORPHANS = "SELECT event_id % 7 AS run_id, event_id // 7 AS span_id, CASE WHEN event_id % 7 = 0 THEN CASE WHEN event_id // 7 % 1000 > 0 THEN event_id // 7 - 1 END WHEN event_id // 7 % 41 > 0 THEN (event_id // 7 - 1) // 3 END AS parent FROM events"


# -- folds and stores


def orders_apart(spark, sf_dir):
    """The order machine over all events, folded by composed tables; one customer in three is one key."""
    action = F.element_at(F.create_map(*[F.lit(x) for p in (("signup", "accept"), ("view", "start"), ("click", "complete"), ("purchase", "reject"), ("error", "cancel")) for x in p]), F.col("event_type"))
    key = F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id"))
    rows = table(spark, sf_dir, "events").select(key.cast("long").alias("user_id"), E, action.alias("action"), F.when(_k() % 2 == 0, "viewer").otherwise("streamer").alias("actor"))
    return folds.run_orders_apart(rows, "user_id", [E], "action", "actor")


ORDERS_APART = FSM.replace("SELECT user_id, CASE event_type", "SELECT CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, CASE event_type", 1).replace("OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events", "OVER (PARTITION BY CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END ORDER BY event_id) AS rn FROM events", 1)


def versioned_runs(spark, sf_dir):
    """Orders as runs and their lines as spans, committed together; every third order comes again with its first line only, and the batch is tried twice."""
    o, lines, path = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), shared_path(spark, "versions")
    runs = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    spans = lines.select(F.col("l_orderkey").alias("id"), "l_linenumber")
    again = {"runs": runs.where("id % 3 = 0").withColumn("status", F.lit("again")), "spans": spans.where("id % 3 = 0 and l_linenumber = 1")}
    for batch, part in ((0, {"runs": runs, "spans": spans}), (1, again), (1, again)):
        versioned.commit(path, part, "log", batch)
    held = versioned.read(spark, path, "runs")
    kept = versioned.latest(versioned.read(spark, path, "spans"), ["id"], held).groupBy("id").agg(F.count("*").alias("spans"))
    return versioned.latest(held, ["id"]).join(kept, "id", "left").select("id", "status", F.coalesce("spans", F.lit(0)).alias("spans"))


VERSIONED = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'again' ELSE o_orderstatus END AS status, count(l_linenumber) FILTER (WHERE o_orderkey % 3 > 0 OR l_linenumber = 1) AS spans FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"


def frame_source(spark, sf_dir):
    """Events written as frames and read back by the source of that format."""
    from ..sources import frames

    spark.dataSource.register(frames.EventFrames)
    path = shared_path(spark, "frames")
    stores.encode_events(table(spark, sf_dir, "events").select(E, "event_type", "value")).write.text(path)
    rows = spark.read.format("event_frames").load(path)
    return rows.select(F.from_json("data", "event_id long, event_type string, value double").alias("e")).select("e.*")


def results_once(spark, sf_dir):
    """What two tools found, told in one text for each order: lines that an earlier result showed are only named."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("row_pos"), F.struct(F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_returnflag").alias("flag")).alias("row"))
    both = lines.withColumn("result_pos", F.lit(0)).unionByName(lines.where("row_pos % 2 = 0 or run_id % 2 = 0").withColumn("result_pos", F.lit(1)).withColumn("row", F.col("row").withField("flag", F.when(F.col("run_id") % 5 == 0, "Z").otherwise(F.col("row.flag")))))
    return plans.told_once(both, ("id", "flag")).select("run_id", "result_pos", "text")


RESULTS_ONCE = """WITH a AS (SELECT l_orderkey AS run_id, 0 AS result_pos, l_linenumber AS n, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_returnflag AS flag FROM lineitem
  UNION ALL SELECT l_orderkey, 1, l_linenumber, l_linenumber || '-' || l_partkey || '-' || l_suppkey, CASE WHEN l_orderkey % 5 = 0 THEN 'Z' ELSE l_returnflag END FROM lineitem WHERE l_linenumber % 2 = 0 OR l_orderkey % 2 = 0),
 f AS (SELECT *, result_pos = min(result_pos) OVER (PARTITION BY run_id, id, flag) AS fresh FROM a),
 c AS (SELECT run_id, result_pos, count(*) FILTER (WHERE fresh) AS m, count(DISTINCT flag) FILTER (WHERE fresh) AS flags, min(flag) FILTER (WHERE fresh) AS flag0, string_agg(id || ' | ' || flag, chr(10) ORDER BY n, id) FILTER (WHERE fresh) AS full_, string_agg(id, chr(10) ORDER BY n, id) FILTER (WHERE fresh) AS ids, string_agg(id, ', ' ORDER BY n, id) FILTER (WHERE NOT fresh) AS seen FROM f GROUP BY ALL)
SELECT run_id, result_pos, concat_ws(chr(10), CASE WHEN m > 1 AND flags = 1 THEN 'same for all rows: flag=' || flag0 || chr(10) || 'id' || chr(10) || ids WHEN m > 0 THEN 'id | flag' || chr(10) || full_ END, CASE WHEN seen IS NOT NULL THEN 'also: ' || seen || ' (listed above)' END) AS text FROM c"""

# -- messages

# A small catalogue, with messages of every kind that it translates, or does not.
WORDS = {"限流": "rate limited", "密码": "password", "邮箱": "email", "本地不可用": "Local unavailable"}
PATTERNS = [(r"^输入过长（(\d+) 字）$", "Input too long ({1} characters)"), (r"^([^、]+)×(\d+)$", "{t1} ×{2}"), (r"^(.+)，已自动降级本地$", "{t1}; fell back to local"), (r"^([a-z_]+): (.+)$", "{1}: {t2}")]


def template_text(spark, sf_dir):
    """Messages with the number of every event, in English."""
    n = _k().cast("string")
    text = F.when(_k() % 8 == 0, "限流").when(_k() % 8 == 1, F.concat(F.lit("输入过长（"), n, F.lit(" 字）"))).when(_k() % 8 == 2, F.concat(F.lit("限流；输入过长（"), n, F.lit(" 字）"))).when(_k() % 8 == 3, F.concat(F.lit("密码×"), n, F.lit("、邮箱×2")))
    text = text.when(_k() % 8 == 4, "限流，已自动降级本地").when(_k() % 8 == 5, F.concat(F.lit("aborted: 本地不可用"))).when(_k() % 8 == 6, F.concat(F.lit("odd "), n, F.lit("、odd")))
    return table(spark, sf_dir, "events").select(E, templates.translated(text, WORDS, PATTERNS).alias("text"))


TEMPLATE_TEXT = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'rate limited' WHEN 1 THEN 'Input too long (' || event_id || ' characters)' WHEN 2 THEN 'rate limited; Input too long (' || event_id || ' characters)' WHEN 3 THEN 'password ×' || event_id || ', email ×2'
 WHEN 4 THEN 'rate limited; fell back to local' WHEN 5 THEN 'aborted: Local unavailable' WHEN 6 THEN 'odd ' || event_id || '、odd' END AS text FROM events"""

ROWS = {
    "template_text": (template_text, TEMPLATE_TEXT),
    "grounding_check": (grounding_check, GROUNDING),
    "zh_numeral": (zh_numeral, "SELECT event_id, CASE WHEN event_id % 102 BETWEEN 1 AND 99 THEN event_id % 102 END AS n FROM events"),
    "section_split": (section_split, SECTIONS),
    "usd_format": (usd_format, FORMATS),
    "plan_markdown": (plan_markdown, PLAN_MARKDOWN),
    "rerank_scores": (rerank_scores, RERANK),
    "error_classes": (error_classes, ERRORS),
    "order_reasons": (order_reasons, REASONS),
    "kind_lookup": (kind_lookup, KIND_LOOKUP),
    "offer_games": (offer_games, OFFER_GAMES),
    "featured_offer": (featured_offer, FEATURED),
    "feed_months": (feed_months, FEED_MONTHS),
    "rejoin_refund": (rejoin_refund, REFUND),
    "trace_waterfall": (trace_waterfall, WATERFALL),
    "orphans_to_root": (orphans_to_root, ORPHANS),
    "orders_apart": (orders_apart, ORDERS_APART),
    "versioned_runs": (versioned_runs, VERSIONED),
    "frame_source": (frame_source, "SELECT event_id, event_type, value FROM events"),
    "results_once": (results_once, RESULTS_ONCE),
}
