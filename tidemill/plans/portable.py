"""Relational queries in SQL that Spark and DuckDB read alike; ``@name`` stands for a table.

Each is planned by Catalyst as it stands: filters and columns reach the Parquet scan, aggregates combine before the
shuffle, and every limit has a unique order.
"""

PORTABLE: dict[str, str] = {
    # -- totals, trends and recent rows
    "kpi_summary": """
        SELECT count(*) AS n_orders, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open,
               count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AS n_urgent,
               floor(avg(o_totalprice) * 10 + 0.5E0) / 10.0E0 AS mean_price, max(o_orderdate) AS latest FROM @orders""",
    "daily_trend": """
        SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, floor(avg(o_totalprice) * 10 + 0.5E0) / 10.0E0 AS mean_price
        FROM @orders GROUP BY CAST(o_orderdate AS DATE)""",
    "band": """
        SELECT day, CASE WHEN mean_price < 150000 THEN 'low' WHEN mean_price < 250000 THEN 'warning' ELSE 'ok' END AS band,
               greatest(0.0E0, least(100.0E0, floor(mean_price / 5000 + 0.5E0))) AS width
        FROM (SELECT CAST(o_orderdate AS DATE) AS day, CAST(floor(avg(o_totalprice) * 10 + 0.5E0) / 10.0E0 AS DOUBLE) AS mean_price FROM @orders GROUP BY CAST(o_orderdate AS DATE)) t""",
    "recent_joined": """
        SELECT o_orderkey, o_orderdate, o_totalprice, c_name, c_mktsegment FROM @orders JOIN @customer ON o_custkey = c_custkey
        ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100""",
    "open_only": """
        SELECT o_orderkey, o_orderdate, o_orderpriority, c_name FROM @orders JOIN @customer ON o_custkey = c_custkey
        WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""",
    "point_lookup": """
        SELECT o_orderkey, o_custkey, o_totalprice, c_name FROM @orders JOIN @customer ON o_custkey = c_custkey WHERE o_orderkey = 42""",
    "foreign_key_filter": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM @lineitem WHERE l_orderkey = 42",
    "child_count": """
        SELECT o_orderkey, coalesce(n, 0) AS n_lines FROM @orders
        LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM @lineitem GROUP BY l_orderkey) c ON l_orderkey = o_orderkey""",
    "parent_with_children": """
        SELECT o_orderkey, o_orderstatus, coalesce(n, 0) AS n_lines, coalesce(quantity, 0.0E0) AS quantity, parts FROM @orders LEFT JOIN
          (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS quantity, min(l_partkey) AS parts FROM @lineitem GROUP BY l_orderkey) c ON l_orderkey = o_orderkey""",
    "retention_survivors": """
        SELECT user_id, event_id, ts FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM @events) t
        WHERE rn <= 20""",
    "retention_pruned": """
        SELECT e.event_id FROM @events e LEFT ANTI JOIN
          (SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM @events) t WHERE rn <= 20) k
          ON e.event_id = k.event_id""",
    "beyond_newest": "SELECT event_id, ts FROM @events ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 500",
    "latest_per_group": """
        SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT o_custkey, o_orderkey, o_orderdate,
          row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM @orders) t WHERE rn = 1""",
    "recent_feed": "SELECT event_id, ts, event_type, user_id FROM @events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 30",
    "lru_order": """
        SELECT user_id, last_seen, hits FROM (SELECT user_id, coalesce(max(ts) FILTER (WHERE event_type = 'click'), min(ts)) AS last_seen,
          count(*) FILTER (WHERE event_type = 'click') AS hits FROM @events GROUP BY user_id) t ORDER BY last_seen DESC, user_id LIMIT 100""",
    # -- run statistics
    "latency_percentiles": """
        SELECT event_type, count(*) AS n, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS DOUBLE) AS p50,
               CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS DOUBLE) AS p95 FROM @events WHERE event_type <> 'error' GROUP BY event_type""",
    "group_stats_by_type": """
        SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 100) AS n_large, round(avg(value), 6) AS mean_value, round(sum(value), 4) AS total
        FROM @events GROUP BY event_type""",
    "route_stats": """
        SELECT o_orderpriority AS route, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_done,
               CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS DOUBLE) AS p50 FROM @orders GROUP BY o_orderpriority""",
    "rates_dashboard": """
        SELECT count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT user_id) AS users,
               count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
               round(count(*) FILTER (WHERE event_type = 'error') * 1.0E0 / nullif(count(*), 0), 6) AS error_rate,
               round(sum(value) FILTER (WHERE event_type = 'purchase') / nullif(sum(value), 0), 6) AS purchase_share,
               round(count(*) FILTER (WHERE event_type = 'none') * 1.0E0 / nullif(count(*) FILTER (WHERE event_type = 'none'), 0), 6) AS empty_rate
        FROM @events""",
    "usage_savings": """
        SELECT l_returnflag, round(sum(l_extendedprice * l_discount), 2) AS saved, round(sum(l_extendedprice * (1 - l_discount)), 2) AS cost,
               round(sum(l_extendedprice * l_discount) / nullif(sum(l_extendedprice), 0), 6) AS savings_rate FROM @lineitem GROUP BY l_returnflag""",
    "cache_stats": """
        SELECT count(*) FILTER (WHERE event_type = 'click') AS hits,
               round(count(*) FILTER (WHERE event_type = 'click') * 1.0E0 / nullif(count(*) FILTER (WHERE event_type <> 'error'), 0), 6) AS hit_rate,
               CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN event_type = 'click' THEN value END) AS DOUBLE) AS hit_p50 FROM @events""",
    "tier_pivot": """
        SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal >= 5000) AS strong, count(*) FILTER (WHERE c_acctbal < 5000) AS standard,
               count(*) FILTER (WHERE c_acctbal < 0) AS negative FROM @customer GROUP BY c_mktsegment""",
    "mean_tokens": "SELECT lang, CAST(floor(avg(n_chars) + 0.5E0) AS BIGINT) AS mean_chars FROM @documents GROUP BY lang",
    "mode_with_tiebreak": """
        SELECT p_brand, p_size FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS rn FROM
          (SELECT p_brand, p_size, count(*) AS n FROM @part GROUP BY p_brand, p_size) a) b WHERE rn = 1""",
    "month_buckets": """
        SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, min(o_orderkey) AS first_key, round(sum(o_totalprice), 2) AS total
        FROM @orders GROUP BY year(o_orderdate), month(o_orderdate)""",
    "distinct_sorted": "SELECT DISTINCT source FROM @documents ORDER BY source",
    "held_counts": """
        SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS held, round(coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 0), 2) AS held_price
        FROM @orders GROUP BY o_custkey""",
    "supported_share": "SELECT toxic, coalesce(round(avg(CAST(quality AS DOUBLE)), 6), 1.0E0) AS share, count(*) AS n FROM @labels GROUP BY toxic",
    "rollup_stats": "SELECT event_type, user_id, count(*) AS n FROM @events GROUP BY ROLLUP (event_type, user_id)",
    "price_usage": """
        SELECT target, sum(n) AS calls, round(sum(cost), 4) AS cost, round(sum(saved), 4) AS saved FROM
          (SELECT CASE WHEN l_linestatus = 'O' THEN 'cloud' ELSE 'local' END AS target, 1 AS n,
                  CASE WHEN l_linestatus = 'O' THEN (l_quantity * 0.25E0 + l_extendedprice * 1.5E0) / 1000000 ELSE 0.0E0 END AS cost,
                  CASE WHEN l_linestatus = 'O' THEN 0.0E0 ELSE (l_quantity * 0.25E0 + l_extendedprice * 1.5E0) / 1000000 END AS saved FROM @lineitem) t GROUP BY target""",
    "gate": """
        SELECT passed, baseline, passed >= baseline - 0.15E0 AS pass_ok, safety = 1.0E0 AS safety_ok, passed >= baseline - 0.15E0 AND safety = 1.0E0 AS ok FROM
          (SELECT round(avg(CAST(quality AS DOUBLE)), 6) AS passed, round(avg(CASE WHEN doc_id % 2 = 0 THEN CAST(quality AS DOUBLE) END), 6) AS baseline,
                  round(avg(1.0E0 - CAST(toxic AS DOUBLE)), 6) AS safety FROM @labels) t""",
    "regressed_cases": """
        SELECT a.doc_id FROM @labels a JOIN @labels b ON b.doc_id = a.doc_id + 1 WHERE b.quality = 1 AND a.quality = 0""",
    # -- joins and set operations
    "semi_allowed_owner": """
        SELECT p_partkey, p_name FROM @part LEFT SEMI JOIN (SELECT l_partkey FROM @lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R') a ON p_partkey = l_partkey""",
    "enrich_skip_unknown": """
        SELECT e.event_id, l.label FROM @events e JOIN (SELECT 'click' AS kind, 'Click' AS label UNION ALL SELECT 'purchase', 'Purchase') l ON e.event_type = l.kind""",
    "enrich_or_key": """
        SELECT e.event_type, coalesce(l.label, e.event_type) AS label, count(*) AS n FROM @events e
        LEFT JOIN (SELECT 'click' AS kind, 'Click' AS label UNION ALL SELECT 'purchase', 'Purchase') l ON e.event_type = l.kind GROUP BY e.event_type, coalesce(l.label, e.event_type)""",
    "localized_or_source": """
        SELECT d.doc_id, coalesce(t.lang, d.lang) AS shown, t.doc_id IS NOT NULL AS translated FROM @documents d
        LEFT JOIN (SELECT doc_id, 'xx' AS lang FROM @documents WHERE doc_id % 3 = 0) t ON t.doc_id = d.doc_id""",
    "set_operations": """
        SELECT o_custkey AS k, 'both' AS part FROM @orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey, 'both' FROM @orders WHERE o_orderstatus = 'F'
        UNION ALL (SELECT c_custkey, 'none' FROM @customer EXCEPT SELECT o_custkey, 'none' FROM @orders)""",
    "incremental_missing": """
        SELECT d.doc_id, md5(d.text) AS hash FROM @documents d LEFT ANTI JOIN (SELECT md5(text) AS hash FROM @documents WHERE doc_id % 2 = 0) s ON md5(d.text) = s.hash""",
    "exact_dedup": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM @documents GROUP BY md5(text)",
    "inbox_dedup": """
        SELECT id, page_id FROM (SELECT substr(sha2(concat('site::', url), 256), 1, 16) AS id, page_id, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM @pages) t WHERE rn = 1""",
    "filter_relax": """
        SELECT doc_id, NOT any_hit AS relaxed FROM (SELECT doc_id, lang = 'fr' AND source = 'src1' AND n_chars > 200 AS hit FROM @documents) d
        CROSS JOIN (SELECT coalesce(bool_or(lang = 'fr' AND source = 'src1' AND n_chars > 200), false) AS any_hit FROM @documents) a WHERE hit OR NOT any_hit""",
    "filter_relaxed_away": """
        SELECT doc_id, NOT any_hit AS relaxed FROM (SELECT doc_id, lang = 'xx' AS hit FROM @documents) d
        CROSS JOIN (SELECT coalesce(bool_or(lang = 'xx'), false) AS any_hit FROM @documents) a WHERE hit OR NOT any_hit""",
    "prefix_complete": "SELECT p_partkey, p_name FROM @part WHERE startswith(lower(p_name), lower('PART#0000')) OR startswith(lower(p_name), 'a')",
    "evict_two_keys": """
        SELECT e.event_id FROM @events e LEFT ANTI JOIN (SELECT user_id, event_type FROM @events WHERE value > 400 AND event_type = 'purchase') x
        ON e.user_id = x.user_id AND e.event_type = x.event_type""",
    "hit_counter": "SELECT user_id, count(*) AS hits, max(ts) AS last_hit_at FROM @events WHERE event_type = 'click' GROUP BY user_id",
    # -- order rules, deadlines
    "first_fail_reason": """
        SELECT o_orderkey, CASE WHEN o_totalprice <= 0 THEN 'empty' WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderpriority = '5-LOW' THEN 'low_priority'
          WHEN o_totalprice > 300000 THEN 'too_expensive' END AS reason FROM @orders""",
    "run_status": """
        SELECT event_id, CASE WHEN event_type = 'error' AND value > 50 THEN 'blocked' WHEN event_type = 'error' THEN 'aborted' WHEN value < 1 THEN 'error' ELSE 'ok' END AS status,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 'strong' WHEN event_type = 'error' THEN NULL ELSE 'standard' END AS tier FROM @events""",
    "sla_overdue": """
        SELECT o_orderkey, o_orderdate + INTERVAL '15' MINUTE AS accept_by,
               CASE WHEN o_orderstatus = 'O' AND o_orderdate + INTERVAL '15' MINUTE <= TIMESTAMP '1997-01-01 00:00:00' THEN 'cancel' END AS action FROM @orders""",
    "order_funds": """
        SELECT o_orderkey, status, CASE WHEN status = 'completed' THEN 'released' WHEN status IN ('rejected', 'cancelled') THEN 'refunded' ELSE 'held' END AS funds,
               status IN ('pending_accept', 'accepted') AS viewer_can_cancel, status IN ('accepted', 'in_progress') AS streamer_can_abort FROM
          (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'pending_accept' WHEN '2-HIGH' THEN 'accepted' WHEN '3-MEDIUM' THEN 'in_progress'
             WHEN '4-NOT SPECIFIED' THEN 'completed' ELSE 'rejected' END AS status FROM @orders) t""",
    # -- event folds and windows
    "event_fold": """
        SELECT user_id, count(*) AS n, min(ts) AS started, max(ts) AS ended, min(ts) FILTER (WHERE event_type = 'click') AS first_click,
               coalesce(max(event_id) FILTER (WHERE event_type = 'click') > max(event_id) FILTER (WHERE event_type = 'error'), true) AS recovered,
               count(*) FILTER (WHERE event_type = 'error') AS errors FROM @events GROUP BY user_id""",
    "window_share": """
        SELECT event_id, round(CASE WHEN b = a THEN 0.0E0 ELSE (t - a) * 100.0E0 / (b - a) END, 4) AS offset_pct FROM (SELECT event_id, CAST(event_id AS DOUBLE) AS t,
          CAST(min(event_id) OVER (PARTITION BY user_id) AS DOUBLE) AS a, CAST(max(event_id) OVER (PARTITION BY user_id) AS DOUBLE) AS b FROM @events) x""",
    "cooldown_flag": """
        SELECT event_id, coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER
          (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '5' MINUTE PRECEDING AND CURRENT ROW), 0) = 1 AS cooling FROM @events""",
    "funnel_steps": """
        SELECT user_id, min(ts) FILTER (WHERE event_type = 'view') AS viewed, min(ts) FILTER (WHERE event_type = 'click') AS clicked,
               min(ts) FILTER (WHERE event_type = 'purchase') AS purchased FROM @events GROUP BY user_id""",
    "history_trim": """
        SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER w AS rn, sum(length(text)) OVER w AS size FROM @conversations
          WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) t
        WHERE rn <= 12 AND size <= 16000""",
    "dedupe_key": """
        SELECT conv_id, turn, pos FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM
          (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, replace(replace(lower(text), ' ', ''), chr(10), '') ORDER BY turn) AS rn FROM @conversations) a WHERE rn = 1) b
        WHERE pos <= 5""",
    "trace_rollup": """
        SELECT user_id, count(*) AS spans, count(*) FILTER (WHERE event_type = 'purchase') AS generations, count(*) FILTER (WHERE event_type = 'error') AS errors,
               round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS cost, max(event_id) - min(event_id) AS width FROM @events GROUP BY user_id""",
    # -- retrieval metrics on given ranks
    "maxpool_groups": """
        SELECT label, vec_id, row_number() OVER (ORDER BY best DESC, vec_id) AS rk FROM (SELECT label, vec_id, element_at(embedding, 1) AS best,
          row_number() OVER (PARTITION BY label ORDER BY element_at(embedding, 1) DESC, vec_id) AS rn FROM @embeddings) a WHERE rn = 1""",
    "rerank_cut": """
        SELECT doc_id, relevance FROM (SELECT d.doc_id, coalesce(l.quality * 2 + (1 - l.toxic), 0) AS relevance, d.n_chars FROM
          (SELECT doc_id, n_chars FROM @documents ORDER BY n_chars DESC, doc_id LIMIT 8) d LEFT JOIN @labels l ON l.doc_id = d.doc_id) t
        WHERE relevance >= 1 ORDER BY relevance DESC, n_chars DESC, doc_id LIMIT 3""",
    "ir_metrics": """
        SELECT lang, max(CASE WHEN rk = 1 THEN rel ELSE 0 END) AS hit1, round(sum(CASE WHEN rk <= 3 THEN rel ELSE 0 END) * 1.0E0 / nullif(max(total), 0), 6) AS r3,
               round(coalesce(1.0E0 / min(CASE WHEN rel = 1 AND rk <= 10 THEN rk END), 0), 6) AS rr,
               round(sum(CASE WHEN rk <= 5 AND rel = 1 THEN ln(2) / ln(rk + 1) ELSE 0 END) / nullif(sum(CASE WHEN rk <= least(5, total) THEN ln(2) / ln(rk + 1) ELSE 0 END), 0), 6) AS ndcg5 FROM
          (SELECT d.lang, l.quality AS rel, row_number() OVER (PARTITION BY d.lang ORDER BY d.n_chars DESC, d.doc_id) AS rk, sum(l.quality) OVER (PARTITION BY d.lang) AS total
           FROM @documents d JOIN @labels l ON l.doc_id = d.doc_id) t GROUP BY lang""",
    "ir_by_category": """
        SELECT source, round(avg(CASE WHEN lang = 'en' THEN quality * 1.0E0 END), 6) AS en, round(avg(CASE WHEN lang = 'de' THEN quality * 1.0E0 END), 6) AS de,
               round(avg(CASE WHEN lang = 'fr' THEN quality * 1.0E0 END), 6) AS fr FROM @documents d JOIN @labels l ON l.doc_id = d.doc_id GROUP BY source""",
}
