"""Statements of the dialect over the event view, each with the same question in the oracle's SQL.

A statement is (name, text for the engine, text for the oracle); where the oracle's is None both read the same text. `ev` is the event view.
"""

from __future__ import annotations

ORACLE_VIEW = """WITH ev AS (SELECT event_id, 'tenant_' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS tenant_id, user_id, epoch_us(ts) AS event_time, event_type, props AS payload, strftime(ts, '%Y%m%d') AS partition_key, value, ts FROM events) """

STATEMENTS: list[tuple[str, str, str | None]] = [
    # filters
    ("q_eq", "SELECT event_id, event_type FROM ev WHERE event_type = 'click'", None),
    ("q_ne", "SELECT event_id, event_type FROM ev WHERE event_type <> 'click' AND user_id != 7", None),
    ("q_range", "SELECT event_id, value FROM ev WHERE value >= 10 AND value < 50 AND user_id > 5 AND user_id <= 90", None),
    ("q_and_or_not", "SELECT event_id FROM ev WHERE (event_type = 'view' OR user_id = 3) AND NOT tenant_id = 'tenant_01'", None),
    ("q_in", "SELECT event_id, user_id FROM ev WHERE user_id IN (1, 2, 3, 50) AND event_type IN ('click', 'signup')", None),
    ("q_not_in", "SELECT event_id FROM ev WHERE event_type NOT IN ('click', 'view')", None),
    ("q_between", "SELECT event_id, user_id FROM ev WHERE user_id BETWEEN 10 AND 20", None),
    ("q_not_between", "SELECT event_id, user_id FROM ev WHERE user_id NOT BETWEEN 10 AND 20", None),
    ("q_like_ci", "SELECT event_id, event_type FROM ev WHERE event_type LIKE 'CL%'", "SELECT event_id, event_type FROM ev WHERE event_type ILIKE 'CL%'"),
    ("q_not_like", "SELECT event_id, event_type FROM ev WHERE event_type NOT LIKE '%I%'", "SELECT event_id, event_type FROM ev WHERE event_type NOT ILIKE '%I%'"),
    ("q_is_null", "SELECT event_id FROM ev WHERE nullif(event_type, 'error') IS NULL", None),
    ("q_is_not_null", "SELECT event_id FROM ev WHERE nullif(event_type, 'error') IS NOT NULL", None),
    ("q_arith", "SELECT event_id, user_id * 2 + 1 AS a, user_id - 100 AS b, value * 2.0 AS c FROM ev WHERE user_id + 1 < 40", "SELECT event_id, user_id * 2 + 1 AS a, user_id - 100 AS b, value * CAST(2 AS DOUBLE) AS c FROM ev WHERE user_id + 1 < 40"),
    ("q_unary_minus", "SELECT event_id, -user_id AS m FROM ev WHERE -user_id < -100", None),
    ("q_int_div", "SELECT event_id, int_div(user_id, 7) AS q, int_div(user_id, user_id - user_id) AS z FROM ev", "SELECT event_id, user_id // 7 AS q, CAST(NULL AS BIGINT) AS z FROM ev"),
    ("q_precedence", "SELECT event_id FROM ev WHERE event_type = 'view' OR event_type = 'click' AND user_id < 20", None),
    # projections
    ("q_star", "SELECT * FROM ev", None),
    ("q_qualified_star", "SELECT e.* FROM ev AS e", None),
    ("q_alias", "SELECT e.user_id AS uid, e.event_type kind FROM ev e", None),
    ("q_distinct", "SELECT DISTINCT tenant_id, event_type FROM ev", None),
    ("q_literal_escape", "SELECT event_id, 'it''s' AS s, 'a\\b' AS b FROM ev", None),
    ("q_no_from", "SELECT 1 AS one, 'x' AS x, CAST(NULL AS INT) AS n", "SELECT 1 AS one, 'x' AS x, CAST(NULL AS INT) AS n"),
    # aggregates
    ("q_count_star", "SELECT COUNT(*) AS count FROM ev", None),
    ("q_count_col", "SELECT COUNT(nullif(event_type, 'view')) AS n FROM ev", None),
    ("q_sum", "SELECT SUM(user_id) AS s, ROUND(SUM(value), 4) AS v FROM ev", "SELECT CAST(SUM(user_id) AS BIGINT) AS s, ROUND(SUM(value), 4) AS v FROM ev"),
    ("q_sum_large", "SELECT SUM(event_time - 1704067200000000) AS s FROM ev", "SELECT CAST(SUM(event_time - 1704067200000000) AS BIGINT) AS s FROM ev"),
    ("q_avg", "SELECT ROUND(AVG(value), 6) AS a, AVG(user_id) AS u FROM ev", None),
    ("q_min", "SELECT MIN(event_time) AS t, MIN(event_type) AS k, MIN(value) AS v FROM ev", None),
    ("q_max", "SELECT MAX(event_time) AS t, MAX(event_type) AS k, MAX(value) AS v FROM ev", None),
    ("q_count_distinct", "SELECT COUNT(DISTINCT user_id) AS u, COUNT(DISTINCT event_type) AS k FROM ev", None),
    ("q_sum_distinct", "SELECT SUM(DISTINCT user_id) AS s, AVG(DISTINCT user_id) AS a FROM ev", "SELECT CAST(SUM(DISTINCT user_id) AS BIGINT) AS s, AVG(DISTINCT user_id) AS a FROM ev"),
    ("q_agg_expr", "SELECT ROUND(SUM(value * user_id), 2) AS s, MAX(user_id + 1) AS m FROM ev", None),
    ("q_expr_over_agg", "SELECT event_type, ROUND(SUM(value) / COUNT(*), 6) AS r FROM ev GROUP BY event_type", None),
    ("q_empty_agg", "SELECT COUNT(*) AS n, SUM(user_id) AS s, AVG(value) AS a FROM ev WHERE tenant_id = 'nobody'", "SELECT COUNT(*) AS n, CAST(SUM(user_id) AS BIGINT) AS s, AVG(value) AS a FROM ev WHERE tenant_id = 'nobody'"),
    ("q_group_by", "SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS v FROM ev GROUP BY event_type", None),
    ("q_group_multi", "SELECT tenant_id, event_type, COUNT(*) AS n FROM ev GROUP BY tenant_id, event_type", None),
    ("q_group_expr", "SELECT user_id % 3 AS r, COUNT(*) AS n FROM ev GROUP BY user_id % 3", None),
    ("q_group_null", "SELECT nullif(event_type, 'view') AS k, COUNT(*) AS n FROM ev GROUP BY nullif(event_type, 'view')", None),
    ("q_group_keys", "SELECT tenant_id FROM ev GROUP BY tenant_id", None),
    ("q_group_json", "SELECT json_extract(payload, '$.k') AS k, COUNT(*) AS n FROM ev GROUP BY json_extract(payload, '$.k')", "SELECT json_extract_string(payload, '$.k') AS k, COUNT(*) AS n FROM ev GROUP BY 1"),
    ("q_having", "SELECT user_id, COUNT(*) AS n FROM ev GROUP BY user_id HAVING COUNT(*) > 60 AND SUM(value) > 0", None),
    ("q_total", "SELECT event_type, ROUND(total(value), 4) AS t FROM ev GROUP BY event_type", "SELECT event_type, ROUND(COALESCE(SUM(value), 0), 4) AS t FROM ev GROUP BY event_type"),
    # order and limit
    ("q_order_asc", "SELECT event_id, nullif(event_type, 'view') AS k FROM ev ORDER BY k, event_id", "SELECT event_id, nullif(event_type, 'view') AS k FROM ev ORDER BY k ASC NULLS FIRST, event_id"),
    ("q_order_multi", "SELECT tenant_id, user_id, event_id FROM ev ORDER BY tenant_id DESC, user_id, event_id DESC", None),
    ("q_topn", "SELECT event_id, value FROM ev ORDER BY value DESC, event_id LIMIT 20", None),
    ("q_limit_offset", "SELECT event_id FROM ev ORDER BY event_id LIMIT 10 OFFSET 25", None),
    ("q_offset_only", "SELECT event_id FROM ev ORDER BY event_id OFFSET 100", None),
    ("q_limit_only", "SELECT COUNT(*) AS n FROM (SELECT event_id FROM ev LIMIT 7) AS t", None),
    ("q_order_nonprojected", "SELECT event_id FROM ev ORDER BY user_id DESC, event_id", None),
    # functions
    ("q_json_extract", "SELECT event_id, CAST(json_extract(payload, '$.k') AS BIGINT) AS k, json_valid(payload) AS ok FROM ev", "SELECT event_id, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k, json_valid(payload) AS ok FROM ev"),
    ("q_json_build", "SELECT event_id, json_array(user_id, 1) AS a, json_object('u', user_id) AS o FROM ev", "SELECT event_id, '[' || user_id || ',1]' AS a, '{\"u\":' || user_id || '}' AS o FROM ev"),
    ("q_json_shape", "SELECT event_id, json_type(payload) AS t, json_type(payload, '$.k') AS k, json_type(payload, '$.none') AS x, json_array_length(json_array(user_id, 1, 2)) AS n, typeof(user_id) AS u, typeof(event_type) AS e FROM ev", "SELECT event_id, lower(json_type(payload)) AS t, CASE WHEN json_type(payload, '$.k') IN ('UBIGINT', 'BIGINT') THEN 'integer' END AS k, json_type(payload, '$.none') AS x, CAST(3 AS INTEGER) AS n, 'integer' AS u, 'text' AS e FROM ev"),
    ("q_strftime", "SELECT event_id, strftime('%Y-%m-%d %H:%M:%S', ts) AS s, date(ts) AS d, time(ts) AS t, unixepoch(ts) AS u FROM ev", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS t, CAST(floor(epoch(ts)) AS BIGINT) AS u FROM ev"),
    ("q_date_group", "SELECT strftime('%Y%m%d', ts) AS day, COUNT(*) AS n FROM ev GROUP BY strftime('%Y%m%d', ts)", "SELECT strftime(ts, '%Y%m%d') AS day, COUNT(*) AS n FROM ev GROUP BY 1"),
    ("q_substr_upper", "SELECT event_id, upper(substr(event_type, 1, 3)) AS a, lower(event_type) AS b, length(event_type) AS c, instr(event_type, 'i') AS d, replace(event_type, 'e', '_') AS e, trim('  x ') AS f FROM ev", "SELECT event_id, upper(substr(event_type, 1, 3)) AS a, lower(event_type) AS b, CAST(length(event_type) AS INTEGER) AS c, CAST(instr(event_type, 'i') AS INTEGER) AS d, replace(event_type, 'e', '_') AS e, trim('  x ') AS f FROM ev"),
    ("q_coalesce", "SELECT event_id, coalesce(nullif(event_type, 'view'), 'none') AS a, ifnull(nullif(user_id, 3), -1) AS b, iif(user_id > 50, 'high', 'low') AS c FROM ev", "SELECT event_id, coalesce(nullif(event_type, 'view'), 'none') AS a, coalesce(nullif(user_id, 3), -1) AS b, CASE WHEN user_id > 50 THEN 'high' ELSE 'low' END AS c FROM ev"),
    ("q_round_abs", "SELECT event_id, round(value, 1) AS a, abs(user_id - 50) AS b, CAST(ceil(value) AS BIGINT) AS c, CAST(floor(value) AS BIGINT) AS d FROM ev", None),
    ("q_math", "SELECT user_id, round(sqrt(user_id + 1.0), 6) AS a, round(ln(user_id + 1.0), 6) AS b, round(log(user_id + 1.0), 6) AS c, round(exp(user_id / 1000.0), 6) AS d FROM ev GROUP BY user_id", "SELECT user_id, round(sqrt(user_id + 1.0), 6) AS a, round(ln(user_id + 1.0), 6) AS b, round(log10(user_id + 1.0), 6) AS c, round(exp(user_id / 1000.0), 6) AS d FROM ev GROUP BY user_id"),
    ("q_glob", "SELECT event_id, glob('c*k', event_type) AS g, like('CL%', event_type) AS l FROM ev", "SELECT event_id, event_type GLOB 'c*k' AS g, event_type ILIKE 'CL%' AS l FROM ev"),
    ("q_text", "SELECT event_id, printf('%s-%d', event_type, user_id) AS p, quote(event_type) AS q, unicode(event_type) AS u, char(65, 66) AS c, hex('ab') AS h FROM ev", "SELECT event_id, event_type || '-' || user_id AS p, chr(39) || event_type || chr(39) AS q, CAST(unicode(event_type) AS INTEGER) AS u, 'AB' AS c, '6162' AS h FROM ev"),
    # scenarios
    ("s_ecommerce", "SELECT tenant_id, COUNT(*) AS purchases, ROUND(SUM(value), 4) AS revenue, ROUND(AVG(value), 6) AS mean FROM ev WHERE event_type = 'purchase' GROUP BY tenant_id", None),
    ("s_iot", "SELECT user_id, COUNT(*) AS n, ROUND(AVG(value), 6) AS mean, MIN(value) AS low, MAX(value) AS high FROM ev WHERE partition_key BETWEEN '20240105' AND '20240112' GROUP BY user_id HAVING MAX(value) > 10", None),
    ("s_saas", "SELECT tenant_id, COUNT(DISTINCT user_id) AS active, COUNT(*) AS n FROM ev WHERE event_type IN ('view', 'click') GROUP BY tenant_id ORDER BY active DESC, tenant_id LIMIT 10", None),
    ("s_gaming", "SELECT user_id, ROUND(SUM(value), 4) AS score FROM ev GROUP BY user_id ORDER BY score DESC, user_id LIMIT 10", None),
    ("s_finance", "SELECT user_id, COUNT(*) AS n, MAX(value) AS largest FROM ev WHERE event_type = 'purchase' AND value > 100 GROUP BY user_id HAVING COUNT(*) >= 2", None),
    ("s_logs", "SELECT partition_key, COUNT(*) AS errors FROM ev WHERE event_type = 'error' GROUP BY partition_key ORDER BY partition_key", None),
    ("s_session_analysis", "SELECT user_id, partition_key, COUNT(*) AS events, MAX(event_time) - MIN(event_time) AS span FROM ev GROUP BY user_id, partition_key HAVING COUNT(*) > 1", None),
    # more than the event store's own dialect
    ("x_join", "SELECT n.n_name, COUNT(*) AS n, ROUND(SUM(o.o_totalprice), 2) AS s FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", None),
    ("x_union", "SELECT user_id FROM ev WHERE event_type = 'purchase' UNION SELECT user_id FROM ev WHERE event_type = 'error'", None),
    ("x_window", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_time, event_id) AS r FROM ev", None),
    ("x_pricing", "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"),
]
