"""DuckDB oracle SQL for the catalog (same column names and types).

Views ``region nation customer supplier part orders lineitem events documents
embeddings pages benchmark labels conversations`` are assumed registered.
Entries missing here are checked on row counts only (non-SQL operators).
"""

from __future__ import annotations

from statistics import NormalDist

_DAY = "CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER)"
_M = "DECIMAL(18,2)"

# Goodman critical value for the five event types of the test data
# (c = z(1 - 0.05 / (2k))^2 with k = 5).
_GOODMAN_K = 5
_GOODMAN_C = repr(NormalDist().inv_cdf(1.0 - 0.05 / (2.0 * _GOODMAN_K)) ** 2)

_PIVOT_SUM = f"""
SELECT user_id,
  CAST(coalesce(sum(CASE WHEN event_type='click' THEN CAST(value AS {_M}) END), 0) AS {_M}) AS v_click,
  CAST(coalesce(sum(CASE WHEN event_type='error' THEN CAST(value AS {_M}) END), 0) AS {_M}) AS v_error,
  CAST(coalesce(sum(CASE WHEN event_type='purchase' THEN CAST(value AS {_M}) END), 0) AS {_M}) AS v_purchase,
  CAST(coalesce(sum(CASE WHEN event_type='signup' THEN CAST(value AS {_M}) END), 0) AS {_M}) AS v_signup,
  CAST(coalesce(sum(CASE WHEN event_type='view' THEN CAST(value AS {_M}) END), 0) AS {_M}) AS v_view
FROM events GROUP BY user_id"""

_KDE = """
WITH p AS (SELECT event_type, count(*) AS n, stddev_samp(value) AS sd FROM events
           WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 AND stddev_samp(value) > 0),
h AS (SELECT event_type, n, sd * pow(n, -0.2) AS h FROM p),
mx AS (SELECT max(value) AS m FROM events WHERE value IS NOT NULL),
g AS (SELECT range AS grid_i FROM range(0, 300)),
pts AS (SELECT event_type, value, count(*) AS w FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
k AS (SELECT h.event_type, g.grid_i,
        sum(pts.w * (exp(-((0.0 + g.grid_i * ((mx.m - 0.0) / 299) - pts.value)
                          * (0.0 + g.grid_i * ((mx.m - 0.0) / 299) - pts.value))
                     / (2.0 * h.h * h.h)) / sqrt(2 * pi()))) AS ksum
      FROM h JOIN pts ON h.event_type = pts.event_type CROSS JOIN g CROSS JOIN mx
      GROUP BY 1, 2),
kd AS (SELECT k.event_type, CAST(k.grid_i AS INTEGER) AS grid_i,
         round(0.0 + k.grid_i * ((mx.m - 0.0) / 299), 4) AS x,
         round(k.ksum / (h.n * h.h), 8) AS density
       FROM k JOIN h ON k.event_type = h.event_type CROSS JOIN mx)
"""

ORACLES: dict[str, str] = {
    "one_hot_status_summary": f"""
SELECT o_orderpriority, count(*) AS n_orders,
  round(avg(CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END), 6) AS rate_F,
  round(avg(CASE WHEN o_orderstatus='O' THEN 1 ELSE 0 END), 6) AS rate_O,
  round(avg(CASE WHEN o_orderstatus='P' THEN 1 ELSE 0 END), 6) AS rate_P,
  CAST(sum(CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END) AS BIGINT) AS n_F,
  CAST(sum(CASE WHEN o_orderstatus='O' THEN 1 ELSE 0 END) AS BIGINT) AS n_O,
  CAST(sum(CASE WHEN o_orderstatus='P' THEN 1 ELSE 0 END) AS BIGINT) AS n_P,
  round(avg(o_totalprice), 6) AS avg_price,
  CAST(sum(CAST(o_totalprice AS {_M})) AS {_M}) AS sum_price
FROM orders GROUP BY o_orderpriority""",

    "category_stats": """
SELECT event_type, count(*) AS value_n, round(avg(value), 6) AS value_mean,
  round(stddev_samp(value), 6) AS value_sd, round(median(value), 6) AS value_median
FROM events GROUP BY event_type""",

    "null_aware_share": """
SELECT l_linestatus, count(*) AS n_lines, CAST(count_if(l_returnflag <> 'N') AS BIGINT) AS n_returned,
  round(avg(CASE WHEN l_returnflag <> 'N' THEN CAST(l_returnflag = 'R' AS DOUBLE) END), 6) AS share_R,
  round(avg(CASE WHEN l_returnflag <> 'N' THEN CAST(l_returnflag = 'A' AS DOUBLE) END), 6) AS share_A
FROM lineitem GROUP BY l_linestatus""",

    "winner_join_rate": """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey
             ORDER BY o_totalprice DESC, o_orderkey ASC) AS rn FROM orders),
w AS (SELECT o_custkey, o_orderkey AS w_orderkey FROM r WHERE rn = 1)
SELECT o.o_orderpriority, count(*) AS n_orders,
  CAST(count_if(w.w_orderkey IS NOT NULL) AS BIGINT) AS n_wins,
  round(avg(CASE WHEN w.w_orderkey IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS win_rate,
  round((SELECT count(DISTINCT o_custkey) FROM orders) / (SELECT count(*) FROM orders), 6) AS baseline_rate
FROM orders o LEFT JOIN w ON o.o_custkey = w.o_custkey AND o.o_orderkey = w.w_orderkey
GROUP BY o.o_orderpriority""",

    "spine_running_total": f"""
WITH f AS (SELECT user_id, {_DAY} AS day, CAST(value AS {_M}) AS v FROM events
           WHERE event_type = 'purchase'),
u AS (SELECT DISTINCT user_id FROM f),
n AS (SELECT max({_DAY}) AS last FROM events),
s AS (SELECT u.user_id, CAST(unnest(range(0, n.last + 1)) AS INTEGER) AS day FROM u, n),
p AS (SELECT user_id, day, sum(v) AS v FROM f GROUP BY 1, 2)
SELECT s.user_id, s.day, CAST(coalesce(p.v, 0) AS {_M}) AS day_value,
  CAST(sum(coalesce(p.v, 0)) OVER (PARTITION BY s.user_id ORDER BY s.day
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {_M}) AS running_value
FROM s LEFT JOIN p ON s.user_id = p.user_id AND s.day = p.day""",

    "interval_explode": """
SELECT o_custkey, CAST(o_orderdate AS DATE) + CAST(r.range AS INTEGER) AS day,
  max(o_totalprice) AS max_price, count(*) AS n_active
FROM orders CROSS JOIN range(0, 6) r GROUP BY 1, 2""",

    "locf_state": """
SELECT event_id, user_id,
  last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (
    PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase_id
FROM events""",

    "chosen_completed_intervals": f"""
WITH e AS (SELECT user_id, event_id, ts, event_type, {_DAY} AS day,
             CAST(floor(value) AS INTEGER) AS grid FROM events
           WHERE event_type IN ('signup', 'click', 'purchase')),
s AS (SELECT *, last_value(CASE WHEN event_type IN ('signup', 'click') THEN day END IGNORE NULLS)
                  OVER w AS st,
             max(CASE WHEN event_type = 'purchase' THEN grid END) OVER w AS g
      FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, coalesce(st, 0) AS start_turn, day AS end_turn,
  day - coalesce(st, 0) + 1 AS duration, g AS grid_at_start
FROM s WHERE event_type = 'purchase'""",

    "buffered_event_groups": """
WITH e AS (SELECT user_id, event_id, ts, event_type, value FROM events
           WHERE event_type IN ('view', 'purchase')),
n AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (
        PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        - CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS event_no FROM e),
v AS (SELECT user_id, event_no, event_id AS view_id,
        row_number() OVER (PARTITION BY user_id, event_no ORDER BY ts, event_id) AS slot
      FROM n WHERE event_type = 'view'),
p AS (SELECT user_id, event_no, event_id AS purchase_id,
        CASE WHEN value >= 25 THEN 2 ELSE 1 END AS take FROM n WHERE event_type = 'purchase')
SELECT p.user_id, CAST(p.event_no AS BIGINT) AS event_no, p.purchase_id, v.view_id,
  CAST(v.slot AS BIGINT) AS slot
FROM p JOIN v ON p.user_id = v.user_id AND p.event_no = v.event_no
WHERE v.slot <= p.take""",

    "pick_order": """
SELECT event_id, user_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pick_order
FROM events""",

    "waiting_time": """
SELECT event_id, user_id,
  round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id))
        / 1e6, 6) AS wait_sec
FROM events""",

    "next_state": """
SELECT event_id, user_id, event_type,
  lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type
FROM events""",

    "first_per_group": """
SELECT o_custkey, o_orderkey AS first_o_orderkey, o_orderdate AS first_o_orderdate,
  o_totalprice AS first_o_totalprice
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
      FROM orders) t WHERE rn = 1""",

    "last_per_group": """
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders o
WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders o2 WHERE o2.o_custkey = o.o_custkey)""",

    "top_k_per_group": f"""
WITH g AS (SELECT l_suppkey, l_partkey,
             CAST(sum(CAST(l_extendedprice AS {_M}) * (1 - CAST(l_discount AS {_M})))
                  AS DECIMAL(18,4)) AS revenue
           FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, "rank", l_partkey, revenue FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY revenue DESC, l_partkey) AS "rank"
  FROM g) t WHERE "rank" <= 3""",

    "tie_averaged_rank": f"""
WITH per AS (SELECT s_nationkey, count(*) AS n_suppliers,
               sum(CAST(s_acctbal AS {_M})) AS acct FROM supplier GROUP BY 1),
j AS (SELECT n_regionkey, n_nationkey, coalesce(n_suppliers, 0) AS n_suppliers,
        coalesce(acct, 0) AS acct FROM nation LEFT JOIN per ON n_nationkey = s_nationkey),
d AS (SELECT *, (n_suppliers = 0 OR acct < 0) AS is_dead FROM j),
p AS (SELECT *, count(*) OVER (PARTITION BY n_regionkey) AS n,
        row_number() OVER (PARTITION BY n_regionkey, is_dead ORDER BY acct ASC, n_nationkey) AS pd,
        row_number() OVER (PARTITION BY n_regionkey, is_dead
                           ORDER BY n_suppliers DESC, n_nationkey) AS pa FROM d),
r AS (SELECT *, CASE WHEN is_dead THEN n - pd + 1 ELSE pa END AS raw,
        CASE WHEN is_dead THEN CAST(acct AS DOUBLE) ELSE CAST(n_suppliers AS DOUBLE) END AS tie
      FROM p)
SELECT n_regionkey, n_nationkey, n_suppliers, is_dead,
  round(avg(raw) OVER (PARTITION BY n_regionkey, is_dead, tie), 6) AS place FROM r""",

    "rank_delta": f"""
WITH a AS (SELECT user_id, sum(CAST(value AS {_M})) AS v FROM events
           WHERE dayofmonth(ts) <= 15 GROUP BY 1),
b AS (SELECT user_id, sum(CAST(value AS {_M})) AS v FROM events
      WHERE dayofmonth(ts) > 15 GROUP BY 1),
ra AS (SELECT user_id, row_number() OVER (ORDER BY v DESC, user_id) AS rank_first FROM a),
rb AS (SELECT user_id, row_number() OVER (ORDER BY v DESC, user_id) AS rank_second FROM b)
SELECT coalesce(ra.user_id, rb.user_id) AS user_id, rank_first, rank_second,
  rank_first - rank_second AS rank_delta
FROM ra FULL OUTER JOIN rb ON ra.user_id = rb.user_id""",

    "group_argmax_flag": """
SELECT event_id, user_id,
  CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1
       THEN 1 ELSE 0 END AS is_top
FROM events""",

    "share_within_group": f"""
WITH g AS (SELECT c_nationkey, c_mktsegment, sum(CAST(o_totalprice AS {_M})) AS revenue
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_nationkey, c_mktsegment, CAST(revenue AS {_M}) AS revenue,
  round(CAST(revenue AS DOUBLE) / sum(CAST(revenue AS DOUBLE)) OVER (PARTITION BY c_nationkey), 6)
    AS share
FROM g""",

    "cumulative_share": """
WITH g AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1),
s AS (SELECT *, n / (SELECT sum(n) FROM g) AS share FROM g),
c AS (SELECT *, sum(share) OVER (ORDER BY o_orderpriority
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_share
      FROM s)
SELECT o_orderpriority, n, round(share, 6) AS share, round(cum_share, 6) AS cum_share,
  round(coalesce(lag(cum_share) OVER (ORDER BY o_orderpriority), 0.0), 6) AS start FROM c""",

    "iqr_outliers_topn": """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
             quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
j AS (SELECT e.event_id, e.event_type, e.value,
        (e.value < q1 - 1.5 * (q3 - q1) OR e.value > q3 + 1.5 * (q3 - q1)) AS is_outlier,
        row_number() OVER (PARTITION BY e.event_type ORDER BY abs(e.value - med), e.event_id) AS rk
      FROM events e JOIN q ON e.event_type = q.event_type)
SELECT event_id, event_type, value, is_outlier,
  CAST(CASE WHEN rk <= 8 THEN rk END AS BIGINT) AS near_rank,
  (is_outlier AND rk <= 8) AS show
FROM j WHERE is_outlier OR rk <= 8""",

    "pivot_count": """
SELECT user_id, CAST(count_if(event_type = 'click') AS BIGINT) AS n_click, CAST(count_if(event_type = 'error') AS BIGINT) AS n_error,
  CAST(count_if(event_type = 'purchase') AS BIGINT) AS n_purchase, CAST(count_if(event_type = 'signup') AS BIGINT) AS n_signup,
  CAST(count_if(event_type = 'view') AS BIGINT) AS n_view
FROM events GROUP BY user_id""",

    "pivot_sum_fill": _PIVOT_SUM,

    "unpivot_long": f"""
WITH w AS ({_PIVOT_SUM})
SELECT user_id, 'click' AS event_type, v_click AS total FROM w
UNION ALL SELECT user_id, 'error', v_error FROM w
UNION ALL SELECT user_id, 'purchase', v_purchase FROM w
UNION ALL SELECT user_id, 'signup', v_signup FROM w
UNION ALL SELECT user_id, 'view', v_view FROM w""",

    "complete_grid": """
WITH cr AS (SELECT r_name, c_mktsegment FROM customer
            JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
regions AS (SELECT DISTINCT r_name FROM cr),
segs AS (SELECT * FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'),
                               ('MACHINERY')) t(c_mktsegment)),
cnt AS (SELECT r_name, c_mktsegment, count(*) AS n FROM cr GROUP BY 1, 2),
rt AS (SELECT r_name, count(*) AS region_total FROM cr GROUP BY 1),
st AS (SELECT c_mktsegment, count(*) AS segment_total FROM cr GROUP BY 1)
SELECT r.r_name, s.c_mktsegment, coalesce(cnt.n, 0) AS n_customers, rt.region_total,
  coalesce(st.segment_total, 0) AS segment_total,
  round(coalesce(cnt.n, 0) / rt.region_total, 6) AS share_of_region
FROM regions r CROSS JOIN segs s
LEFT JOIN cnt ON cnt.r_name = r.r_name AND cnt.c_mktsegment = s.c_mktsegment
LEFT JOIN rt ON rt.r_name = r.r_name LEFT JOIN st ON st.c_mktsegment = s.c_mktsegment""",

    "range_join_effective_owner": """
WITH u AS (
  SELECT user_id, ts, 1 AS side, CAST(NULL AS BIGINT) AS rtb, event_id AS ltb, event_id,
         CAST(NULL AS BIGINT) AS pid FROM events WHERE event_type = 'view'
  UNION ALL
  SELECT user_id, ts, 0, event_id, NULL, NULL, event_id FROM events WHERE event_type = 'purchase'),
s AS (SELECT *, last_value(pid IGNORE NULLS) OVER (PARTITION BY user_id
        ORDER BY ts, side, rtb NULLS FIRST, ltb NULLS FIRST
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS purchase_id FROM u)
SELECT s.event_id, s.user_id, s.purchase_id, p.value AS purchase_value,
  coalesce(s.purchase_id, s.user_id) AS effective_owner
FROM s LEFT JOIN events p ON p.event_id = s.purchase_id
WHERE s.side = 1""",

    "threshold_first_crossing": f"""
WITH d AS (SELECT user_id, {_DAY} AS day, sum(CAST(value AS {_M})) AS v, count(*) AS n
           FROM events GROUP BY 1, 2),
c AS (SELECT *, CAST(sum(v) OVER w AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY user_id) AS DOUBLE) AS cvs,
        CAST(sum(n) OVER w AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY user_id) AS DOUBLE) AS ccs
      FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS rn FROM c
      WHERE cvs > 0.66666 AND ccs > 0.66666)
SELECT user_id, day, round(cvs, 6) AS cum_value_share, round(ccs, 6) AS cum_count_share
FROM h WHERE rn = 1""",

    "true_denominator_mean": f"""
WITH e AS (SELECT *, {_DAY} AS day FROM events),
per AS (SELECT user_id, event_type, sum(CAST(value AS {_M})) AS total FROM e GROUP BY 1, 2),
act AS (SELECT user_id, count(DISTINCT day) AS active_days FROM e GROUP BY 1)
SELECT event_type, round(avg(CAST(total AS DOUBLE) / active_days), 6) AS mean_per_active_day,
  round(avg(CAST(total AS DOUBLE) / (SELECT max(day) + 1 FROM e)), 6) AS mean_per_spine_day, count(*) AS n_users
FROM per JOIN act ON per.user_id = act.user_id GROUP BY event_type""",

    "copy_normalised_rate": f"""
WITH a AS (SELECT year(l_shipdate) AS yr, sum(CAST(l_quantity AS {_M})) AS qty,
             sum(CAST(l_extendedprice AS {_M})) AS yield_sum,
             count(DISTINCT l_orderkey) AS n_orders,
             count(DISTINCT CAST(l_orderkey AS VARCHAR) || '|' ||
                            CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS n_order_days
           FROM lineitem GROUP BY 1),
b AS (SELECT year(o_orderdate) AS yr, sum(CAST(o_totalprice AS {_M})) AS order_total,
        count(*) AS n_placed FROM orders GROUP BY 1),
j AS (SELECT coalesce(a.yr, b.yr) AS yr, qty, yield_sum, n_orders, n_order_days, order_total,
        n_placed FROM a FULL OUTER JOIN b ON a.yr = b.yr),
k AS (SELECT *, coalesce(CASE WHEN qty > 0 THEN CAST(yield_sum AS DOUBLE) / CAST(qty AS DOUBLE) END,
                         0.0) AS per_copy FROM j)
SELECT CAST(yr AS INTEGER) AS yr, CAST(coalesce(qty, 0) AS {_M}) AS qty, round(per_copy, 6) AS per_copy,
  round(coalesce(CASE WHEN n_orders > 0 THEN per_copy * n_order_days / n_orders END, 0.0), 6)
    AS era_total,
  CAST(coalesce(n_orders, 0) AS BIGINT) AS n_orders,
  CAST(coalesce(order_total, 0) AS {_M}) AS order_total,
  CAST(coalesce(n_placed, 0) AS BIGINT) AS n_placed
FROM k""",

    "trigger_two_level_stats": f"""
WITH f AS (SELECT * FROM events WHERE value > 10),
l1 AS (SELECT event_type, user_id, count(*) AS cnt, avg(value) AS mean_v FROM f GROUP BY 1, 2),
l2 AS (SELECT event_type, count(*) AS n_players, round(avg(cnt), 6) AS mean_count,
         round(stddev_samp(cnt), 6) AS sd_count, round(avg(mean_v), 6) AS mean_of_means
       FROM l1 GROUP BY 1),
t AS (SELECT event_type, count(*) AS n_rows, sum(CAST(value AS {_M})) AS vsum FROM f GROUP BY 1),
nu AS (SELECT count(DISTINCT user_id) AS n FROM events)
SELECT l2.event_type, n_players, mean_count, sd_count, mean_of_means, t.n_rows,
  round(CAST(vsum AS DOUBLE) / nu.n, 6) AS avg_yield,
  round(CAST(vsum AS DOUBLE) / t.n_rows, 6) AS avg_trigger,
  round(t.n_rows / nu.n, 6) AS avg_times,
  round((CAST(vsum AS DOUBLE) / t.n_rows) * (t.n_rows / nu.n), 6) AS amount_x_times
FROM l2 JOIN t ON l2.event_type = t.event_type CROSS JOIN nu""",

    "bucketed_totals": f"""
WITH e AS (SELECT *, {_DAY} AS day FROM events),
b AS (SELECT day - day % 10 AS bucket_start,
        CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS flag,
        CAST(value AS {_M}) AS v FROM e)
SELECT bucket_start, printf('%d-%d', bucket_start, bucket_start + 9) AS bucket_label,
  CAST(coalesce(sum(CASE WHEN flag = 0 THEN v END), 0) AS {_M}) AS v_0,
  CAST(coalesce(sum(CASE WHEN flag = 1 THEN v END), 0) AS {_M}) AS v_1,
  CAST(CAST(count_if(flag = 0) AS BIGINT) AS BIGINT) AS n_0, CAST(CAST(count_if(flag = 1) AS BIGINT) AS BIGINT) AS n_1
FROM b GROUP BY bucket_start""",

    "having_positive": f"""
SELECT user_id, event_type, CAST(sum(CAST(value AS {_M}) - 25) AS {_M}) AS net FROM events
GROUP BY user_id, event_type HAVING sum(CAST(value AS {_M}) - 25) > 0""",

    "full_outer_two_facts": f"""
WITH a AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS {_M})) AS line_total
           FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey AS k, sum(CAST(o_totalprice AS {_M})) AS order_total FROM orders GROUP BY 1)
SELECT coalesce(a.k, b.k) AS orderkey, CAST(line_total AS {_M}) AS line_total,
  CAST(order_total AS {_M}) AS order_total,
  CAST(coalesce(order_total, 0) - coalesce(line_total, 0) AS {_M}) AS diff
FROM a FULL OUTER JOIN b ON a.k = b.k""",

    "semi_anti_filters": """
WITH per AS (SELECT o_custkey AS c_custkey, max(o_orderdate) AS last_date,
               count(DISTINCT o_orderstatus) AS n_status FROM orders GROUP BY 1)
SELECT c.c_custkey,
  CASE WHEN p.c_custkey IS NULL THEN 'no_orders'
       WHEN p.last_date < TIMESTAMP '1998-01-01' THEN 'stale'
       WHEN p.n_status = 1 THEN 'degenerate' ELSE 'valid' END AS category
FROM customer c LEFT JOIN per p ON c.c_custkey = p.c_custkey""",

    "set_ops": """
WITH a AS (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996),
b AS (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)
SELECT o_custkey, 'union' AS op FROM (SELECT o_custkey FROM a UNION SELECT o_custkey FROM b) u
UNION ALL
SELECT o_custkey, 'intersect' FROM (SELECT o_custkey FROM a INTERSECT SELECT o_custkey FROM b) i
UNION ALL
SELECT o_custkey, 'except' FROM (SELECT o_custkey FROM a EXCEPT SELECT o_custkey FROM b) x""",

    "snowflake_dims": """
WITH pn AS (SELECT c_nationkey, count(*) AS n_customers FROM customer GROUP BY 1),
d AS (SELECT s_nationkey AS d_nationkey, min(s_suppkey) AS default_suppkey FROM supplier GROUP BY 1),
v AS (SELECT s.s_nationkey, count(*) AS n_variants FROM supplier s
      JOIN d ON s.s_nationkey = d.d_nationkey AND s.s_suppkey <> d.default_suppkey GROUP BY 1)
SELECT r_name, n_name, CAST(coalesce(n_customers, 0) AS BIGINT) AS n_customers,
  CAST(coalesce(n_variants, 0) AS BIGINT) AS n_variants
FROM nation JOIN region ON n_regionkey = r_regionkey
LEFT JOIN pn ON n_nationkey = pn.c_nationkey LEFT JOIN v ON n_nationkey = v.s_nationkey""",

    "id_translation": """
WITH seen AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
dict AS (SELECT key, row_number() OVER (ORDER BY key) AS id FROM seen),
newk AS (SELECT DISTINCT o_custkey AS key FROM orders
         WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_custkey NOT IN (SELECT key FROM seen)),
minted AS (SELECT key, (SELECT coalesce(max(id), 0) FROM dict) + row_number() OVER (ORDER BY key) AS id
           FROM newk),
full_d AS (SELECT key, id FROM dict UNION ALL SELECT key, id FROM minted)
SELECT o_orderkey, o_custkey, CAST(id AS BIGINT) AS global_id
FROM orders JOIN full_d ON o_custkey = key WHERE o_orderdate >= TIMESTAMP '1998-01-01'""",

    "ordered_string_agg": """
WITH f AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (
             PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)
SELECT user_id, string_agg(event_type, '|' ORDER BY ts, event_id) AS type_path
FROM f WHERE rn = 1 GROUP BY user_id""",

    "set_signature": f"""
WITH e AS (SELECT user_id, {_DAY} AS day, event_type FROM events),
s AS (SELECT user_id, day, array_to_string(list_sort(list_distinct(list(event_type))), '|')
        AS signature FROM e GROUP BY 1, 2)
SELECT user_id, day, signature,
  CASE WHEN NOT contains(signature, '|') THEN 'single:' || signature
       WHEN contains(signature, 'purchase') THEN 'buyer' ELSE 'browser' END AS category
FROM s""",

    "crosstab_residual": """
SELECT o_orderpriority, count(*) AS n, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS n_F,
  CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS n_O,
  count(*) - CAST(count_if(o_orderstatus = 'F') AS BIGINT) - CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS n_rest
FROM orders GROUP BY o_orderpriority""",

    "flow_links": """
WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id
             ORDER BY ts, event_id) AS pos FROM events),
w AS (SELECT user_id, max(CASE WHEN pos = 1 THEN event_type END) AS s1,
        max(CASE WHEN pos = 2 THEN event_type END) AS s2,
        max(CASE WHEN pos = 3 THEN event_type END) AS s3 FROM r WHERE pos <= 3 GROUP BY 1),
won AS (SELECT user_id,
          CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END)
               > sum(CASE WHEN event_type = 'error' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END)
               AS INTEGER) AS won FROM events GROUP BY 1),
l AS (SELECT 1 AS stage, s1 AS source, s2 AS target, won FROM w JOIN won USING (user_id)
      UNION ALL SELECT 2, s2, s3, won FROM w JOIN won USING (user_id))
SELECT stage, source, target, count(*) AS n, CAST(sum(won) AS BIGINT) AS wins,
  CAST(count(*) - sum(won) AS BIGINT) AS losses
FROM l WHERE target IS NOT NULL GROUP BY 1, 2, 3""",

    "reclassify_delta": """
WITH last AS (SELECT o_custkey, o_orderstatus AS end_status, o_orderdate AS end_date FROM (
                SELECT *, row_number() OVER (PARTITION BY o_custkey
                  ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) t WHERE rn = 1),
cr AS (SELECT o_custkey, o_orderdate AS cross_date FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
         FROM orders WHERE o_totalprice > 400000) t WHERE rn = 1),
j AS (SELECT l.*, (c.cross_date IS NOT NULL AND c.cross_date <= l.end_date) AS moved
      FROM last l LEFT JOIN cr c ON l.o_custkey = c.o_custkey),
u AS (SELECT end_status AS category, 1 AS d FROM j
      UNION ALL SELECT end_status, -1 FROM j WHERE moved
      UNION ALL SELECT 'AUTHORITY', 1 FROM j WHERE moved)
SELECT category, CAST(greatest(sum(d), 0) AS BIGINT) AS wins FROM u GROUP BY category""",

    "quantile_clip": """
WITH p AS (SELECT quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem)
SELECT l_returnflag, round(max(p99), 6) AS p99,
  round(sum(least(l_extendedprice, p99)), 2) AS sum_clipped,
  CAST(count_if(l_extendedprice > p99) AS BIGINT) AS n_clipped
FROM lineitem CROSS JOIN p GROUP BY l_returnflag""",

    "histogram_bins": """
WITH r AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
SELECT e.event_type,
  CAST(CASE WHEN hi - lo = 0 THEN 1 ELSE least(floor((value - lo) / (hi - lo) * 30), 29) + 1 END
       AS INTEGER) AS bin,
  count(*) AS n, min(lo) AS range_lo, min(hi) AS range_hi
FROM events e JOIN r ON e.event_type = r.event_type GROUP BY 1, 2""",

    "normalised_pivot_ordered": f"""
WITH e AS (SELECT CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS INTEGER)
             AS week, event_type, CAST(value AS {_M}) AS v FROM events),
g AS (SELECT week, event_type, CAST(sum(v) AS DOUBLE) AS v FROM e GROUP BY 1, 2),
t AS (SELECT event_type, row_number() OVER (ORDER BY sum(v) DESC, event_type) AS col_order
      FROM e GROUP BY 1)
SELECT week, g.event_type, round(v / sum(v) OVER (PARTITION BY week), 6) AS share, col_order
FROM g JOIN t ON g.event_type = t.event_type""",

    "json_props_rollup": """
SELECT event_type, count(*) AS n,
  CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS sum_k,
  CAST(count_if(CAST(json_extract_string(props, '$.k') AS INTEGER) > 50) AS BIGINT) AS n_k_gt_50,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS span_sec
FROM events GROUP BY event_type""",

    "conversation_rollup": """
SELECT conv_id, count(*) AS n_turns, CAST(count_if(role = 'user') AS BIGINT) AS n_user,
  CAST(count_if(role = 'assistant') AS BIGINT) AS n_assistant, CAST(sum(length(text)) AS BIGINT) AS total_chars,
  arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role
FROM conversations GROUP BY conv_id""",

    "exact_content_dedup": """
SELECT sha256(text) AS content_hash, min(doc_id) AS kept_doc_id, count(*) AS n_copies
FROM documents GROUP BY 1""",

    "html_link_or_title_parse": """
SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host,
  regexp_extract(html, '<html lang="([A-Za-z-]+)"', 1) AS lang,
  regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
  CAST(len(regexp_extract_all(html, '<a\\s')) AS BIGINT) AS n_links,
  regexp_extract(html, '<title>(.*?)</title>', 1) <> '' AS is_ok
FROM pages""",

    "cohort_filter_rates": """
WITH co AS (SELECT o_custkey AS c_custkey FROM orders GROUP BY 1
            HAVING CAST(count_if(o_orderstatus = 'P') AS BIGINT) > 0),
ro AS (SELECT c.c_custkey, c.c_mktsegment FROM customer c JOIN co ON c.c_custkey = co.c_custkey),
nr AS (SELECT c_mktsegment, count(*) AS n_cohort FROM ro GROUP BY 1),
f AS (SELECT ro.c_mktsegment, CAST(year(o_orderdate) AS INTEGER) AS yr, count(*) AS n_orders
      FROM orders JOIN ro ON o_custkey = ro.c_custkey GROUP BY 1, 2)
SELECT f.c_mktsegment, yr, n_orders, n_cohort, round(n_orders / n_cohort, 6) AS rate
FROM f JOIN nr ON f.c_mktsegment = nr.c_mktsegment""",

    "gaussian_kde_grid": _KDE + "SELECT event_type, grid_i, x, density FROM kd",

    "kde_support_window": _KDE + """
, pk AS (SELECT event_type, max(density) AS peak FROM kd GROUP BY 1)
SELECT kd.event_type, min(x) AS x_lo, max(x) AS x_hi FROM kd JOIN pk ON kd.event_type = pk.event_type
WHERE density >= 0.01 * peak GROUP BY kd.event_type""",

    "weighted_totals": """
WITH pl AS (SELECT o_custkey, count(*) AS plays FROM orders GROUP BY 1),
mp AS (SELECT avg(plays) AS m FROM pl),
wi AS (SELECT o_custkey, o_orderpriority, count(*) AS wins FROM orders WHERE o_orderstatus = 'F'
       GROUP BY 1, 2)
SELECT o_orderpriority, round(sum(plays / m * wins), 6) AS weighted_wins
FROM wi JOIN pl ON wi.o_custkey = pl.o_custkey CROSS JOIN mp GROUP BY o_orderpriority""",

    "milestone_impact": f"""
WITH e AS (SELECT *, {_DAY} AS day, CAST(value AS {_M}) AS v FROM events),
f AS (SELECT user_id, event_type, min(day) AS first_day FROM e GROUP BY 1, 2),
w AS (SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN v ELSE 0 END)
                          > sum(CASE WHEN event_type = 'error' THEN v ELSE 0 END) AS INTEGER) AS win
      FROM e GROUP BY 1)
SELECT event_type, round(quantile_cont(CAST(first_day AS DOUBLE), 0.5), 6) AS median_first_day,
  round(avg(win), 6) AS win_rate, count(*) AS n_users
FROM f JOIN w ON f.user_id = w.user_id GROUP BY event_type""",

    "five_number_summary": """
SELECT o_orderpriority, round(min(o_totalprice), 6) AS o_totalprice_min,
  round(quantile_cont(o_totalprice, 0.25), 6) AS o_totalprice_q1,
  round(quantile_cont(o_totalprice, 0.5), 6) AS o_totalprice_median,
  round(quantile_cont(o_totalprice, 0.75), 6) AS o_totalprice_q3,
  round(max(o_totalprice), 6) AS o_totalprice_max
FROM orders GROUP BY o_orderpriority""",

    "row_percentages": """
SELECT o_orderpriority, count(*) AS n,
  round(CAST(count_if(o_orderstatus = 'F') AS BIGINT) * 100.0 / count(*), 6) AS pct_F,
  round(CAST(count_if(o_orderstatus = 'O') AS BIGINT) * 100.0 / count(*), 6) AS pct_O,
  round(CAST(count_if(o_orderstatus = 'P') AS BIGINT) * 100.0 / count(*), 6) AS pct_P
FROM orders GROUP BY o_orderpriority""",

    "correlation_columns": """
SELECT 'l_quantity' AS "column", round(corr(l_extendedprice, l_quantity), 6) AS corr FROM lineitem
UNION ALL SELECT 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem
UNION ALL SELECT 'l_tax', round(corr(l_extendedprice, l_tax), 6) FROM lineitem""",

    "composite_score": """
WITH r AS (SELECT p_partkey, 0.0 + p_retailprice * CAST(0.6 AS DOUBLE)
                                 + p_size * CAST(0.4 AS DOUBLE) AS raw FROM part),
s AS (SELECT p_partkey, raw / (SELECT max(raw) FROM r) AS scaled FROM r)
SELECT p_partkey, round(scaled - (SELECT min(scaled) FROM s), 6) AS score FROM s""",

    "goodman_ci": f"""
WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
t AS (SELECT sum(n) AS nn FROM c),
x AS (SELECT event_type, n, n / nn AS p, nn FROM c CROSS JOIN t),
b AS (SELECT *, greatest(0.0, least(1.0, (2.0 * n + {_GOODMAN_C}
                  - sqrt({_GOODMAN_C} * ({_GOODMAN_C} + 4.0 * n * (1.0 - p))))
                  / (2.0 * (nn + {_GOODMAN_C})))) AS lo,
             greatest(0.0, least(1.0, (2.0 * n + {_GOODMAN_C}
                  + sqrt({_GOODMAN_C} * ({_GOODMAN_C} + 4.0 * n * (1.0 - p))))
                  / (2.0 * (nn + {_GOODMAN_C})))) AS hi FROM x)
SELECT event_type, n, round(p, 6) AS share, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi,
  (lo > 1.0 / {_GOODMAN_K} OR hi < 1.0 / {_GOODMAN_K}) AS star FROM b""",

    # statistic and dof hold for any k; the closed-form tail below is the
    # chi-squared survival function for 4 degrees of freedom (k = 5 types).
    "chisq_gof": """
WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
e AS (SELECT sum(n) / count(*) AS e, count(*) AS k FROM c),
s AS (SELECT sum((n - e) * (n - e) / e) AS x, max(k) - 1 AS dof FROM c CROSS JOIN e)
SELECT round(x, 6) AS statistic, CAST(dof AS BIGINT) AS dof,
  round(exp(-x / 2) * (1 + x / 2), 6) AS p_value FROM s""",

    "balanced_log_loss": """
WITH d AS (SELECT max(n_chars) AS m FROM documents),
r AS (SELECT quality AS y, n_chars / m AS p_raw
      FROM labels JOIN documents ON labels.doc_id = documents.doc_id CROSS JOIN d),
s AS (SELECT sum(1 - p_raw) AS s0, sum(p_raw) AS s1 FROM r),
w AS (SELECT y, (p_raw / s1) / ((1 - p_raw) / s0 + p_raw / s1) AS p_w FROM r CROSS JOIN s),
j AS (SELECT y, least(greatest(p_w, 1e-15), 1 - 1e-15) AS p FROM w),
g AS (SELECT count(*) AS n, CAST(count_if(y = 0) AS BIGINT) AS n0, CAST(count_if(y <> 0) AS BIGINT) AS n1,
        sum(CASE WHEN y = 0 THEN ln(1 - p) ELSE 0 END) AS s0,
        sum(CASE WHEN y <> 0 THEN ln(p) ELSE 0 END) AS s1,
        avg(CAST(CAST(p >= 0.5 AS INTEGER) = y AS DOUBLE)) AS acc FROM j)
SELECT n, n0, n1,
  round((-(n / n0) / n0 * s0 - (n / n1) / n1 * s1) / (n / n0 + n / n1), 6) AS log_loss,
  round(acc, 6) AS accuracy FROM g""",

    "latest_state": """
WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id
             ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT a.user_id, a.event_id AS latest_event_id, a.event_type AS latest_event_type,
  b.event_id AS prev_event_id, b.event_type AS prev_event_type
FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.rn = 2 WHERE a.rn = 1""",

    "monotone_max": f"""
WITH e AS (SELECT *, {_DAY} AS day FROM events),
l AS (SELECT user_id, day, event_type AS last_type FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) AS rn
        FROM e) t WHERE rn = 1)
SELECT e.user_id, e.day, max(value) AS max_value, count(*) AS n, max(l.last_type) AS last_type,
  bool_or(event_type = 'purchase') AS finished
FROM e JOIN l ON e.user_id = l.user_id AND e.day = l.day GROUP BY e.user_id, e.day""",
    "stream_timeout_sessions": """
WITH e AS (SELECT user_id, ts, event_id, value,
             CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE
                  THEN 1 ELSE 0 END AS brk
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
  strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS session_end,
  count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total_value
FROM s GROUP BY user_id, sid
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",

    "stream_latest_state": """
WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id
             ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT a.user_id, a.event_id AS latest_event_id, a.event_type AS latest_event_type,
  b.event_id AS prev_event_id, b.event_type AS prev_event_type
FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.rn = 2 WHERE a.rn = 1""",

    "group_split": """
SELECT event_id, user_id, CASE WHEN CAST(('0x' || left(md5('42|' || user_id), 13)) AS BIGINT) % 100 < 75
  THEN 'train' ELSE 'test' END AS split FROM events""",

    "schema_contract": """
WITH o AS (SELECT count(*) AS n, count(*) FILTER (c.c_custkey IS NOT NULL) AS known
           FROM orders LEFT JOIN customer c ON o_custkey = c_custkey AND c_acctbal >= 0)
SELECT 'a' AS file, 'GameOrders' AS table_name, 'accepted' AS status, known AS rows FROM o
UNION ALL SELECT 'a', 'GameOrders', 'unmatched', n - known FROM o WHERE n > known
UNION ALL SELECT 'b', 'GameBalance', 'accepted', count(*) FROM customer
UNION ALL SELECT 'c', 'GameOrders', 'quarantined', 0""",

    "ingest_ids": f"""
WITH c AS (SELECT c_custkey, md5(c_name) AS uuid_hex, c_acctbal, c_acctbal >= 0 AS first FROM customer),
i AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN first THEN 0 ELSE 1 END, uuid_hex) AS id FROM c)
SELECT uuid_hex, id, CASE WHEN first THEN (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) ELSE 0 END
  AS n_orders, CAST(c_acctbal AS {_M}) AS balance FROM i""",

    "write_audit": r"""
SELECT *, '{"null_keys": ' || null_keys || ', "rejects": ' || rejects || '}' AS metadata_json FROM (
  SELECT 'documents' AS table_name, count(*) AS n_rows,
    count(*) FILTER (NOT regexp_matches(coalesce(text, ''), '\p{L}')) AS rejects,
    count(*) FILTER (doc_id IS NULL) AS null_keys FROM documents
  UNION ALL SELECT 'events', count(*), count(*) FILTER (coalesce(value < 0, true)),
    count(*) FILTER (user_id IS NULL OR ts IS NULL) FROM events
  UNION ALL SELECT 'orders', count(*), count(*) FILTER (o_totalprice > 400000),
    count(*) FILTER (o_custkey IS NULL) FROM orders)""",

    "usage_log_rollup": """
WITH c AS (SELECT conv_id, role = 'user' AS req, turn, CAST(length(text) AS BIGINT) AS n,
             conv_id % 1000 * 60 + turn * 95 AS t FROM conversations),
g AS (SELECT conv_id, CAST(count_if(req) AS BIGINT) AS n_requests, CAST(count_if(NOT req) AS BIGINT) AS n_tool_calls,
        CAST(coalesce(sum(n) FILTER (req), 0) AS BIGINT) AS total_input_tokens,
        CAST(coalesce(sum(n // 3) FILTER (req), 0) AS BIGINT) AS cached_input_tokens,
        CAST(coalesce(sum(turn) FILTER (req), 0) AS BIGINT) AS output_tokens,
        min(CASE WHEN req THEN t - 5 ELSE t END) AS a, max(CASE WHEN req THEN t + n % 50 ELSE t END) AS b
      FROM c GROUP BY conv_id)
SELECT conv_id, n_requests, n_tool_calls, total_input_tokens - cached_input_tokens AS input_tokens,
  cached_input_tokens, total_input_tokens, output_tokens,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(a), '%Y-%m-%d %H:%M:%S') AS first_time,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(b), '%Y-%m-%d %H:%M:%S') AS last_time,
  CASE WHEN b - a >= 3600 THEN ((b - a) // 3600) || 'h ' || ((b - a) % 3600 // 60) || 'm ' || ((b - a) % 60) || 's'
       WHEN b - a >= 60 THEN ((b - a) // 60) || 'm ' || ((b - a) % 60) || 's' ELSE (b - a) || 's' END AS span
FROM g""",

    "stream_all_sessions": """
WITH e AS (SELECT user_id, ts, event_id, value,
             CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE
                  THEN 1 ELSE 0 END AS brk
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
  strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS session_end,
  count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total_value,
  max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS closed
FROM s GROUP BY user_id, sid""",

    "stream_latest_state_ttl": """
WITH r AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id
             ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT a.user_id, a.event_id AS latest_event_id, a.event_type AS latest_event_type,
  b.event_id AS prev_event_id, b.event_type AS prev_event_type
FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.rn = 2 AND a.ts - b.ts <= INTERVAL 24 HOUR WHERE a.rn = 1""",

    "stream_register": """
WITH f AS (SELECT user_id, ts, event_id, 'u' || event_id AS address, row_number() OVER (
             PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'signup')
SELECT e.user_id, max(f.address) AS address,
  CAST(count_if(f.ts IS NOT NULL AND (e.ts, e.event_id) >= (f.ts, f.event_id)) AS BIGINT) AS n_accepted,
  CAST(count_if(f.ts IS NULL OR (e.ts, e.event_id) < (f.ts, f.event_id)) AS BIGINT) AS n_rejected
FROM events e LEFT JOIN f ON e.user_id = f.user_id AND f.rn = 1 GROUP BY e.user_id""",

    "stream_first_arrivals": """
SELECT user_id, event_type, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",

    "stream_cache_fill": f"""
SELECT {_DAY} AS day, event_type, count(*) AS n_events,
  CAST(sum(CAST(value AS {_M})) AS {_M}) AS total_value
FROM events GROUP BY 1, 2""",

    "stream_monotone_max": f"""
WITH e AS (SELECT *, {_DAY} AS day FROM events),
l AS (SELECT user_id, day, event_type AS last_event_type FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) AS rn
        FROM e) t WHERE rn = 1)
SELECT e.user_id, e.day, max(value) AS max_value, max(l.last_event_type) AS last_event_type
FROM e JOIN l ON e.user_id = l.user_id AND e.day = l.day GROUP BY e.user_id, e.day""",

    "incremental_cache": f"""
SELECT user_id, {_DAY} AS day, count(*) AS n_events,
  CAST(sum(CAST(value AS {_M})) AS {_M}) AS total_value
FROM events GROUP BY 1, 2""",

    "segment_splice": """
WITH l AS (SELECT role AS log_name, conv_id AS seg_no,
             row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS line_no,
             CAST(length(text) AS BIGINT) AS n_chars FROM conversations),
f AS (SELECT log_name, min(seg_no) AS first_seg FROM l GROUP BY 1),
k AS (SELECT l.* FROM l JOIN f ON l.log_name = f.log_name
      WHERE NOT (l.log_name IN ('user') AND l.line_no = 0 AND l.seg_no > f.first_seg))
SELECT log_name, seg_no, CAST(line_no AS BIGINT) AS line_no, n_chars,
  row_number() OVER (PARTITION BY log_name ORDER BY seg_no, line_no) AS out_line FROM k""",
    "parse_audit": """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
             unnest(string_split(text, chr(10))) AS line FROM documents),
b AS (SELECT *, NOT regexp_matches(line, '\\p{L}') AS bad FROM l)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(bad) AS BIGINT) AS n_bad,
  CAST(min(CASE WHEN bad THEN line_no END) AS INTEGER) AS first_bad_line_no,
  arg_min(line, CASE WHEN bad THEN line_no END) AS first_bad_line
FROM b GROUP BY doc_id""",

    "left_censored_drop": f"""
WITH e AS (SELECT *, {_DAY} AS day FROM events),
ok AS (SELECT user_id FROM e GROUP BY 1 HAVING min(day) <= 2)
SELECT user_id, count(*) AS n_events FROM e WHERE user_id IN (SELECT user_id FROM ok)
GROUP BY user_id""",

    "roster_check": """
WITH g AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_members,
             list_sort(list_distinct(list(o_orderstatus))) AS m FROM orders GROUP BY 1),
x AS (SELECT *, list_filter(['F', 'O', 'P'], lambda s: NOT list_contains(m, s)) AS miss FROM g)
SELECT o_custkey, n_members, array_to_string(m, '|') AS members,
  array_to_string(miss, '|') AS missing FROM x
WHERE n_members <> 3 OR len(miss) > 0""",

    "discrepancy_report": """
WITH a AS (SELECT o_custkey AS custkey, count(*) AS n_orders FROM orders GROUP BY 1),
b AS (SELECT o_custkey AS custkey, count(*) AS n_with_lines
      FROM (SELECT DISTINCT l_orderkey FROM lineitem) l JOIN orders ON l.l_orderkey = o_orderkey
      GROUP BY 1),
j AS (SELECT coalesce(a.custkey, b.custkey) AS custkey, coalesce(n_orders, 0) AS n_orders,
        coalesce(n_with_lines, 0) AS n_with_lines FROM a FULL OUTER JOIN b ON a.custkey = b.custkey)
SELECT custkey, n_orders, n_with_lines, n_orders - n_with_lines AS difference FROM j
WHERE n_orders - n_with_lines <> 0""",
    "distinct_projection": f"""
SELECT DISTINCT user_id, {_DAY} AS day, event_type FROM events""",

    "game_rollup": f"""
WITH e AS (SELECT *, {_DAY} AS day,
             CASE WHEN event_type = 'purchase' AND value > 45 THEN event_type ELSE '' END AS v0
           FROM events),
f AS (SELECT *, CASE WHEN trim(v0) = '' OR lower(trim(v0)) = 'nan' THEN NULL ELSE trim(v0) END
        AS victory FROM e)
SELECT user_id, max(day) AS max_day, count(DISTINCT event_type) AS n_types,
  min(victory) AS winner_type, min(CASE WHEN victory IS NOT NULL THEN event_id END) AS winner_event_id
FROM f GROUP BY user_id""",

    "end_state_share": f"""
WITH e AS (SELECT *, {_DAY} AS day FROM events),
l AS (SELECT user_id, max(day) AS day FROM e GROUP BY 1),
a AS (SELECT e.* FROM e JOIN l ON e.user_id = l.user_id AND e.day = l.day),
p AS (SELECT user_id, event_type, count(*) AS n FROM a GROUP BY 1, 2)
SELECT user_id, event_type, n, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS share FROM p""",

    "pick_performance": """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey
             ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders),
w AS (SELECT o_custkey, o_orderkey AS w FROM r WHERE rn = 1),
j AS (SELECT o.*, coalesce(o.o_orderkey = w.w, false) AS won,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent'
             WHEN o_orderpriority = '2-HIGH' THEN 'high'
             WHEN o_orderpriority = '5-LOW' THEN
               CASE WHEN month(o_orderdate) <= 6 THEN 'low_early' ELSE 'low_late' END END AS section
      FROM orders o LEFT JOIN w ON o.o_custkey = w.o_custkey)
SELECT section, o_orderstatus, count(*) AS n, CAST(count_if(won) AS BIGINT) AS wins,
  CAST(count_if(NOT won) AS BIGINT) AS losses, round(avg(dayofyear(o_orderdate)), 6) AS avg_day
FROM j WHERE section IS NOT NULL GROUP BY section, o_orderstatus""",

    "opens_and_wins": """
WITH op AS (SELECT o_orderpriority, o_orderstatus, count(*) AS opens FROM orders GROUP BY 1, 2),
wi AS (SELECT o_orderpriority, o_orderstatus, count(*) AS wins FROM orders
       WHERE o_totalprice > 300000 GROUP BY 1, 2)
SELECT op.o_orderpriority, op.o_orderstatus, opens, CAST(coalesce(wins, 0) AS BIGINT) AS wins
FROM op LEFT JOIN wi ON op.o_orderpriority = wi.o_orderpriority
  AND op.o_orderstatus = wi.o_orderstatus""",

    "first_then_pivot": """
WITH f AS (SELECT c_nationkey, c_mktsegment, arg_min(c_acctbal, c_custkey) AS bal
           FROM customer GROUP BY 1, 2)
SELECT c_nationkey,
  max(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN bal END) AS bal_AUTOMOBILE,
  max(CASE WHEN c_mktsegment = 'BUILDING' THEN bal END) AS bal_BUILDING,
  max(CASE WHEN c_mktsegment = 'FURNITURE' THEN bal END) AS bal_FURNITURE,
  max(CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN bal END) AS bal_HOUSEHOLD,
  max(CASE WHEN c_mktsegment = 'MACHINERY' THEN bal END) AS bal_MACHINERY
FROM f GROUP BY c_nationkey""",

    "branch_bitmask": """
WITH o AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END
             AS idx FROM orders)
SELECT o_custkey, bit_or(1 << idx) AS mask, (bit_or(1 << idx) & 1) <> 0 AS has_F,
  (bit_or(1 << idx) & 4) <> 0 AS has_P FROM o GROUP BY o_custkey""",

    "roster_left_joins": """
WITH c AS (SELECT c_custkey, c_nationkey FROM customer),
no AS (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY 1),
sp AS (SELECT o_custkey AS c_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2))
         AS spend FROM orders GROUP BY 1),
fi AS (SELECT c_custkey, first_o_orderkey FROM (
         SELECT o_custkey AS c_custkey, o_orderkey AS first_o_orderkey, row_number() OVER (
           PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) t WHERE rn = 1),
li AS (SELECT o_custkey AS c_custkey, count(*) AS n_lines FROM lineitem
       JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
ns AS (SELECT c_nationkey, count(*) AS nation_size FROM customer GROUP BY 1)
SELECT c.c_custkey, c.c_nationkey, coalesce(n_orders, 0) AS n_orders, spend, first_o_orderkey,
  coalesce(n_lines, 0) AS n_lines, nation_size
FROM c LEFT JOIN no ON c.c_custkey = no.c_custkey LEFT JOIN sp ON c.c_custkey = sp.c_custkey
LEFT JOIN fi ON c.c_custkey = fi.c_custkey LEFT JOIN li ON c.c_custkey = li.c_custkey
LEFT JOIN ns ON c.c_nationkey = ns.c_nationkey""",

    "era_feature_pivot": """
WITH e AS (SELECT user_id, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS INTEGER) AS week,
             CAST(value AS DECIMAL(18,2)) AS v FROM events)
SELECT user_id,
  CAST(coalesce(sum(CASE WHEN week = 0 THEN v END), 0) AS DECIMAL(18,2)) AS w0_value,
  CAST(count_if(week = 0) AS BIGINT) AS w0_n,
  CAST(coalesce(sum(CASE WHEN week = 1 THEN v END), 0) AS DECIMAL(18,2)) AS w1_value,
  CAST(count_if(week = 1) AS BIGINT) AS w1_n,
  CAST(coalesce(sum(CASE WHEN week = 2 THEN v END), 0) AS DECIMAL(18,2)) AS w2_value,
  CAST(count_if(week = 2) AS BIGINT) AS w2_n,
  CAST(coalesce(sum(CASE WHEN week = 3 THEN v END), 0) AS DECIMAL(18,2)) AS w3_value,
  CAST(count_if(week = 3) AS BIGINT) AS w3_n,
  CAST(coalesce(sum(CASE WHEN week = 4 THEN v END), 0) AS DECIMAL(18,2)) AS w4_value,
  CAST(count_if(week = 4) AS BIGINT) AS w4_n
FROM e GROUP BY user_id""",

    "ordered_report": """
SELECT o_orderpriority, o_orderstatus,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total
FROM orders GROUP BY 1, 2""",

    "part_class": """
WITH p AS (SELECT *, p_size >= 40 AS is_large, p_type = 'PROMO' AS is_promo,
             p_type IN ('SMALL', 'ECONOMY') AS is_small_kind FROM part)
SELECT p_partkey,
  CASE WHEN is_promo AND is_large THEN 'promo_large' WHEN is_promo THEN 'promo'
       WHEN is_small_kind AND p_size < 10 THEN 'small_cheap' ELSE 'other' END AS part_class,
  is_large, is_promo, is_small_kind,
  CASE p_type WHEN 'ECONOMY' THEN 'budget' WHEN 'SMALL' THEN 'budget' WHEN 'MEDIUM' THEN 'standard'
              WHEN 'LARGE' THEN 'standard' WHEN 'PROMO' THEN 'promo' END AS tier,
  ((is_promo OR p_brand IN ('Brand#11', 'Brand#22'))
    AND p_size IN (1, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50)) OR p_size IS NULL AS eligible
FROM p WHERE p_type IN ('ECONOMY', 'SMALL', 'MEDIUM', 'LARGE', 'PROMO')""",

    "low_signal_cut": f"""
WITH e AS (SELECT *, {_DAY} AS day FROM events WHERE value > 0 AND event_type = 'purchase'),
per AS (SELECT user_id, CAST(floor(day / 7) AS INTEGER) AS week, count(*) AS n FROM e GROUP BY 1, 2),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY week) AS share FROM per),
m AS (SELECT user_id, round(avg(share), 6) AS mean_share FROM s GROUP BY 1)
SELECT * FROM m WHERE mean_share > 0.0066""",

    "impossible_row_cut": """
SELECT l_returnflag, count(*) AS n_kept FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE) GROUP BY 1""",

    "first_of_two": """
WITH g AS (SELECT user_id,
             min(CASE WHEN event_type = 'signup' THEN ts END) AS a_ts,
             arg_min(event_id, CASE WHEN event_type = 'signup' THEN epoch_us(ts) END) AS a_id,
             min(CASE WHEN event_type = 'purchase' THEN ts END) AS b_ts,
             arg_min(event_id, CASE WHEN event_type = 'purchase' THEN epoch_us(ts) END) AS b_id
           FROM events GROUP BY 1)
SELECT user_id,
  CASE WHEN a_ts IS NULL AND b_ts IS NULL THEN 'neither' WHEN b_ts IS NULL THEN 'signup'
       WHEN a_ts IS NULL THEN 'purchase'
       WHEN a_ts < b_ts OR (a_ts = b_ts AND a_id < b_id) THEN 'signup' ELSE 'purchase' END
    AS first_event,
  CAST(a_ts IS NOT NULL AS INTEGER) AS did_signup, CAST(b_ts IS NOT NULL AS INTEGER) AS did_purchase
FROM g""",

    "supplier_running_quantity": """
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey,
  row_number() OVER w AS n_so_far,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
       AS DECIMAL(18,2)) AS qty_so_far
FROM lineitem
WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity)""",
    "stripes_map": """
WITH j AS (SELECT r_name, n_name, c_mktsegment FROM customer
           JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
per AS (SELECT r_name, n_name,
          '[' || string_agg(DISTINCT '"' || c_mktsegment || '"', ',' ORDER BY '"' || c_mktsegment || '"')
          || ']' AS segs FROM j GROUP BY 1, 2)
SELECT r_name, '{' || string_agg('"' || n_name || '":' || segs, ',' ORDER BY n_name) || '}'
  AS stripes_json FROM per GROUP BY r_name""",

    "nested_list_export": """
WITH p AS (SELECT p_type, CAST(floor(p_size / 10) AS INTEGER) AS size_band, p_brand FROM part),
per AS (SELECT p_type, size_band,
          '[' || string_agg(DISTINCT '"' || p_brand || '"', ',' ORDER BY '"' || p_brand || '"')
          || ']' AS items FROM p GROUP BY 1, 2)
SELECT p_type, '{"' || string_agg(CAST(size_band AS VARCHAR) || '":' || items, ',"'
                                  ORDER BY size_band) || '}' AS json
FROM per GROUP BY p_type""",
    "ridge_facets": """
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean,
  round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type""",

    "contribution_score": """
WITH e AS (SELECT CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS INTEGER)
             AS week, event_type, CAST(value AS DECIMAL(18,2)) AS v FROM events),
g AS (SELECT week, event_type, CAST(sum(v) AS DOUBLE) AS v FROM e GROUP BY 1, 2),
s AS (SELECT week, event_type, v / sum(v) OVER (PARTITION BY week) AS share FROM g),
weeks AS (SELECT DISTINCT week FROM s),
types AS (SELECT * FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) t(event_type)),
grid AS (SELECT w.week, t.event_type, coalesce(s.share, 0.0) AS share FROM weeks w CROSS JOIN types t
         LEFT JOIN s ON s.week = w.week AND s.event_type = t.event_type),
sc AS (SELECT event_type, sum(share) / (SELECT count(*) FROM weeks) AS score FROM grid GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, event_type) AS "rank" FROM sc)
SELECT event_type, round(score, 6) AS score, "rank" FROM r WHERE "rank" <= 3""",

    "runner_summary": """
WITH g AS (SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day,
             count(*) - 1 AS turns, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS time_sec
           FROM events GROUP BY 1, 2)
SELECT user_id, count(*) AS games, CAST(sum(turns) AS BIGINT) AS total_turns,
  round(avg(CASE WHEN turns > 0 THEN time_sec / turns END), 3) AS mean_sec_per_turn
FROM g GROUP BY user_id""",
    "first_missing_tier": f"""
WITH e AS (SELECT *, {_DAY} AS day FROM events),
e2 AS (SELECT * FROM e), n AS (SELECT max(day) + 1 AS days FROM e),
present AS (SELECT DISTINCT user_id, day FROM e2),
u AS (SELECT DISTINCT user_id FROM e2),
spine AS (SELECT u.user_id, CAST(unnest(range(0, n.days)) AS INTEGER) AS day FROM u, n),
miss AS (SELECT s.user_id, min(s.day) AS first_missing FROM spine s
         LEFT JOIN present p ON s.user_id = p.user_id AND s.day = p.day
         WHERE p.user_id IS NULL GROUP BY 1),
users AS (SELECT u.user_id, coalesce(m.first_missing, (SELECT CAST(days AS INTEGER) FROM n)) AS first_missing FROM u
          LEFT JOIN miss m ON u.user_id = m.user_id),
last AS (SELECT user_id, event_type AS last_state FROM (
           SELECT e2.user_id, e2.event_type, row_number() OVER (PARTITION BY e2.user_id
             ORDER BY e2.ts DESC, e2.event_id DESC) AS rn
           FROM e2 JOIN users ON e2.user_id = users.user_id
           WHERE e2.day < users.first_missing) t WHERE rn = 1),
j AS (SELECT users.*, last.last_state, row_number() OVER (ORDER BY first_missing, users.user_id)
        AS pos FROM users LEFT JOIN last ON users.user_id = last.user_id)
SELECT user_id, first_missing, last_state,
  CASE WHEN pos <= floor((SELECT count(*) FROM users) / 2) THEN 'left' ELSE 'right' END AS side
FROM j""",

    "stream_drop_repeats": """
SELECT DISTINCT user_id, event_type FROM events""",

    "stream_pulse_counts": """
WITH l AS (SELECT user_id, CASE WHEN event_type = 'signup' THEN 'view' ELSE event_type END AS state
           FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn
                 FROM events) t WHERE rn = 1)
SELECT e.user_id, CAST(count_if(event_type = 'signup') AS BIGINT) AS n_pulses, max(l.state) AS state
FROM events e JOIN l ON e.user_id = l.user_id GROUP BY e.user_id""",
    # recursive fold: one row per step, level before the row is applied
    "state_machine_levels": """
WITH RECURSIVE e AS (
  SELECT user_id, event_id, CAST(floor(value / 10) + 1 AS INTEGER) AS tier,
         CAST(event_type = 'purchase' AS INTEGER) AS stp,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (
  SELECT user_id, rn, event_id, 1 AS level, 0 AS steps, tier, stp FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id,
    CASE WHEN (r.tier > r.level OR r.steps + r.stp >= 3) AND r.level < 10 THEN r.level + 1
         ELSE r.level END,
    CASE WHEN ((r.tier > r.level OR r.steps + r.stp >= 3) AND r.level < 10) OR r.level >= 10 THEN 0
         ELSE r.steps + r.stp END,
    e.tier, e.stp
  FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, event_id, CAST(level AS INTEGER) AS level FROM r""",
    # one micro-batch: a key expires when its last event + 6 h is before the
    # final watermark (max event time − 1 h)
    "stream_expired_keys": """
SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_seen FROM events
GROUP BY user_id
HAVING max(ts) + INTERVAL 6 HOUR < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "era_reach": f"""
WITH f AS (SELECT user_id, event_type, min({_DAY}) AS first_day FROM events GROUP BY 1, 2)
SELECT event_type, min(first_day) AS min_day,
  round(quantile_cont(CAST(first_day AS DOUBLE), 0.5), 6) AS median_day, max(first_day) AS max_day,
  count(*) AS n, round(count(*) / (SELECT count(DISTINCT user_id) FROM events), 6) AS reach_share
FROM f GROUP BY event_type""",
}

