"""Business views over the driver tables, as SQL."""

from driftwise.config import ROUTES
from driftwise.sources.estate import (
    NOTE_WORDING,
    SALES_REGIONS,
    SIGNAL_TYPES,
    TRAFFIC_DEVICES,
    TRAFFIC_REGIONS,
)


def listing(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def pick(values, number: str) -> str:
    return f"({listing(values)})[(({number}) % {len(values)}) + 1]"


K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def traffic(industry: str) -> str:
    return (f"{pick(TRAFFIC_REGIONS, 'user_id')} AS region, "
            f"{pick(ROUTES[industry], K)} AS channel, "
            f"{pick(TRAFFIC_DEVICES, 'user_id')} AS device")


def shifted(step: str) -> str:
    return (f"TIMESTAMP '1996-01-01 00:00:00' + to_days(CAST(({step}) % 1800 AS INTEGER))"
            f" + to_hours(hour(ts)) + to_minutes(minute(ts))")


VIEWS = {
    "v_lines": """
        SELECT order_id, line_no, part_id, supplier_id, delivered_date, qty, unit_price, discount,
               status, l_tax
        FROM (SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id,
                     l_suppkey AS supplier_id, l_shipdate AS delivered_date, l_quantity AS qty,
                     l_extendedprice / l_quantity AS unit_price,
                     l_extendedprice * l_discount AS discount,
                     CASE WHEN l_returnflag = 'R' THEN 'cancelled' ELSE 'completed' END AS status,
                     l_tax,
                     row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                       ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity,
                                l_discount, l_returnflag) AS rn
              FROM lineitem)
        WHERE rn = 1""",
    "v_all_lines": """
        SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id,
               l_quantity AS qty, l_extendedprice / l_quantity AS unit_price,
               l_extendedprice * l_discount AS discount,
               CASE WHEN l_returnflag = 'R' THEN 'cancelled' ELSE 'completed' END AS status
        FROM lineitem""",
    "v_heads": """
        SELECT o_orderkey AS order_id, o_orderdate AS order_ts, r_name AS region,
               c_mktsegment AS channel, o_orderpriority AS device,
               o_custkey % 250 = 0 AS is_test, o_totalprice, o_orderstatus
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_clock": """
        SELECT * REPLACE (CASE WHEN region = 'ASIA'
                          THEN order_ts - INTERVAL 5 HOUR - INTERVAL 30 MINUTE
                          ELSE order_ts END AS order_ts) FROM v_heads""",
    "v_sales": """
        SELECT l.*, h.order_ts, h.region, h.channel, h.device, h.is_test,
               p_type AS category, p_brand AS sku, p_retailprice,
               qty * unit_price - discount AS net
        FROM v_lines l JOIN v_clock h USING (order_id) JOIN part ON p_partkey = l.part_id""",
    "v_sales_raw_clock": """
        SELECT l.*, h.order_ts, h.region, h.channel, h.device, h.is_test,
               p_type AS category, p_brand AS sku, p_retailprice
        FROM v_lines l JOIN v_heads h USING (order_id) JOIN part ON p_partkey = l.part_id""",
    "v_kept": "SELECT * FROM v_sales WHERE status <> 'cancelled'",
    "v_order_totals": """
        SELECT order_id, any_value(order_ts) AS order_ts, any_value(region) AS region,
               any_value(channel) AS channel, any_value(device) AS device,
               any_value(is_test) AS is_test,
               sum(CAST(net AS DECIMAL(18,6))) AS net, sum(CAST(qty AS DECIMAL(18,6))) AS units
        FROM v_kept GROUP BY order_id""",
    **{f"v_sessions_{i}": f"""
        SELECT ts AS session_ts, {traffic(i)}, 1 AS sessions FROM events
        WHERE event_type IN ('view', 'click')""" for i in ROUTES},
    **{f"v_purchases_{i}": f"""
        SELECT event_id AS order_id, ts AS order_ts, {traffic(i)},
               CASE WHEN value < 5 THEN 'cancelled' ELSE 'completed' END AS status,
               user_id % 25 = 0 AS is_test
        FROM events WHERE event_type = 'purchase'""" for i in ROUTES},
    "v_shipments": """
        SELECT order_id || '-' || line_no AS shipment_id,
               order_ts + INTERVAL 60 DAY AS promised_date,
               CASE WHEN order_id % 50 <> 0 THEN delivered_date END AS delivered_date,
               region, category, 'carrier-' || (supplier_id % 5) AS carrier
        FROM v_sales_raw_clock""",
    "v_plan": """
        SELECT *, CASE WHEN promo_active THEN 'promo-' || lower(category) || '-' || year(week)
                       || '-' || quarter(week) END AS promo_id
        FROM (SELECT *, (weekofyear(week) + length(category)) % 5 = 0 AS promo_active
              FROM (SELECT CAST(date_trunc('week', order_ts) AS DATE) AS week, region, category,
                           CAST(sum(CAST(qty * unit_price * l_tax AS DECIMAL(18,6))) AS DOUBLE)
                             AS marketing_spend,
                           CAST(sum(CAST(qty AS DECIMAL(18,6))) AS DOUBLE) AS planned_stock,
                           avg(unit_price / p_retailprice) AS competitor_price_index
                    FROM v_sales_raw_clock GROUP BY ALL))""",
    "v_net_day": """
        SELECT region, CAST(order_ts AS DATE) AS d, CAST(sum(net) AS DOUBLE) AS net
        FROM v_order_totals GROUP BY ALL""",
    "v_ledger": """
        SELECT region, d AS business_date,
               round(net - 0.021 * coalesce(lag(net, 3) OVER (PARTITION BY region ORDER BY d), 0.0), 2)
                 AS net_revenue_posted
        FROM v_net_day""",
    "v_documents": f"""
        SELECT doc_id,
               {pick(('support_ticket', 'release_log', 'ops_note'),
                     "CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER)")} AS doc_type,
               TIMESTAMP '1996-01-01 00:00:00' + to_days(CAST(doc_id * 37 % 1800 AS INTEGER))
                 + to_hours(doc_id % 24) AS ts,
               CASE WHEN doc_id % 11 = 0 THEN 'All' ELSE {pick(SALES_REGIONS, 'doc_id')} END AS region,
               text, lang, n_chars
        FROM documents""",
    "v_notes": f"""
        SELECT 'note-' || event_id AS doc_id,
               CASE WHEN event_id % 16 BETWEEN 9 AND 14 THEN 'support_ticket'
                    WHEN event_id % 16 IN (0, 2, 5, 8) THEN 'release_log' ELSE 'ops_note' END AS doc_type,
               {shifted('event_id * 7')} AS ts,
               CASE WHEN event_id % 13 = 0 THEN 'All' ELSE {pick(SALES_REGIONS, 'user_id')} END AS region,
               replace(replace(replace({pick(NOTE_WORDING, 'event_id')},
                 '{{k}}', CAST(10 + event_id % 90 AS VARCHAR)),
                 '{{c}}', lower({pick(("ECONOMY", "SMALL", "PROMO", "LARGE", "STANDARD", "MEDIUM"),
                                      'user_id')})),
                 '{{s}}', 'brand-' || (1 + user_id % 25)) AS text
        FROM events WHERE event_type = 'error'""",
    "v_signals": f"""
        SELECT *, valid_from + INTERVAL 24 HOUR AS valid_to,
               valid_from - to_hours(CAST(lead_time_hours AS INTEGER)) AS issued_at
        FROM (SELECT 'sig-' || event_id AS signal_id, {pick(SIGNAL_TYPES, 'event_id')} AS signal_type,
                     'city-' || (user_id % 20) AS city, {pick(SALES_REGIONS, 'user_id')} AS region,
                     CASE WHEN value >= 100 THEN 'red' WHEN value >= 50 THEN 'amber'
                          WHEN value >= 20 THEN 'yellow' ELSE 'green' END AS severity,
                     {shifted('event_id * 13')} AS valid_from,
                     CAST({K} AS DOUBLE) AS lead_time_hours,
                     event_id % 5 <> 0 AS is_public, 'publisher-' || (event_id % 7) AS publisher
              FROM events WHERE event_type = 'error')""",
    "v_freshness": """
        SELECT source_id, as_of,
               CASE WHEN source_id = 'ext_signals' THEN TIMESTAMP '2024-02-01 00:00:00'
                    ELSE TIMESTAMP '2001-12-01 00:00:00' END AS observed_at
        FROM (SELECT 'pos_txn' AS source_id, max(o_orderdate) AS as_of FROM orders
              UNION ALL SELECT 'ext_signals', max(ts) FROM events
              UNION ALL SELECT 'shipments', max(l_shipdate) FROM lineitem)""",
    "v_feedback": f"""
        SELECT 'fb-' || event_id AS feedback_id, 'run-' || (event_id % 97) AS run_id,
               {pick(('net_revenue', 'orders', 'aov'), 'user_id')} AS kpi_id,
               {pick(('confirmed', 'wrong_cause', 'missed_cause', 'not_material', 'wrong_owner',
                      'noise_source', 'comment'), 'event_id % 11')} AS judgement,
               'user-' || user_id AS submitted_by, ts AS submitted_at,
               CASE WHEN event_id % 3 <> 0 THEN 'cand-' || (event_id % 40) END AS candidate_id,
               CASE WHEN event_id % 4 = 0 THEN 'supplier shortfall' END AS correction,
               value * 100 AS movement_inr, event_id AS seq
        FROM events WHERE event_type = 'purchase'""",
    "v_outcomes": f"""
        SELECT 'case-' || doc_id AS case_id,
               {pick(('cause_verified', 'no_anomaly', 'abstain', 'cannot_verify', 'cause_verified'),
                     'doc_id')} AS expected,
               {pick(('explained', 'unknown', 'explained', 'no_movement'), 'doc_id // 3')} AS verdict,
               CAST(doc_id * 7919 % 1000 AS DOUBLE) / 1000.0 AS confidence,
               CASE WHEN doc_id % 10 < 8 THEN quality = 1 END AS top1,
               CASE WHEN doc_id % 10 < 8 THEN quality = 1 OR doc_id % 3 = 0 END AS topk,
               doc_id % 4 <> 0 AS detected, doc_id % 4 IN (1, 2) AS material_detected,
               CASE WHEN doc_id % 2 = 0 THEN toxic = 0 END AS decoy_rejected,
               CASE WHEN doc_id % 3 = 0 THEN 'train' ELSE 'test' END AS split,
               n_chars / 1000.0 AS seconds
        FROM labels JOIN documents USING (doc_id)""",
    "v_audit": """
        SELECT seq, body,
               CASE WHEN seq % 4999 = 0 THEN sha256(body || '!') ELSE sha256(body) END AS hash,
               coalesce(lag(sha256(body)) OVER (ORDER BY seq), repeat('0', 64)) AS prev
        FROM (SELECT event_id + 1 AS seq,
                     event_id || '|' || event_type || '|' || user_id || '|' || props AS body
              FROM events)""",
}
