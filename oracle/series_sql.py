"""SQL answers for source, metric and detection jobs."""

from driftwise import config
from driftwise.config import PETROLEUM, POWER, RETAIL
from oracle.views import listing

TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS ts"
SLA = ", ".join(f"('{k.kpi_id}', '{s}', {h})" for k in RETAIL.values()
                for s, h in k.sla_hours.items())
PEAKS = ", ".join(f"(DATE '{d}', {w}::DOUBLE)" for d, w in config.FESTIVALS)
CONTRACTS = ", ".join(
    f"('{k.kpi_id}', {k.min_abs_z}::DOUBLE, {k.min_abs_money}::DOUBLE, {k.value_per_unit}::DOUBLE)"
    for k in RETAIL.values())
EDGES = ", ".join(f"('{k.kpi_id}', '{p}')" for k in RETAIL.values() for p in k.parents)


def net_sql(kpi, view="v_kept", dims=None):
    dims = ", ".join(dims or kpi.dims)
    return (f"SELECT date_trunc('day', order_ts) AS ts, {dims},"
            f" CAST(sum(CAST(net AS DECIMAL(18,6))) AS DOUBLE) AS value FROM {view} GROUP BY ALL")


def orders_sql(kpi):
    return (f"SELECT date_trunc('day', order_ts) AS ts, {', '.join(kpi.dims)},"
            f" count(DISTINCT order_id) AS value FROM v_kept WHERE NOT is_test GROUP BY ALL")


def value_sql(kpi):
    return (f"SELECT *, {kpi.numerator} / nullif({kpi.denominator}, 0) AS value FROM ("
            f"SELECT date_trunc('day', order_ts) AS ts, {', '.join(kpi.dims)},"
            f" CAST(sum(CAST(net AS DECIMAL(18,6))) AS DOUBLE) AS {kpi.numerator},"
            f" CAST(count(DISTINCT order_id) AS DOUBLE) AS {kpi.denominator}"
            f" FROM v_kept WHERE NOT is_test GROUP BY ALL)")


def conversion_sql(kpi, industry):
    channels = ", ".join(f"'{c}'" for c in kpi.channels)
    return f"""
        WITH visits AS (
          SELECT date_trunc('hour', session_ts) AS ts, region, device, sum(sessions) AS s
          FROM v_sessions_{industry} WHERE channel IN ({channels}) GROUP BY ALL),
        bought AS (
          SELECT date_trunc('hour', CASE WHEN region = 'East'
                 THEN order_ts - INTERVAL 5 HOUR - INTERVAL 30 MINUTE ELSE order_ts END) AS ts,
                 region, device, count(DISTINCT order_id) AS o
          FROM v_purchases_{industry}
          WHERE channel IN ({channels}) AND status <> 'cancelled' AND NOT is_test GROUP BY ALL)
        SELECT ts, region, device, CAST(coalesce(o, 0) AS DOUBLE) / nullif(s, 0) AS value,
               CAST(coalesce(o, 0) AS DOUBLE) AS {kpi.numerator},
               CAST(s AS DOUBLE) AS {kpi.denominator}
        FROM visits LEFT JOIN bought USING (ts, region, device)"""


def on_time_sql(kpi):
    hit = "CASE WHEN delivered_date <= promised_date THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return f"""
        SELECT date_trunc('day', promised_date) AS ts, region, category, avg({hit}) AS value,
               sum({hit}) AS {kpi.numerator}, CAST(count(*) AS DOUBLE) AS {kpi.denominator}
        FROM v_shipments
        WHERE delivered_date IS NOT NULL OR promised_date < TIMESTAMP '2001-06-01 00:00:00'
        GROUP BY ALL"""


def metric_sql(kpi, industry):
    return {"net": net_sql, "orders": orders_sql, "order_value": value_sql,
            "on_time": on_time_sql}[kpi.shape](kpi) if kpi.shape != "conversion" \
        else conversion_sql(kpi, industry)


def presented(kpi, industry):
    numbers = ["value"] if kpi.shape != "orders" else []
    numbers += [c for c in (kpi.numerator, kpi.denominator) if c]
    keep = list(kpi.dims) + (["value"] if kpi.shape == "orders" else [])
    shown = ", ".join([TS.format("ts"), *keep, *(f"round({c}, 6) AS {c}" for c in numbers)])
    return f"SELECT {shown} FROM ({metric_sql(kpi, industry)})"


NAMED = {"net_revenue": "kpi_net_revenue", "orders": "kpi_orders", "aov": "kpi_aov",
         "checkout_conversion": "kpi_conversion", "on_time_delivery": "kpi_on_time"}
METRICS = {
    NAMED.get(k.kpi_id, f"kpi_{k.kpi_id}"): presented(k, industry)
    for industry, kpis in (("retail", RETAIL), ("petroleum", PETROLEUM), ("power", POWER))
    for k in kpis.values()
}

OTD, CONV = RETAIL["on_time_delivery"], RETAIL["checkout_conversion"]


def baseline_sql(source, period, phase):
    half = ((4 * period + 1) | 1) // 2
    need = max(60, 4 * period)
    return f"""
        SELECT *, (residual - centre) / scale AS z,
               expected * exp(-3.0 * scale) AS band_low, expected * exp(3.0 * scale) AS band_high
        FROM (SELECT *, CASE WHEN mad > 0 THEN mad / 0.6745 ELSE greatest(spread, 1e-6) END * noise
                        AS scale
        FROM (SELECT *, CASE WHEN typical > 0 THEN se / typical ELSE 1.0 END AS noise
        FROM (SELECT *, median(se) OVER (PARTITION BY kpi_id, region) AS typical
        FROM (SELECT *, CASE WHEN n IS NULL THEN 1.0
                   WHEN proportion THEN sqrt((1.0 - least(greatest(expected, 1e-9), 1.0 - 1e-9))
                        / (greatest(n, 1e-9) * least(greatest(expected, 1e-9), 1.0 - 1e-9)))
                   ELSE 1.0 / sqrt(greatest(n, 1e-9)) END AS se
        FROM (SELECT *, exp(log_trend + log_season + centre) * pow(festival, beta) AS expected
        FROM (SELECT *, median(abs(residual - centre)) OVER (PARTITION BY kpi_id, region) AS mad,
                     stddev_pop(residual) OVER (PARTITION BY kpi_id, region) AS spread
        FROM (SELECT *, median(residual) OVER (PARTITION BY kpi_id, region) AS centre
        FROM (SELECT *, level - log_trend - log_season AS residual
        FROM (SELECT *, median(level - log_trend) OVER (PARTITION BY kpi_id, region, phase) AS log_season
        FROM (SELECT *, avg(level) OVER (PARTITION BY kpi_id, region ORDER BY ts
                       ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS log_trend
        FROM (SELECT s.*, b.beta, raw_log - b.beta * ln(festival) AS level, {phase} AS phase,
                     count(*) OVER (PARTITION BY kpi_id, region) AS rows_held
              FROM {source} s JOIN v_beta b USING (kpi_id, region)
        ) WHERE rows_held >= {need}))))))))))"""


def mean_sql(column, period):
    over = "avg({}) OVER (PARTITION BY kpi_id, region ORDER BY pos RANGE BETWEEN {} PRECEDING AND {} FOLLOWING)"
    half = period // 2
    if period % 2:
        return over.format(column, half, half)
    return f"({over.format(column, half, half - 1)} + {over.format(column, half - 1, half)}) / 2"


def line_sql(view, x, y, reach, same):
    """(kpi_id, region, pos, fit): every reading joined to those within reach."""
    return f"""SELECT kpi_id, region, pos, CASE WHEN s0 * s2 - s1 * s1 > 1e-9
                 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END AS fit
        FROM (SELECT kpi_id, region, pos, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * y) AS t0, sum(w * d * y) AS t1
              FROM (SELECT a.kpi_id, a.region, a.pos, (b.{x} - a.{x})::DOUBLE AS d, b.{y} AS y,
                           pow(1 - pow(abs(b.{x} - a.{x}) / {reach + 1}.0::DOUBLE, 3), 3) AS w
                    FROM {view} a JOIN {view} b ON {' AND '.join(f'a.{c} = b.{c}' for c in ('kpi_id', 'region', *same))}
                      AND b.{x} BETWEEN a.{x} - {reach} AND a.{x} + {reach})
              GROUP BY ALL)"""


def fitted_views(grain, periods, unit):
    """Views of a decomposition by local lines: seasons in turn, twice, then the trend."""
    short, long = periods
    views = {f"v_fit_{grain}_0": f"""
        SELECT s.*, raw_log - b.beta * ln(festival) AS level, raw_log - b.beta * ln(festival) AS rest, b.beta,
               date_diff('{unit}', TIMESTAMP '1970-01-01', ts) AS pos, count(*) OVER (PARTITION BY kpi_id, region) AS rows_held,
               0.0::DOUBLE AS season_{short}, 0.0::DOUBLE AS season_{long}
        FROM v_logged_{grain} s JOIN v_beta b USING (kpi_id, region)"""}
    step = 0
    for period in (short, long) * 2:
        before, name = f"v_fit_{grain}_{step}", f"season_{period}"
        step += 1
        views[f"v_swing_{grain}_{step}"] = f"""
            SELECT kpi_id, region, pos, pos % {period} AS phase, pos // {period} AS cycle,
                   rest + {name} - {mean_sql(f'rest + {name}', period)} AS swing FROM {before}"""
        views[f"v_raw_{grain}_{step}"] = line_sql(f"v_swing_{grain}_{step}", "cycle", "swing", 5, ("phase",))
        views[f"v_season_{grain}_{step}"] = f"""
            SELECT kpi_id, region, pos, fit - {mean_sql('fit', period)} AS fit FROM v_raw_{grain}_{step}"""
        views[f"v_fit_{grain}_{step}"] = f"""
            SELECT * EXCLUDE (fit) REPLACE (CASE WHEN rows_held >= {4 * period} THEN fit ELSE 0.0 END AS {name},
                              rest + {name} - CASE WHEN rows_held >= {4 * period} THEN fit ELSE 0.0 END AS rest)
            FROM {before} JOIN v_season_{grain}_{step} USING (kpi_id, region, pos)"""
    last = f"v_fit_{grain}_{step}"
    views[f"v_trend_{grain}"] = f"""
        SELECT f.*, season_{short} AS season_short, season_{long} AS season_long, season_{short} + season_{long} AS log_season,
               CASE WHEN rows_held >= {4 * long} THEN l.fit ELSE s.fit END AS log_trend
        FROM {last} f JOIN ({line_sql(last, 'pos', 'rest', 2 * short, ())}) s USING (kpi_id, region, pos)
        JOIN ({line_sql(last, 'pos', 'rest', 2 * long, ())}) l USING (kpi_id, region, pos)
        WHERE rows_held >= {max(60, 4 * short)}"""
    return views


def scored_sql(parts):
    """Robust scores from level, log_trend, log_season, festival and beta."""
    whole = "OVER (PARTITION BY kpi_id, region)"
    return f"""
        SELECT *, (residual - centre) / (CASE WHEN mad > 0 THEN mad / 0.6745 ELSE greatest(spread, 1e-6) END
                    * CASE WHEN typical > 0 THEN se / typical ELSE 1.0 END) AS z
        FROM (SELECT *, median(se) {whole} AS typical
        FROM (SELECT *, CASE WHEN n IS NULL THEN 1.0
                   WHEN proportion THEN sqrt((1.0 - least(greatest(expected, 1e-9), 1.0 - 1e-9))
                        / (greatest(n, 1e-9) * least(greatest(expected, 1e-9), 1.0 - 1e-9)))
                   ELSE 1.0 / sqrt(greatest(n, 1e-9)) END AS se
        FROM (SELECT *, median(abs(residual - centre)) {whole} AS mad, stddev_pop(residual) {whole} AS spread,
                     exp(log_trend + log_season + centre) * pow(festival, beta) AS expected
        FROM (SELECT *, median(residual) {whole} AS centre
        FROM (SELECT *, level - log_trend - log_season AS residual FROM ({parts}))))))"""


VIEWS = {
    **fitted_views("day", (7, 365), "day"),
    **fitted_views("hour", (24, 168), "hour"),
    "v_peaks": f"SELECT * FROM (VALUES {PEAKS}) t(peak, weight)",
    "v_festival": """
        SELECT day, list_reduce(list_transform(list_sort(list({'p': peak, 'e': effect})), lambda x: x.e),
               lambda acc, x: CASE WHEN x >= 1 THEN greatest(acc, x) ELSE least(acc, x) END, 1.0::DOUBLE)
               AS festival
        FROM (SELECT peak + CAST(o AS INTEGER) AS day, peak,
                     CASE WHEN o <= 0 THEN 1.0 + weight * pow((18 + o) / 18.0::DOUBLE, 2)
                          ELSE 1.0 - weight * 0.25::DOUBLE * (1.0 - o / 7.0::DOUBLE) END AS effect
              FROM v_peaks, generate_series(-18, 7) g(o))
        GROUP BY day""",
    "v_region_series": """
        WITH folded AS (
          SELECT region, date_trunc('day', order_ts) AS ts, CAST(sum(net) AS DOUBLE) AS net,
                 CAST(sum(net) FILTER (NOT is_test) AS DOUBLE) AS live_net,
                 CAST(count(*) FILTER (NOT is_test) AS DOUBLE) AS orders
          FROM v_order_totals GROUP BY ALL)
        SELECT 'net_revenue' AS kpi_id, region, ts, net AS value, CAST(NULL AS DOUBLE) AS n FROM folded
        UNION ALL SELECT 'orders', region, ts, orders, NULL FROM folded
        UNION ALL SELECT 'aov', region, ts, live_net / nullif(orders, 0), orders FROM folded
                  WHERE live_net / nullif(orders, 0) IS NOT NULL""",
    "v_on_time_region": f"""
        SELECT 'on_time_delivery' AS kpi_id, region, ts,
               sum(on_time) / nullif(sum(shipments), 0) AS value, sum(shipments) AS n
        FROM ({on_time_sql(OTD)}) GROUP BY region, ts""",
    "v_conversion_region": f"""
        SELECT 'checkout_conversion' AS kpi_id, region, ts,
               sum(converted) / nullif(sum(sessions), 0) AS value, sum(sessions) AS n
        FROM ({conversion_sql(CONV, 'retail')}) GROUP BY region, ts""",
    "v_day_series": """
        SELECT s.*, coalesce(festival, 1.0::DOUBLE) AS festival, kpi_id = 'on_time_delivery' AS proportion
        FROM (SELECT * FROM v_region_series UNION ALL SELECT * FROM v_on_time_region) s
        LEFT JOIN v_festival f ON f.day = CAST(s.ts AS DATE)""",
    "v_hour_series": """
        SELECT s.*, coalesce(festival, 1.0::DOUBLE) AS festival, TRUE AS proportion
        FROM v_conversion_region s LEFT JOIN v_festival f ON f.day = CAST(s.ts AS DATE)
        WHERE value IS NOT NULL""",
    "v_fitted": """
        SELECT *, CASE WHEN n IS NOT NULL THEN (value * n + 0.5) / (n + 1.0) ELSE value END AS fitted
        FROM (SELECT *, 'day' AS grain FROM v_day_series
              UNION ALL SELECT *, 'hour' AS grain FROM v_hour_series)""",
    "v_logged": """
        SELECT *, ln(greatest(fitted, greatest(coalesce(
                 min(fitted) FILTER (fitted > 0) OVER (PARTITION BY kpi_id, region) * 1e-3, 1e-9), 1e-9)))
               AS raw_log
        FROM v_fitted""",
    "v_beta": """
        SELECT kpi_id, region, CASE WHEN max(abs(ln(festival))) <= 1e-8 THEN 0.0::DOUBLE
               ELSE greatest(0.0, least(1.5, coalesce(regr_slope(raw_log, ln(festival)), 0.0))) END AS beta
        FROM v_logged GROUP BY kpi_id, region""",
    "v_logged_day": "SELECT * FROM v_logged WHERE grain = 'day'",
    "v_logged_hour": "SELECT * FROM v_logged WHERE grain = 'hour'",
    "v_scored": f"""
        SELECT * FROM ({baseline_sql('v_logged_day', 7, 'dayofweek(ts)')})
        UNION ALL SELECT * FROM ({baseline_sql('v_logged_hour', 24, 'hour(ts)')})""",
    "v_contracts": f"SELECT * FROM (VALUES {CONTRACTS}) t(kpi_id, min_z, min_money, unit_value)",
    "v_flagged": """
        SELECT *, abs(delta) * unit_value AS impact, abs(delta) * unit_value >= min_money AS material
        FROM (SELECT s.*, c.min_money, c.unit_value, value - expected AS delta,
                     CASE WHEN z < 0 THEN 'drop' ELSE 'spike' END AS direction
              FROM v_scored s JOIN v_contracts c USING (kpi_id) WHERE abs(z) >= min_z)""",
    "v_findings": """
        SELECT kpi_id, region, direction, min(day) AS start_day, max(day) AS end_day, count(*) AS days,
               arg_min(day, ord) AS worst_day, arg_min(delta, ord) AS delta,
               arg_min(CASE WHEN expected <> 0 THEN delta / expected END, ord) AS pct,
               arg_min(z, ord) AS z, sum(abs(delta)) / count(*) * any_value(unit_value) AS impact
        FROM (SELECT *, CASE WHEN direction = 'drop' THEN delta ELSE -delta END AS ord,
                     sum(fresh) OVER (PARTITION BY kpi_id, region, direction ORDER BY ts) AS episode
              FROM (SELECT *, CAST(ts AS DATE) AS day,
                           CASE WHEN CAST(ts AS DATE) - lag(CAST(ts AS DATE)) OVER (
                             PARTITION BY kpi_id, region, direction ORDER BY ts) > 2
                           THEN 1 ELSE 0 END AS fresh
                    FROM v_flagged WHERE material))
        GROUP BY kpi_id, region, direction, episode""",
    "v_daily_facts": """
        SELECT region, CAST(order_ts AS DATE) AS d, CAST(sum(net) AS DOUBLE) AS revenue,
               CAST(sum(units) AS DOUBLE) AS units FROM v_order_totals GROUP BY ALL""",
    "v_drivers": """
        SELECT f.region, f.d, revenue / nullif(units, 0) AS realised_price,
               w.marketing_spend, w.planned_stock, w.competitor_price_index
        FROM v_daily_facts f ASOF LEFT JOIN (
          SELECT region, week, sum(marketing_spend) AS marketing_spend,
                 sum(planned_stock) AS planned_stock, avg(competitor_price_index) AS competitor_price_index
          FROM v_plan GROUP BY ALL) w ON f.region = w.region AND f.d >= w.week""",
    "v_edges": f"SELECT * FROM (VALUES {EDGES}) t(child, parent)",
    "v_up": """SELECT child AS kpi_id, parent AS ancestor FROM v_edges
        UNION SELECT v_up.kpi_id, e.parent FROM v_up JOIN v_edges e ON e.child = v_up.ancestor""",
    # One finding after the other, in each region: the members so far, each with its event's number.
    "v_ranked": """SELECT f.*, row_number() OVER (PARTITION BY region ORDER BY impact DESC, f.kpi_id, start_day, end_day, direction) AS n,
        (SELECT list(DISTINCT o) FROM (SELECT ancestor AS o FROM v_up WHERE kpi_id = f.kpi_id
           UNION SELECT kpi_id FROM v_up WHERE ancestor = f.kpi_id)) AS kin
        FROM v_findings f""",
    "v_walk": """SELECT DISTINCT region, 0::BIGINT AS at, []::STRUCT(n BIGINT, k VARCHAR, s DATE, e DATE, g BIGINT)[] AS held
        FROM v_ranked
        UNION ALL SELECT w.region, f.n, list_append(w.held, {'n': f.n, 'k': f.kpi_id, 's': f.start_day, 'e': f.end_day,
          'g': coalesce(list_min(list_filter(
             list_transform(list_filter(w.held, lambda m: m.s <= f.end_day AND f.start_day <= m.e
               AND coalesce(list_contains(f.kin, m.k), false)), lambda m: m.g),
             lambda x: NOT list_contains(list_transform(list_filter(w.held, lambda m: m.k = f.kpi_id), lambda m: m.g), x))), f.n)})
        FROM v_walk w JOIN v_ranked f ON f.region = w.region AND f.n = w.at + 1""",
    "v_events": """SELECT region, unnest(held, recursive := true) FROM v_walk w
        WHERE w.at = (SELECT max(x.at) FROM v_walk x WHERE x.region = w.region)""",
}

ANSWERS = {
    "scan_limit": """SELECT l_returnflag AS status, count(*) AS rows, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units,
        max(l_orderkey) AS last_order FROM lineitem GROUP BY 1""",
    "docs_window": f"""SELECT doc_id, doc_type, {TS.format('ts')}, region, n_chars FROM v_documents
        WHERE v_documents.ts BETWEEN TIMESTAMP '1996-06-01' AND TIMESTAMP '1997-06-01'""",
    "dedupe": """SELECT status, count(*) AS lines, CAST(sum(part_id) AS BIGINT) AS parts,
        CAST(sum(CAST(qty AS BIGINT)) AS BIGINT) AS units FROM v_lines GROUP BY status""",
    "tz_normalise": """SELECT region, strftime(order_ts, '%Y-%m-%d') AS day, count(*) AS orders,
        min(strftime(order_ts, '%H:%M')) AS first_clock FROM v_clock GROUP BY ALL""",
    "lineage_filters": """SELECT region, channel, status, count(*) AS orders FROM v_purchases_retail
        WHERE NOT is_test AND channel IN ('web', 'app') GROUP BY ALL""",
    "lineage_chain": """SELECT region, status, count(*) AS lines,
        CAST(sum(CAST(qty AS BIGINT)) AS BIGINT) AS units
        FROM v_sales WHERE NOT is_test GROUP BY ALL""",
    "materialised_series": """SELECT region, strftime(d, '%Y-%m-%d') AS day, round(net, 4) AS value
        FROM v_net_day""",
    "freshness": f"""SELECT kpi_id, source_id, sla_hours, round(lag_hours, 4) AS lag_hours,
        lag_hours <= sla_hours AS sla_met
        FROM (SELECT s.kpi_id, s.source_id, s.sla_hours,
                     coalesce(date_sub('second', as_of, observed_at) / 3600.0::DOUBLE, s.sla_hours + 1.0)
                     AS lag_hours
              FROM (VALUES {SLA}) s(kpi_id, source_id, sla_hours) LEFT JOIN v_freshness USING (source_id))""",
    "entitled_series": f"""SELECT {TS.format('ts')}, region, channel, round(value, 4) AS value
        FROM (SELECT date_trunc('day', order_ts) AS ts, region, channel,
                     CAST(sum(CAST(net AS DECIMAL(18,6))) AS DOUBLE) AS value FROM v_kept GROUP BY ALL)
        WHERE region IN ('ASIA', 'EUROPE')""",
    "column_mask": "SELECT s_suppkey, s_name, s_nationkey FROM supplier",
    "reproduce_diff": """SELECT count(*) AS rows, 0 AS unmatched, 0 AS differing FROM v_net_day""",
    "row_export": f"""SELECT {TS.format('ts')}, round(value, 6) AS value, n,
        ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 23:00:00' AS in_window
        FROM (SELECT ts AS ts, sum(converted) / nullif(sum(sessions), 0) AS value, sum(sessions) AS n
              FROM ({conversion_sql(CONV, 'retail')}) GROUP BY ts) q""",
    "invoice_status": """SELECT CASE WHEN o_orderstatus = 'F' THEN 'cancelled' ELSE 'complete' END AS status,
        count(*) AS invoices, 0.0::DOUBLE AS discount FROM orders GROUP BY 1""",
    "replicated_facts": """SELECT region || '-r' || k AS region, count(DISTINCT order_id) AS orders,
        round(CAST(sum(net) AS DOUBLE), 4) AS value
        FROM v_order_totals, generate_series(0, 3) g(k) GROUP BY 1""",
    "latest_day": """SELECT strftime(max(d), '%Y-%m-%d') AS latest_day FROM (
        SELECT max(o_orderdate) AS d FROM orders UNION ALL SELECT max(ts) FROM events
        UNION ALL SELECT max(promised_date) FROM v_shipments)""",
    "dimension_values": " UNION ".join(
        f"SELECT '{d}' AS dimension, {d} AS value FROM v_sales WHERE region IN ('ASIA', 'EUROPE')"
        f" AND {d} IS NOT NULL" for d in config.SALES_DIMS),
    **METRICS,
    "kpi_uk_net_revenue": f"""SELECT {TS.format('ts')}, region, round(value, 6) AS value FROM (
        SELECT date_trunc('day', order_ts) AS ts, region,
               CAST(sum(CAST(qty * unit_price - discount AS DECIMAL(18,6))) AS DOUBLE) AS value
        FROM v_all_lines JOIN v_heads USING (order_id) WHERE status <> 'cancelled' GROUP BY ALL)""",
    "rollup_sum": f"""SELECT {TS.format('d')}, round(sum(net), 4) AS value FROM v_net_day GROUP BY 1""",
    "rollup_mean": f"""SELECT {TS.format('ts')}, round(avg(value), 8) AS value FROM (
        SELECT date_trunc('day', order_ts) AS ts, region, channel,
               CAST(sum(CAST(net AS DECIMAL(18,6))) AS DOUBLE) AS value FROM v_kept GROUP BY ALL)
        GROUP BY ALL""",
    "rollup_ratio": f"""SELECT {TS.format('ts')}, round(sum(on_time) / nullif(sum(shipments), 0), 6) AS value,
        sum(shipments) AS n FROM ({on_time_sql(OTD)}) GROUP BY ALL""",
    "slice_series": f"""SELECT {TS.format("date_trunc('day', order_ts)")},
        round(CAST(sum(CAST(net AS DECIMAL(18,6))) AS DOUBLE), 4) AS value
        FROM v_kept WHERE region = 'ASIA' AND category = 'PROMO' GROUP BY 1""",
    "bridge_facts": """SELECT strftime(order_ts, '%Y-%m-%d') AS d, sku, region, channel, category, device,
        round(CAST(sum(CAST(qty AS DECIMAL(18,6))) AS DOUBLE), 4) AS units,
        round(CAST(sum(CAST(net AS DECIMAL(18,6))) AS DOUBLE), 4) AS revenue
        FROM v_kept WHERE order_ts >= TIMESTAMP '1996-01-01' AND order_ts < TIMESTAMP '1998-01-01'
        GROUP BY ALL""",
    "per_day": """SELECT region, strftime(y, '%Y-%m-%d') AS year_start,
        date_diff('day', y, y + INTERVAL 12 MONTH) AS days,
        round(net / date_diff('day', y, y + INTERVAL 12 MONTH), 4) AS per_day
        FROM (SELECT region, date_trunc('year', order_ts) AS y, CAST(sum(net) AS DOUBLE) AS net
              FROM v_order_totals GROUP BY ALL)""",
    "money_impact": """SELECT kpi_id, region, round(move, 4) AS move, round(move * unit_value, 2) AS impact
        FROM (SELECT kpi_id, region, max(abs(value - before)) AS move FROM (
                SELECT *, lag(value) OVER (PARTITION BY kpi_id, region ORDER BY ts) AS before
                FROM v_region_series) GROUP BY ALL) JOIN v_contracts USING (kpi_id)""",
    "plan_asof": """SELECT region, strftime(d, '%Y-%m-%d') AS d, round(marketing_spend, 4) AS marketing_spend,
        round(planned_stock, 4) AS planned_stock,
        round(competitor_price_index, 4) AS competitor_price_index FROM v_drivers""",
    "driver_series": """SELECT region, strftime(d, '%Y-%m-%d') AS d,
        round(realised_price, 9) AS realised_price, round(marketing_spend, 4) AS marketing_spend,
        round(planned_stock, 4) AS planned_stock,
        round(competitor_price_index, 4) AS competitor_price_index FROM v_drivers""",
    "festival_factor": """SELECT strftime(d, '%Y-%m-%d') AS day,
        round(coalesce(festival, 1.0::DOUBLE), 8) AS festival
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) LEFT JOIN v_festival ON day = d""",
    "festival_beta": """SELECT kpi_id, region, round(beta, 8) AS beta FROM v_beta
        WHERE kpi_id <> 'checkout_conversion'""",
    "half_count": f"""SELECT region, {TS.format('ts')}, round(fitted, 8) AS fitted, round(raw_log, 8) AS raw_log
        FROM v_logged_hour""",
    "seasonal_baseline": f"""SELECT kpi_id, region, {TS.format('ts')}, round(log_trend, 6) AS log_trend,
        round(log_season, 6) AS log_season, round(residual, 6) AS residual FROM v_scored""",
    "robust_z": f"""SELECT kpi_id, region, {TS.format('ts')}, round(centre, 5) AS centre,
        round(mad, 5) AS mad, round(z, 5) AS z FROM v_scored""",
    "loess_baseline": " UNION ALL ".join(f"""SELECT kpi_id, region, {TS.format('ts')}, round(log_trend, 5) AS log_trend,
        round(log_season, 5) AS log_season, round(season_short, 5) AS season_short, round(season_long, 5) AS season_long,
        round(ln(expected), 5) AS log_expected, round(z, 5) AS z FROM ({scored_sql(f'SELECT * FROM v_trend_{grain}')})""" for grain in ("day", "hour")),
    "noise_profile": f"""SELECT kpi_id, region, {TS.format('ts')}, round(noise, 6) AS noise,
        round(scale, 6) AS scale FROM v_scored WHERE n IS NOT NULL""",
    "expected_band": f"""SELECT kpi_id, region, {TS.format('ts')}, round(expected, 4) AS expected,
        round(band_low, 4) AS band_low, round(band_high, 4) AS band_high FROM v_scored""",
    "anomalies": f"""SELECT kpi_id, region, {TS.format('ts')}, direction, round(delta, 4) AS delta,
        round(z, 4) AS z FROM v_flagged""",
    "material": f"""SELECT kpi_id, region, {TS.format('ts')}, direction, round(impact, 2) AS impact
        FROM v_flagged WHERE material""",
    "sparse_series": """SELECT kpi_id, region, count(*) AS observations,
        CASE WHEN count(*) < 208 THEN 'sparse_history' ELSE 'fitted' END AS verdict,
        round(arg_min(value, ts), 6) AS first, round(arg_max(value, ts), 6) AS last,
        round(CASE WHEN arg_min(value, ts) <> 0 THEN arg_max(value, ts) / arg_min(value, ts) - 1.0 END, 6)
          AS change_pct
        FROM (SELECT channel || '/' || device AS kpi_id, region, date_trunc('week', order_ts) AS ts,
                     CAST(sum(CAST(net AS DECIMAL(18,6))) AS DOUBLE) AS value
              FROM v_kept GROUP BY ALL) GROUP BY kpi_id, region""",
    "episodes": """SELECT kpi_id, region, direction, strftime(start_day, '%Y-%m-%d') AS start,
        strftime(end_day, '%Y-%m-%d') AS "end", days, strftime(worst_day, '%Y-%m-%d') AS worst_day,
        round(delta, 4) AS delta, round(pct, 4) AS pct, round(z, 4) AS z, round(impact, 4) AS impact
        FROM v_findings""",
    "triage_topk": """SELECT kpi_id, region, direction, strftime(start_day, '%Y-%m-%d') AS start,
        strftime(end_day, '%Y-%m-%d') AS "end", days, round(impact, 2) AS impact FROM v_findings
        ORDER BY v_findings.impact DESC, kpi_id, region, start_day LIMIT 12""",
    "triage_recent": """SELECT kpi_id, region, strftime(start_day, '%Y-%m-%d') AS start,
        strftime(end_day, '%Y-%m-%d') AS "end", round(impact, 2) AS impact FROM v_findings
        WHERE direction = 'drop'
          AND end_day >= (SELECT CAST(max(ts) AS DATE) - 730 FROM v_region_series)
        ORDER BY v_findings.impact DESC, kpi_id, region, start_day LIMIT 12""",
    "kpi_closure": """SELECT kpi_id, ancestor, coalesce(n, 0) AS findings FROM v_up
        LEFT JOIN (SELECT kpi_id, count(*) AS n FROM v_findings GROUP BY kpi_id) USING (kpi_id)""",
    "folded_findings": """SELECT region, kpi_id, direction, strftime(start_day, '%Y-%m-%d') AS start,
        strftime(end_day, '%Y-%m-%d') AS "end", round(impact, 2) AS impact, coalesce(also_moved, '') AS also_moved
        FROM (SELECT f.*, row_number() OVER (PARTITION BY region, g ORDER BY
                (SELECT count(DISTINCT ancestor) FROM v_up u WHERE u.kpi_id = f.kpi_id), f.n) AS place,
              string_agg(f.kpi_id, ',' ORDER BY f.kpi_id) OVER (PARTITION BY region, g
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS also_moved
              FROM v_ranked f JOIN (SELECT region, n, g FROM v_events) USING (region, n))
        WHERE place = 1""",
    "expected_direction": """SELECT finding_id, round(nullif(sum(value - expected), 0), 3) AS gap
        FROM (SELECT kpi_id || '|' || region || '|' || direction || '|' || strftime(start_day, '%Y-%m-%d')
                     AS finding_id, kpi_id, region, start_day, end_day FROM v_findings) f
        JOIN v_scored s ON s.kpi_id = f.kpi_id AND s.region = f.region
          AND CAST(s.ts AS DATE) BETWEEN start_day AND end_day GROUP BY finding_id""",
    "overview": """WITH recent AS (
          SELECT *, held - back AS ahead, greatest(held // 60, 1) AS step FROM (
            SELECT *, count(*) OVER (PARTITION BY kpi_id, region) AS held,
                   row_number() OVER (PARTITION BY kpi_id, region ORDER BY ts DESC) AS back
            FROM v_scored s WHERE ts > (SELECT max(ts) FROM v_scored t WHERE t.kpi_id = s.kpi_id AND t.region = s.region) - INTERVAL 365 DAY)),
        summary AS (
          SELECT kpi_id, region, arg_max(value, ts) AS latest, arg_max(expected, ts) AS expected,
                 min(CAST(ts AS DATE)) AS since,
                 CASE WHEN avg(value) FILTER (ahead < 7) <> 0 THEN avg(value) FILTER (back <= 7)
                      / avg(value) FILTER (ahead < 7) - 1 END AS period_change,
                 count(*) FILTER (ahead % step = 0) AS spark_points,
                 string_agg(CAST(round(value, 9) AS DECIMAL(28,9))::VARCHAR, ' ' ORDER BY ts) FILTER (ahead % step = 0) AS line,
                 string_agg(CAST(round(expected, 4) AS DECIMAL(28,4))::VARCHAR, ' ' ORDER BY ts) FILTER (ahead % step = 0) AS expected_line
          FROM recent GROUP BY ALL),
        marks AS (
          SELECT f.kpi_id, f.region, count(*) AS movements,
                 count(*) FILTER (direction = 'drop') AS drops,
                 arg_min(strftime(ts, '%Y-%m-%d'), delta) FILTER (direction = 'drop') AS worst_day,
                 arg_min(value / f.expected - 1, delta) FILTER (direction = 'drop') AS worst_pct
          FROM v_flagged f JOIN summary s ON s.kpi_id = f.kpi_id AND s.region = f.region
          WHERE material AND CAST(ts AS DATE) >= since GROUP BY ALL)
        SELECT kpi_id, region, round(latest, 4) AS latest, round(expected, 4) AS expected,
               round(period_change, 4) AS period_change, spark_points, line, expected_line,
               coalesce(movements, 0) AS movements, coalesce(drops, 0) AS drops, worst_day,
               round(worst_pct, 4) AS worst_pct
        FROM summary LEFT JOIN marks USING (kpi_id, region)""",
    "signal_days": f"""SELECT strftime(valid_from, '%Y-%m-%d') AS day, signal_type, count(*) AS warnings,
        max(lead_time_hours) AS lead_time_hours,
        arg_max(severity, list_position({listing(('green', 'yellow', 'amber', 'orange', 'red'))}, severity))
          AS severity,
        string_agg(DISTINCT city, ',' ORDER BY city) AS cities,
        string_agg(DISTINCT region, ',' ORDER BY region) AS regions
        FROM v_signals GROUP BY 1, 2""",
    "promo_weeks": """SELECT strftime(week, '%Y-%m-%d') AS week, promo_id,
        round(sum(marketing_spend), 4) AS spend,
        string_agg(DISTINCT region, ',' ORDER BY region) AS regions,
        string_agg(DISTINCT category, ',' ORDER BY category) AS categories
        FROM v_plan WHERE promo_active GROUP BY 1, 2""",
    "calendar_band": """SELECT kind, strftime(day, '%Y-%m-%d') AS day,
        CASE WHEN day <= DATE '1998-09-30' THEN 'behind' ELSE 'ahead' END AS side, round(size, 4) AS size
        FROM (SELECT 'signal' AS kind, CAST(valid_from AS DATE) AS day, CAST(count(*) AS DOUBLE) AS size
              FROM v_signals WHERE CAST(valid_from AS DATE) <= DATE '1998-09-30'
                AND CAST(valid_to AS DATE) >= DATE '1998-07-01' GROUP BY ALL
              UNION ALL SELECT 'promotion', week, sum(marketing_spend) FROM v_plan
              WHERE promo_active AND week BETWEEN DATE '1998-07-01' AND DATE '1999-01-28' GROUP BY ALL
              UNION ALL SELECT 'calendar', peak, festival - 1 FROM v_peaks JOIN v_festival ON day = peak
              WHERE peak BETWEEN DATE '1998-07-01' AND DATE '1999-01-28')""",
}
