"""SQL answers for decomposition, candidate and causal jobs."""

import re

from driftwise.functions.text import BONES
from driftwise.plans.cause_jobs import SALES_SCOPE


def longest(text: str, terms: dict[str, str]) -> str:
    cases = " ".join(
        f"WHEN regexp_matches(lower({text}), '(^|[^a-z0-9]){p}(s|es)?([^a-z0-9]|$)') THEN '{v}'"
        for p, v in sorted(terms.items(), key=lambda kv: -len(kv[0])))
    return f"CASE {cases} END"


def bone(kind: str, text: str) -> str:
    body = f"(' ' || lower(regexp_replace({text}, '^[^:\\s]{{1,32}}:\\s*', '')) || ' ')"
    arms = [f"WHEN {kind} = 'release_log' THEN 'platform'", f"WHEN {kind} = 'promotion' THEN 'demand'"]
    for name, words in BONES:
        pattern = "|".join("\\b" + re.escape(w.strip()).replace("\\ ", " ")
                           + ("\\b" if w.endswith(" ") else "") for w in words)
        arms.append(f"WHEN regexp_matches({body}, '{pattern}') THEN '{name}'")
    return f"CASE {' '.join(arms)} ELSE 'other' END"


IDENT = r"""CASE
    WHEN contains(text, ':') AND length(split_part(text, ':', 1)) <= 60
         AND len(list_filter(string_split_regex(trim(split_part(text, ':', 1)), '\s+'),
                             lambda t: regexp_matches(t, '[0-9]'))) > 0
    THEN trim(list_filter(string_split_regex(trim(split_part(text, ':', 1)), '\s+'),
                     lambda t: regexp_matches(t, '[0-9]'))[-1], '.,;')
    ELSE string_split_regex(text, '[:\s]')[1] END"""

SPANS = """
    SELECT finding_id, doc_id, 'during' AS w, start_day AS lo, end_day AS hi FROM v_kept_candidates
    UNION ALL SELECT finding_id, doc_id, 'before', start_day - 14, start_day - 1 FROM v_kept_candidates
    UNION ALL SELECT finding_id, doc_id, 'earlier', start_day - 28, start_day - 15 FROM v_kept_candidates
    UNION ALL SELECT finding_id, doc_id, 'quiet' || k,
        start_day - 15 - CAST(k * 14 AS INTEGER) - CAST(greatest(end_day - start_day, 1) AS INTEGER),
        start_day - 15 - CAST(k * 14 AS INTEGER) FROM v_kept_candidates, generate_series(1, 6) g(k)
    UNION ALL SELECT finding_id, doc_id, 'prior' || k,
        start_day - 29 - CAST(k * 14 AS INTEGER) - CAST(greatest(end_day - start_day, 1) AS INTEGER),
        start_day - 16 - CAST(k * 14 AS INTEGER) - CAST(greatest(end_day - start_day, 1) AS INTEGER)
        FROM v_kept_candidates, generate_series(1, 6) g(k)"""

VIEWS = {
    "v_cases": """
        SELECT region || '|' || direction || '|' || strftime(start_day, '%Y-%m-%d') AS finding_id,
               region, start_day AS case_start, end_day AS case_end
        FROM v_findings WHERE kpi_id = 'net_revenue'""",
    "v_booked": """
        SELECT region, CAST(order_ts AS DATE) AS d,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,6))) AS DOUBLE) AS secondary
        FROM v_heads GROUP BY ALL""",
    "v_compared": """
        SELECT 'finance_ledger' AS source, finding_id, n.d, n.net AS primary_value,
               net_revenue_posted AS secondary
        FROM v_cases c JOIN v_net_day n ON n.region = c.region AND n.d BETWEEN case_start AND case_end
        JOIN v_ledger l ON l.region = n.region AND l.business_date = n.d
        UNION ALL
        SELECT 'order_headers', finding_id, n.d, n.net, secondary
        FROM v_cases c JOIN v_net_day n ON n.region = c.region AND n.d BETWEEN case_start AND case_end
        JOIN v_booked b ON b.region = n.region AND b.d = n.d""",
    "v_gaps": """
        SELECT *, CASE WHEN secondary = 0 OR secondary IS NULL THEN 0.0
                       ELSE (primary_value - secondary) / secondary END AS residual FROM v_compared""",
    "v_facts": """
        SELECT CAST(order_ts AS DATE) AS d, sku, region, channel, category, device,
               CAST(sum(CAST(qty AS DECIMAL(18,6))) AS DOUBLE) AS units,
               CAST(sum(CAST(net AS DECIMAL(18,6))) AS DOUBLE) AS revenue
        FROM v_kept GROUP BY ALL""",
    "v_period_facts": """
        SELECT c.finding_id, f.*, f.d < case_start AS is_base, case_end - case_start + 1 AS length
        FROM v_cases c JOIN v_facts f ON f.region = c.region
          AND f.d BETWEEN case_start - 14 AND case_end""",
    "v_by_sku": """
        SELECT finding_id, sku, coalesce(sum(units) FILTER (is_base), 0) / 14 AS u0,
               coalesce(sum(units) FILTER (NOT is_base), 0) / any_value(length) AS u1,
               coalesce(sum(revenue) FILTER (is_base), 0) / 14 AS r0,
               coalesce(sum(revenue) FILTER (NOT is_base), 0) / any_value(length) AS r1
        FROM v_period_facts GROUP BY finding_id, sku""",
    "v_priced": """
        SELECT *, coalesce(r0 / nullif(u0, 0), r1 / nullif(u1, 0), 0) AS p0,
               coalesce(r1 / nullif(u1, 0), r0 / nullif(u0, 0), 0) AS p1,
               u0 / nullif(sum(u0) OVER (PARTITION BY finding_id), 0) AS s0,
               CASE WHEN sum(u1) OVER (PARTITION BY finding_id) > 0
                    THEN u1 / sum(u1) OVER (PARTITION BY finding_id) ELSE 0 END AS s1
        FROM v_by_sku""",
    "v_pvm": """
        SELECT finding_id, sum(r0) AS base_revenue, sum(r1) AS current_revenue,
               (sum(u1) - sum(u0)) * sum(s0 * p0) AS volume,
               sum(u1) * sum((s1 - s0) * p0) AS mix, sum(u1) * sum(s1 * (p1 - p0)) AS price,
               count(*) AS products, sum(u0) AS q0
        FROM v_priced GROUP BY finding_id""",
    "v_slices": """
        SELECT *, current - base AS delta, sum(current - base) OVER (PARTITION BY finding_id, dimension) AS total
        FROM (SELECT finding_id, dimension, slice,
                     coalesce(sum(revenue) FILTER (is_base), 0) / 14 AS base,
                     coalesce(sum(revenue) FILTER (NOT is_base), 0) / any_value(length) AS current
              FROM (UNPIVOT (SELECT finding_id, is_base, length, revenue, channel, category, device, sku
                             FROM v_period_facts) ON channel, category, device, sku
                    INTO NAME dimension VALUE slice)
              GROUP BY finding_id, dimension, slice)""",
    "v_moved": """
        SELECT finding_id, coalesce(sum(net) FILTER (d < case_start), 0) / 14 AS base_revenue,
               coalesce(sum(net) FILTER (d >= case_start), 0)
                 / any_value(case_end - case_start + 1) AS current_revenue
        FROM v_cases c JOIN v_net_day n ON n.region = c.region AND n.d BETWEEN case_start - 14 AND case_end
        GROUP BY finding_id""",
    "v_direction": "SELECT finding_id, sign(current_revenue - base_revenue) AS movement FROM v_moved",
    "v_driver_days": "SELECT p.*, n.net FROM v_drivers p JOIN v_net_day n USING (region, d)",
    "v_brands": """
        SELECT DISTINCT p_brand AS sku, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS code
        FROM part""",
    "v_sku_mentions": """
        SELECT doc_id, arg_max(sku, length(sku)) AS sku
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z]+)[-_ ]?([0-9]+)')) AS said
              FROM v_notes) JOIN v_brands ON code = lower(regexp_replace(said, '[-_ ]', '', 'g'))
        GROUP BY doc_id""",
    "v_undoing": """
        SELECT *, regexp_matches(lower(text),
                 '\\b(roll(ed)?[- ]?back|revert(ed)?|hotfix(ed)?)\\b') AS undoes FROM v_notes""",
    "v_note_scope": f"""
        SELECT doc_id, doc_type AS kind, CAST(ts AS DATE) AS start_day, region AS note_region, text,
               {IDENT} AS candidate_id,
               {', '.join(f"{longest('text', t)} AS {dim}" for dim, t in SALES_SCOPE.items())}
        FROM v_undoing WHERE doc_type IN ('release_log', 'ops_note') AND NOT undoes""",
    "v_parsed": "SELECT n.*, s.sku FROM v_note_scope n LEFT JOIN v_sku_mentions s USING (doc_id)",
    "v_note_candidates": """
        SELECT c.finding_id, c.region, case_start, case_end, p.doc_id, candidate_id, kind, start_day,
               case_end AS end_day,
               CASE WHEN note_region = 'All' THEN CAST([] AS VARCHAR[]) ELSE [note_region] END AS exposed,
               channel, device, category, sku, text AS description
        FROM v_cases c JOIN v_parsed p ON p.start_day BETWEEN case_start - 10 AND case_end""",
    "v_plan_candidates": """
        SELECT finding_id, any_value(c.region) AS region, case_start, case_end, promo_id AS doc_id,
               promo_id AS candidate_id, 'promotion' AS kind,
               greatest(min(week), case_start - 14) AS start_day, case_end AS end_day,
               list_sort(list(DISTINCT p.region)) AS exposed,
               CAST(NULL AS VARCHAR) AS channel, CAST(NULL AS VARCHAR) AS device,
               CASE WHEN count(DISTINCT category) = 1 THEN min(category) END AS category,
               CAST(NULL AS VARCHAR) AS sku,
               'Promotion ' || promo_id || ' active in '
                 || array_to_string(list_sort(list(DISTINCT p.region)), ', ') AS description
        FROM v_cases c JOIN v_plan p ON promo_active AND week BETWEEN case_start - 14 AND case_end
        GROUP BY finding_id, case_start, case_end, promo_id""",
    "v_candidates": """
        SELECT * FROM v_note_candidates UNION ALL BY NAME SELECT * FROM v_plan_candidates""",
    "v_gated": """
        SELECT *, CASE WHEN end_day < case_start - 7 THEN 'ended before the movement began'
                       WHEN start_day > case_end + 2 THEN 'began after the movement ended'
                       WHEN len(exposed) > 0 AND NOT list_contains(exposed, region)
                       THEN 'was confined to ' || array_to_string(exposed, ', ') END AS set_aside
        FROM v_candidates""",
    "v_kept_candidates": "SELECT * FROM v_gated WHERE set_aside IS NULL",
    "v_spans": SPANS,
    "v_region_windows": """
        SELECT s.finding_id, s.doc_id, s.w, f.region, list_contains(c.exposed, f.region) AS treated,
               sum(f.revenue) AS total, s.hi - s.lo + 1 AS days
        FROM v_spans s JOIN v_kept_candidates c ON c.finding_id = s.finding_id AND c.doc_id = s.doc_id
        JOIN v_facts f ON f.d BETWEEN s.lo AND s.hi
          AND (c.channel IS NULL OR c.channel = f.channel) AND (c.device IS NULL OR c.device = f.device)
          AND (c.category IS NULL OR c.category = f.category) AND (c.sku IS NULL OR c.sku = f.sku)
        GROUP BY s.finding_id, s.doc_id, s.w, f.region, treated, days""",
    "v_means": """
        SELECT finding_id, doc_id, w, sum(total) FILTER (treated) / any_value(days) AS t,
               sum(total) FILTER (NOT treated) / any_value(days) AS c
        FROM v_region_windows GROUP BY finding_id, doc_id, w""",
    "v_wide": """
        SELECT finding_id, doc_id,
               max(t) FILTER (w = 'during') / nullif(max(t) FILTER (w = 'before'), 0) - 1 AS effect,
               max(c) FILTER (w = 'during') / nullif(max(c) FILTER (w = 'before'), 0) - 1 AS control_change,
               max(t) FILTER (w = 'before') / nullif(max(t) FILTER (w = 'earlier'), 0) - 1 AS pre_trend
        FROM v_means GROUP BY finding_id, doc_id""",
    "v_placebos": """
        SELECT finding_id, doc_id, count(gap) AS placebo_count, max(abs(gap)) AS placebo_max
        FROM (SELECT q.finding_id, q.doc_id,
                     (q.t / nullif(p.t, 0) - 1) - (q.c / nullif(p.c, 0) - 1) AS gap
              FROM v_means q JOIN v_means p ON p.finding_id = q.finding_id AND p.doc_id = q.doc_id
                AND q.w LIKE 'quiet%' AND p.w = 'prior' || substr(q.w, 6))
        GROUP BY finding_id, doc_id""",
    "v_each_region": """
        SELECT finding_id, doc_id, region,
               (max(total) FILTER (w = 'during') / max(days) FILTER (w = 'during'))
               / nullif(max(total) FILTER (w = 'before') / 14, 0) - 1 AS move
        FROM v_region_windows WHERE treated AND w IN ('during', 'before')
        GROUP BY finding_id, doc_id, region""",
    "v_effects": """
        SELECT k.*, w.effect, w.control_change, w.effect - w.control_change AS did, w.pre_trend,
               coalesce(r.usable, 0) AS usable_regions, coalesce(r.responding, 0) AS responding,
               coalesce(p.placebo_count, 0) AS placebo_count, p.placebo_max,
               m.movement
        FROM v_kept_candidates k
        LEFT JOIN v_wide w ON w.finding_id = k.finding_id AND w.doc_id = k.doc_id
        LEFT JOIN v_placebos p ON p.finding_id = k.finding_id AND p.doc_id = k.doc_id
        LEFT JOIN v_direction m ON m.finding_id = k.finding_id
        LEFT JOIN (SELECT e.finding_id, e.doc_id, count(move) AS usable,
                          count(*) FILTER (move * CASE WHEN x.effect < 0 THEN -1 ELSE 1 END >= 0.04)
                            AS responding
                   FROM v_each_region e JOIN v_wide x ON x.finding_id = e.finding_id
                     AND x.doc_id = e.doc_id GROUP BY e.finding_id, e.doc_id) r
          ON r.finding_id = k.finding_id AND r.doc_id = k.doc_id""",
    "v_tests": """
        SELECT *,
          CASE WHEN effect IS NULL OR pre_trend IS NULL THEN 'unavailable'
               WHEN pre_trend < 0 AND abs(pre_trend) > abs(effect) * 0.6 THEN 'fail' ELSE 'pass' END
            AS isolation,
          CASE WHEN effect IS NULL OR did IS NULL THEN 'unavailable'
               WHEN abs(did) >= 0.04 THEN 'pass' ELSE 'fail' END AS difference,
          CASE WHEN effect IS NOT NULL AND did * movement < 0 THEN 'fail' ELSE 'unavailable' END
            AS direction_test,
          CASE WHEN effect IS NULL OR usable_regions < 2 THEN 'unavailable'
               WHEN responding >= usable_regions * 0.5 AND responding >= 2 THEN 'pass' ELSE 'fail' END
            AS consistency,
          CASE WHEN effect IS NULL OR did IS NULL OR placebo_count < 3 THEN 'unavailable'
               WHEN abs(did) >= placebo_max * 1.25 THEN 'pass' ELSE 'fail' END AS placebo
        FROM v_effects""",
    "v_failures": """
        SELECT *, list_filter([CASE WHEN isolation = 'fail' THEN 'isolation' END,
                   CASE WHEN difference = 'fail' THEN 'difference' END,
                   CASE WHEN direction_test = 'fail' THEN 'direction_test' END,
                   CASE WHEN consistency = 'fail' THEN 'consistency' END,
                   CASE WHEN placebo = 'fail' THEN 'placebo' END], lambda x: x IS NOT NULL) AS failed,
               list_filter([CASE WHEN difference <> 'pass' THEN 'difference' END,
                   CASE WHEN isolation <> 'pass' THEN 'isolation' END,
                   CASE WHEN placebo <> 'pass' THEN 'placebo' END], lambda x: x IS NOT NULL) AS missing
        FROM v_tests""",
    "v_verdicts": """
        SELECT *, CASE WHEN effect IS NULL THEN 'cannot_verify' WHEN len(failed) > 0 THEN 'rejected'
                       WHEN len(missing) > 0 THEN 'cannot_verify' ELSE 'verified' END AS state,
               CASE WHEN effect IS NULL THEN 'no data for the exposed slices'
                    WHEN len(failed) > 0 THEN 'failed ' || array_to_string(failed, ', ')
                    WHEN len(missing) > 0 THEN 'could not run ' || array_to_string(missing, ', ')
                    ELSE 'passed every test that could be run' END AS reason
        FROM v_failures""",
}

ANSWERS = {
    "reconcile_days": """SELECT finding_id, strftime(d, '%Y-%m-%d') AS d, round(primary_value, 4) AS "primary",
        round(secondary, 4) AS secondary, round(residual, 4) AS residual
        FROM v_gaps WHERE source = 'finance_ledger'""",
    "reconcile_state": """SELECT finding_id, source,
        CASE WHEN n IS NULL THEN 'not_reconciled' WHEN worst > 0.05 * 3.0 THEN 'contradicted'
             WHEN breaches > 0 THEN 'drift' ELSE 'agreed' END AS state,
        coalesce(n, 0) AS days_compared, round(coalesce(worst, 0.0), 6) AS worst,
        coalesce(breaches, 0) AS breaches
        FROM (SELECT finding_id, s.source FROM v_cases,
              (VALUES ('finance_ledger'), ('order_headers')) s(source))
        LEFT JOIN (SELECT finding_id, source, count(*) AS n, max(abs(residual)) AS worst,
                          count(*) FILTER (abs(residual) > 0.05) AS breaches
                   FROM v_gaps GROUP BY ALL) USING (finding_id, source)""",
    "pvm_bridge": """SELECT finding_id, round(base_revenue, 2) AS base_revenue,
        round(current_revenue, 2) AS current_revenue, round(volume, 2) AS volume, round(mix, 2) AS mix,
        round(price, 2) AS price, products,
        CASE WHEN q0 <= 0 THEN 'no_baseline'
             WHEN abs(current_revenue - base_revenue - volume - mix - price) > 0.10
             THEN 'does_not_reconcile' ELSE 'ok' END AS status FROM v_pvm""",
    "contribution": """SELECT finding_id, dimension, slice, round(base, 5) AS base,
        round(current, 5) AS current, round(delta, 5) AS delta,
        round(coalesce(delta / nullif(total, 0), 0.0), 6) AS share,
        round(current / nullif(base, 0) - 1, 6) AS pct_change FROM v_slices""",
    "concentration": """SELECT finding_id, dimension,
        round(coalesce(sum(delta) / nullif(any_value(total), 0), 0.0), 6) AS top_share
        FROM (SELECT *, row_number() OVER (PARTITION BY finding_id, dimension
                ORDER BY CASE WHEN total < 0 THEN -delta ELSE delta END DESC, slice) AS rn FROM v_slices)
        WHERE rn <= 2 GROUP BY finding_id, dimension""",
    "rank_exact": """SELECT finding_id, rn AS rank, 'exact' AS track, dimension, slice,
        round(delta, 5) AS value, round(coalesce(delta / nullif(total, 0), 0.0), 5) AS share,
        'verified' AS state
        FROM (SELECT *, row_number() OVER (PARTITION BY finding_id
                ORDER BY CASE WHEN total < 0 THEN -delta ELSE delta END DESC, dimension, slice) AS rn
              FROM v_slices) WHERE rn <= 8""",
    "driver_corr": """SELECT region, count(*) AS n, round(corr(realised_price, net), 6) AS r_realised_price,
        round(corr(marketing_spend, net), 6) AS r_marketing_spend,
        round(corr(planned_stock, net), 6) AS r_planned_stock,
        round(corr(competitor_price_index, net), 6) AS r_competitor_price_index
        FROM v_driver_days WHERE realised_price IS NOT NULL AND marketing_spend IS NOT NULL
          AND planned_stock IS NOT NULL AND competitor_price_index IS NOT NULL GROUP BY region""",
    "note_candidates": """SELECT finding_id, doc_id, candidate_id, kind,
        strftime(start_day, '%Y-%m-%d') AS start, strftime(end_day, '%Y-%m-%d') AS "end",
        array_to_string(exposed, ',') AS exposed, channel, device, category, sku
        FROM v_note_candidates""",
    "scope_terms": "SELECT doc_id, " + ", ".join(
        f"{longest('text', t)} AS {dim}" for dim, t in SALES_SCOPE.items()) + " FROM v_notes",
    "sku_mentions": "SELECT doc_id, sku FROM v_sku_mentions",
    "identifiers": f"SELECT doc_id, {IDENT} AS identifier FROM v_notes",
    "remediations": """WITH undone AS (
          SELECT DISTINCT doc_id, CAST(ts AS DATE) AS d, v.version FROM (
            SELECT doc_id, ts, unnest(regexp_extract_all(text, '([0-9]+(?:\\.[0-9]+)*)', 1)) AS num
            FROM v_undoing WHERE undoes AND doc_type IN ('release_log', 'ops_note')) u,
            LATERAL (SELECT unnest([num, num[:-2]]) AS version) v)
        SELECT p.doc_id, candidate_id, strftime(start_day, '%Y-%m-%d') AS start,
               strftime(min(d), '%Y-%m-%d') AS undone_on, arg_min(u.doc_id, (d, u.doc_id)) AS undone_by,
               count(*) AS notes
        FROM v_parsed p JOIN undone u ON d >= start_day
          AND u.version = nullif(regexp_extract(candidate_id, '([0-9]+(?:\\.[0-9]+)+|[0-9]{2,})', 1), '')
        GROUP BY p.doc_id, candidate_id, start_day""",
    "plan_candidates": """SELECT finding_id, candidate_id, kind, strftime(start_day, '%Y-%m-%d') AS start,
        strftime(end_day, '%Y-%m-%d') AS "end", array_to_string(exposed, ',') AS exposed, category
        FROM v_plan_candidates""",
    "relevance": """SELECT finding_id, doc_id, why IS NULL AS relevant, why AS set_aside FROM (
        SELECT finding_id, doc_id, coalesce(set_aside,
          CASE WHEN category <> 'PROMO' THEN 'was confined to category ' || category END) AS why
        FROM v_gated)""",
    "fishbone": f"SELECT doc_id, doc_type, {bone('doc_type', 'text')} AS bone FROM v_notes",
    "scope_panel": """SELECT layout, region, count(*) AS cells, round(sum(revenue), 4) AS revenue FROM (
        SELECT layout, region, d, CASE WHEN layout & 1 > 0 THEN channel END AS a,
               CASE WHEN layout & 2 > 0 THEN device END AS b,
               CASE WHEN layout & 4 > 0 THEN category END AS c,
               CASE WHEN layout & 8 > 0 THEN sku END AS s, sum(revenue) AS revenue
        FROM v_facts, generate_series(0, 15) g(layout) GROUP BY ALL) GROUP BY layout, region""",
    "causal_effects": """SELECT finding_id, doc_id, round(effect, 6) AS effect,
        round(control_change, 6) AS control_change, round(did, 6) AS did, round(pre_trend, 6) AS pre_trend,
        usable_regions, responding FROM v_effects""",
    "placebo": """SELECT finding_id, doc_id, placebo_count, round(placebo_max, 6) AS placebo_max
        FROM v_effects""",
    "causal_tests": """SELECT finding_id, doc_id, isolation, difference, direction_test, consistency, placebo
        FROM v_tests""",
    "verdicts": "SELECT finding_id, doc_id, candidate_id, state, reason FROM v_verdicts",
}
