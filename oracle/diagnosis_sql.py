"""SQL answers for confidence, warning, decision, feedback and audit jobs."""

from driftwise import config
from driftwise.config import RETAIL
from driftwise.operators.actions import KIND_TO_DRIVER, NOTE_TO_DRIVER
from driftwise.operators.governance import BARE_NUMBERS, CAUSAL_VERBS
from driftwise.operators.signals import CAUSE_TO_SIGNAL, INTERNAL_MARKERS
from driftwise.plans.diagnosis_jobs import CONSUMED
from oracle.views import listing, pick

KPI = RETAIL["net_revenue"]
KNOWN = listing(d.driver_id for d in KPI.drivers)


def values(table: dict) -> str:
    return ", ".join(f"('{k}', {v!r})" for k, v in table.items())


LEVERS = {d.driver_id: d.lever for d in KPI.drivers if d.lever}
OWNERS = {d.driver_id: d.owner for d in KPI.drivers if d.lever}
KINDS = ", ".join(f"('{k}')" for k, _ in CAUSE_TO_SIGNAL)


def any_of(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def whole(text: str, words) -> str:
    return f"regexp_matches({text}, '(^|[^a-z0-9])({'|'.join(words)})(s|es)?([^a-z0-9]|$)')"


KIND_OF = "CASE " + " ".join(
    f"WHEN {any_of('lower(description)', w)} THEN '{k}'" for k, w in CAUSE_TO_SIGNAL) + " END"
DRIVER_OF = "CASE " + " ".join(f"WHEN kind = '{k}' THEN '{d}'" for k, d in KIND_TO_DRIVER.items()) + " " \
    + " ".join(f"WHEN kind = 'ops_note' AND {whole('lower(description)', w)} THEN '{d}'"
               for d, w in NOTE_TO_DRIVER) + " END"


LEVELS = ("realised_price", "marketing_spend", "planned_stock", "competitor_price_index")


def solved_sql(source: str, size: int) -> str:
    """The equations m x = b solved by clearing one column after the other."""
    cells = [(i, j) for i in range(size) for j in range(size)]
    for k in range(size):
        lines = [f"CASE WHEN {i} = {k} THEN m{i}{j} ELSE m{i}{j} - m{i}{k} * m{k}{j} / m{k}{k} END AS m{i}{j}" for i, j in cells]
        lines += [f"CASE WHEN {i} = {k} THEN b{i} ELSE b{i} - m{i}{k} * b{k} / m{k}{k} END AS b{i}" for i in range(size)]
        keep = ", ".join(f"k{i}" for i in range(size))
        source = f"(SELECT region, n, {keep}, {', '.join(lines)} FROM {source})"
    return source


def ridge_sql() -> str:
    size = range(len(LEVELS))
    corr = lambda a, b: f"corr({a}, {b})"
    kept = ", ".join(
        f"stddev_samp({d}) > 0 AND NOT coalesce(list_contains(any_value(out), '{d}'), false) AS k{i}" for i, d in enumerate(LEVELS))
    raw = ", ".join([f"{corr(a, b)} AS r{i}{j}" for i, a in enumerate(LEVELS) for j, b in enumerate(LEVELS)]
                    + [f"{corr(d, 'net')} AS y{i}" for i, d in enumerate(LEVELS)])
    cells = ", ".join(
        [f"CASE WHEN k{i} AND k{j} THEN {'n - 1 + 1.0::DOUBLE' if i == j else f'(n - 1) * r{i}{j}'} ELSE {'1.0::DOUBLE' if i == j else '0.0::DOUBLE'} END AS m{i}{j}"
         for i in size for j in size]
        + [f"CASE WHEN k{i} THEN y{i} * sqrt(n * (n - 1.0::DOUBLE)) ELSE 0.0::DOUBLE END AS b{i}" for i in size])
    start = f"""(SELECT *, {cells} FROM (
        SELECT d.region, count(*) AS n, {kept}, {raw} FROM v_driver_days d LEFT JOIN v_barred USING (region)
        WHERE {' AND '.join(f'{d} IS NOT NULL' for d in LEVELS)} GROUP BY d.region HAVING count(*) >= 14 AND stddev_pop(net) > 0))"""
    rows = " UNION ALL ".join(
        f"SELECT region, n, '{d}' AS driver, b{i} / m{i}{i} AS coefficient FROM v_solved WHERE k{i}" for i, d in enumerate(LEVELS))
    return f"""WITH v_solved AS (SELECT * FROM {solved_sql(start, len(LEVELS))})
        SELECT region AS key, rank, 'associational' AS track, driver, round(coefficient, 6) AS coefficient,
               n AS observations, 'hypothesis' AS state
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY region ORDER BY abs(coefficient) DESC, driver) AS INTEGER) AS rank
              FROM ({rows}) WHERE abs(coefficient) >= 0.02) WHERE rank <= 6"""


def grouped(value: str) -> str:
    return f"format('{{:,.0f}}', round(abs({value})))"


def display(value: str, unit: str) -> str:
    body = {
        "INR": f"CASE WHEN {value} < 0 THEN '-' ELSE '' END || 'Rs ' || {grouped(value)}",
        "pct": f"printf('%.1f', round({value} * 100, 1)) || '%'",
        "count": f"CASE WHEN {value} < 0 THEN '-' ELSE '' END || {grouped(value)}",
        "hours": f"{grouped(value)} || ' hours'",
        "ratio": f"printf('%.2f', round({value}, 2))",
        "none": "'not available'",
    }[unit]
    return f"CASE WHEN {value} IS NULL THEN 'not available' ELSE {body} END"


def fact(source: str, id_: str, claim: str, value: str, unit: str, kind: str, state: str = "NULL") -> str:
    return (f"SELECT finding_id, {id_} AS fact_id, {claim} AS claim, CAST({value} AS DOUBLE) AS value,"
            f" '{unit}' AS unit, {display(f'CAST({value} AS DOUBLE)', unit)} AS display,"
            f" '{kind}' AS kind, CAST({state} AS VARCHAR) AS state FROM {source}")


PLAIN = "trim(regexp_replace(description, '^\\S{1,32}: ', ''))"
FACTS = " UNION ALL ".join((
    fact("v_diagnoses", "'f-movement'", "'net_revenue moved over the window'", "total_change", "INR", "movement"),
    fact("v_diagnoses WHERE base_revenue <> 0", "'f-movement-pct'",
         "'the movement as a proportion of the baseline'", "total_change / base_revenue", "pct", "movement"),
    fact("v_diagnoses", "'f-explained'", "'sum attributed to verified causes'",
         "explained", "INR", "coverage"),
    fact("v_diagnoses WHERE overlap > 1", "'f-overlap'", "'how far the verified causes overlap'",
         "overlap", "pct", "coverage"),
    fact("v_diagnoses", "'f-confidence'", "'confidence, band ' || band", "score", "ratio", "confidence", "band"),
    fact("v_numbered", "'f-cause-' || i", f"'verified cause: ' || {PLAIN}", "contribution", "INR", "cause",
         "'verified'"),
    fact("v_numbered", "'f-cause-' || i || '-effect'", f"'measured effect of ' || {PLAIN}", "effect", "pct",
         "cause_effect", "'verified'"),
    fact("v_ruled", "'f-ruled-out-' || i", "'ruled out: ' || candidate_id || ', ' || reason",
         "CAST(NULL AS DOUBLE)", "none", "ruled_out", "'rejected'"),
    fact("v_cards", "'f-decision-' || rank", "'decision: ' || action", "recovery", "INR", "decision"),
    fact("v_gap", "'f-gap'", "'signal gap verdict ' || verdict", "best_lead", "hours", "signal_gap", "verdict"),
    fact("v_gap WHERE recurrence > 0", "'f-gap-recurrence'",
         "'earlier findings after such a warning here'", "recurrence", "count", "signal_gap"),
))

NORMAL = ("ltrim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace("
          "lower(trim({0})), ',', ''), ' ', ''), chr(8722), '-'), chr(8377), ''), '^(-?)rs', '\\1'),"
          " 'percentagepoints?', 'pp'), 'hours?', 'h'), '+')")


def normal(text: str) -> str:
    return NORMAL.format(text)


SENTENCES = ("The fall was caused by {c}, worth {n}.", "{c} moved first and led to the change.",
             "A verified note names {c} in the payment_gateway layer.",
             "Nothing else in the record fits {c}.")

VIEWS = {
    "v_verified": "SELECT * FROM v_verdicts WHERE state = 'verified'",
    "v_barred": f"""
        SELECT region, list(driver) AS out FROM (
          SELECT c.region, {DRIVER_OF} AS driver FROM v_verdicts v JOIN (SELECT finding_id, region FROM v_cases) c USING (finding_id)
          GROUP BY ALL HAVING count(*) FILTER (state = 'rejected') > 0 AND count(*) FILTER (state = 'verified') = 0)
        WHERE driver IS NOT NULL GROUP BY region""",
    # The fit at a score: the largest, over beginnings at or before it, of the least mean up to an end at or after it.
    "v_train_steps": """
        SELECT x, sum(n) OVER (ORDER BY x) AS n, sum(h) OVER (ORDER BY x) AS h, n AS own_n, h AS own_h
        FROM (SELECT confidence AS x, count(*)::DOUBLE AS n, (count(*) FILTER (correct))::DOUBLE AS h
              FROM v_judged WHERE split = 'train' GROUP BY confidence)""",
    "v_isotonic": """
        SELECT x, any_value(own_n) AS n, any_value(own_h) AS h, max(least_mean) AS value FROM (
          SELECT k.x, i.x AS i, any_value(k.own_n) AS own_n, any_value(k.own_h) AS own_h,
                 min((j.h - i.h + i.own_h) / (j.n - i.n + i.own_n)) AS least_mean
          FROM v_train_steps k JOIN v_train_steps i ON i.x <= k.x JOIN v_train_steps j ON j.x >= k.x GROUP BY k.x, i.x)
        GROUP BY x""",
    "v_usable": """
        SELECT (SELECT count(*) >= 40 AND count(DISTINCT correct) = 2 FROM v_judged WHERE split = 'train')
           AND (SELECT sum(h - 2 * value * h + n * value * value) / sum(n) FROM v_isotonic)
               <= (SELECT avg(pow(confidence - CASE WHEN correct THEN 1 ELSE 0 END, 2)) FROM v_judged WHERE split = 'train') AS usable""",
    "v_probabilities": """
        SELECT case_id, confidence, correct, CASE WHEN usable THEN CASE
                 WHEN below.x IS NULL THEN above.value WHEN above.x IS NULL OR above.x = below.x THEN below.value
                 ELSE below.value + (above.value - below.value) * (confidence - below.x) / (above.x - below.x) END END AS probability
        FROM (SELECT * FROM v_judged WHERE split = 'test') t CROSS JOIN v_usable
        ASOF LEFT JOIN v_isotonic below ON t.confidence >= below.x
        ASOF LEFT JOIN v_isotonic above ON t.confidence <= above.x""",
    "v_sized": """
        SELECT v.*, coalesce(b.slice_base, 0) * effect AS contribution
        FROM v_verified v LEFT JOIN (
          SELECT c.finding_id, c.doc_id, sum(f.revenue) / 14 AS slice_base
          FROM v_verified c JOIN v_facts f ON f.d BETWEEN c.case_start - 14 AND c.case_start - 1
            AND (len(c.exposed) = 0 OR list_contains(c.exposed, f.region))
            AND (c.channel IS NULL OR c.channel = f.channel) AND (c.device IS NULL OR c.device = f.device)
            AND (c.category IS NULL OR c.category = f.category) AND (c.sku IS NULL OR c.sku = f.sku)
          GROUP BY c.finding_id, c.doc_id) b ON b.finding_id = v.finding_id AND b.doc_id = v.doc_id""",
    "v_explained": """
        SELECT finding_id, base_revenue, current_revenue, total_change, causes, overlap,
               CASE WHEN overlap > 1 THEN total_change ELSE gross END AS explained
        FROM (SELECT m.finding_id, base_revenue, current_revenue,
                     current_revenue - base_revenue AS total_change,
                     coalesce(causes, 0) AS causes, coalesce(gross, 0) AS gross,
                     CASE WHEN current_revenue - base_revenue <> 0 AND coalesce(gross, 0) <> 0
                          THEN greatest(abs(gross) / abs(current_revenue - base_revenue), 1.0)
                          ELSE 1.0 END AS overlap
              FROM v_moved m LEFT JOIN (SELECT finding_id, count(*) AS causes, sum(contribution) AS gross
                                        FROM v_sized GROUP BY finding_id) USING (finding_id))""",
    "v_contested": """
        SELECT finding_id, string_agg(r, ',' ORDER BY r) AS contested
        FROM (SELECT finding_id, r FROM (SELECT finding_id, effect, unnest(exposed) AS r FROM v_sized)
              GROUP BY finding_id, r HAVING min(effect) < 0 AND max(effect) > 0) GROUP BY finding_id""",
    "v_components": """
        SELECT *, raw_share / overlap AS coverage,
               0.35 * raw_share / overlap + 0.30 * causal_strength + 0.20 * corroboration + 0.15 AS score
        FROM (SELECT x.*, CASE WHEN total_change = 0 THEN 0 ELSE least(abs(explained / total_change), 1) END
                          AS raw_share,
                     least(coalesce(s.times, 0) / 3.0, 1.0) AS causal_strength,
                     least(coalesce(p.supporting, 0) / 3.0, 1.0) AS corroboration, 1.0::DOUBLE AS freshness, contested
              FROM v_explained x
              LEFT JOIN (SELECT finding_id, max(abs(effect) / nullif(abs(placebo_max), 0)) AS times
                         FROM v_sized WHERE effect <> 0 GROUP BY finding_id) s USING (finding_id)
              LEFT JOIN (SELECT finding_id, sum(supporting) AS supporting FROM v_support GROUP BY finding_id) p
                USING (finding_id)
              LEFT JOIN v_contested USING (finding_id))""",
    "v_ledger_state": """
        SELECT finding_id, CASE WHEN n IS NULL THEN 'not_reconciled' WHEN worst > 0.05 * 3.0 THEN 'contradicted'
               WHEN breaches > 0 THEN 'drift' ELSE 'agreed' END AS ledger
        FROM v_cases LEFT JOIN (SELECT finding_id, count(*) AS n, max(abs(residual)) AS worst,
               count(*) FILTER (abs(residual) > 0.05) AS breaches FROM v_gaps
               WHERE source = 'finance_ledger' GROUP BY finding_id) USING (finding_id)""",
    "v_diagnoses": """
        SELECT *, CASE WHEN ledger = 'contradicted' THEN 'contradicted' WHEN band = 'unknown' THEN 'unknown'
                  ELSE 'explained' END AS verdict
        FROM (SELECT *, CASE WHEN reasons <> '' THEN 'unknown' WHEN score >= 0.70 THEN 'high'
                        ELSE 'moderate' END AS band
              FROM (SELECT *, concat_ws('; ',
                       CASE WHEN causes = 0 THEN 'no candidate survived testing' END,
                       CASE WHEN raw_share < 0.45 THEN 'verified causes cover too little of the movement' END,
                       'verified causes disagree in ' || contested,
                       CASE WHEN score < 0.45 THEN 'the combined score is below the reporting threshold' END)
                       AS reasons
                    FROM v_components JOIN v_cases USING (finding_id)
                    JOIN v_ledger_state USING (finding_id)))""",
    "v_top_slice": """
        SELECT finding_id, dimension, slice FROM (SELECT *, row_number() OVER (PARTITION BY finding_id
          ORDER BY CASE WHEN total < 0 THEN -delta ELSE delta END DESC, dimension, slice) AS rn FROM v_slices)
        WHERE rn = 1""",
    "v_abstain": """
        SELECT finding_id, coalesce(n, 0) AS ruled_out,
               CASE WHEN untestable IS NOT NULL THEN 'establish a comparison group for ' || untestable
                      || ', or extend history until one exists'
                    WHEN coverage < 0.45 THEN 'break the movement down further, starting with '
                      || dimension || ' ' || slice
                    ELSE 'widen the search window and re-run' END AS next_check,
               CASE WHEN untestable IS NOT NULL THEN 'was ' || untestable
                      || ' limited to a particular region, channel or category?'
                    WHEN coverage < 0.45
                    THEN 'is there an event in this window that was not written down anywhere?' END AS question
        FROM v_diagnoses LEFT JOIN (
          SELECT finding_id, count(*) AS n,
                 arg_min(candidate_id, (start_day, doc_id)) FILTER (state = 'cannot_verify') AS untestable
          FROM v_verdicts WHERE state IN ('rejected', 'cannot_verify') GROUP BY finding_id) USING (finding_id)
        LEFT JOIN v_top_slice USING (finding_id) WHERE band = 'unknown'""",
    "v_steps": """
        SELECT finding_id, 'cause' AS kind, candidate_id AS step, round(contribution * scale, 2) AS value,
               round(contribution, 2) AS measured
        FROM (SELECT s.finding_id, candidate_id, contribution,
                     CASE WHEN gross <> 0 AND gross / nullif(total_change, 0) > 1 THEN total_change / gross
                          ELSE 1.0 END AS scale
              FROM (SELECT *, sum(contribution) OVER (PARTITION BY finding_id) AS gross FROM v_sized
                    WHERE contribution <> 0) s JOIN v_explained USING (finding_id))""",
    "v_judged": "SELECT *, top1 AS correct FROM v_outcomes WHERE top1 IS NOT NULL",
    "v_feed": f"""
        SELECT c.finding_id, region, case_start, case_end,
               CASE WHEN internal IS NULL THEN 'no_cause' WHEN internal THEN 'internal'
                    ELSE coalesce(kind, 'severe_weather') END AS feed
        FROM v_cases c LEFT JOIN (
          SELECT finding_id, bool_and({any_of('lower(description)', INTERNAL_MARKERS)}) AS internal,
                 arg_min({KIND_OF}, (start_day, doc_id)) FILTER ({KIND_OF} IS NOT NULL) AS kind
          FROM v_verified GROUP BY finding_id) USING (finding_id)""",
    "v_covering_all": """
        SELECT finding_id, s.* FROM v_cases c JOIN v_signals s ON s.region = c.region
          AND s.valid_from < c.case_end + INTERVAL 1 DAY AND s.valid_to >= c.case_start""",
    "v_sig_days": """
        SELECT signal_type, region, CAST(valid_from AS DATE) AS d, count(*) AS warnings,
               max(CASE severity WHEN 'red' THEN 2 ELSE 1 END) AS rank
        FROM v_signals WHERE is_public AND severity IN ('amber', 'red') GROUP BY ALL""",
    "v_asked_feeds": f"""
        SELECT finding_id, region, case_start, feed FROM v_cases, (VALUES {KINDS}) k(feed)
        UNION ALL SELECT finding_id || '!', region, case_start, feed FROM v_feed""",
    "v_precedents": """
        SELECT finding_id, region, feed, episode, min(d) AS from_day, max(d) AS to_day,
               sum(warnings) AS warnings, max(rank) AS rank
        FROM (SELECT *, sum(fresh) OVER (PARTITION BY finding_id, feed ORDER BY d) AS episode
              FROM (SELECT a.finding_id, a.region, a.feed, s.d, s.warnings, s.rank,
                           CASE WHEN s.d - lag(s.d) OVER (PARTITION BY a.finding_id, a.feed ORDER BY s.d) > 5
                                THEN 1 ELSE 0 END AS fresh
                    FROM v_asked_feeds a JOIN v_sig_days s ON s.region = a.region AND s.signal_type = a.feed
                      AND s.d >= a.case_start - 730 AND s.d < a.case_start))
        GROUP BY finding_id, region, feed, episode""",
    "v_hurt": """
        SELECT p.finding_id, p.feed, p.episode,
               CASE WHEN during IS NOT NULL AND n >= 7 AND base <> 0 THEN during / base - 1.0 <= -0.06 END AS hurt
        FROM v_precedents p LEFT JOIN (
          SELECT region, from_day, to_day, avg(net) FILTER (d >= from_day) AS during,
                 avg(net) FILTER (d < from_day) AS base, count(*) FILTER (d < from_day) AS n
          FROM (SELECT DISTINCT region, from_day, to_day FROM v_precedents)
          JOIN v_net_day USING (region) WHERE d BETWEEN from_day - 28 AND to_day
          GROUP BY ALL) USING (region, from_day, to_day)""",
    "v_gap": f"""
        SELECT *, CASE WHEN feed = 'no_cause' THEN 'coverage_unknown' WHEN feed = 'internal' THEN 'no_gap'
               WHEN signals = 0 THEN 'no_gap' WHEN actionable = 0 THEN 'not_foreseeable'
               WHEN list_contains({listing(CONSUMED)}, feed) THEN 'no_gap' ELSE 'gap_found' END AS verdict
        FROM (SELECT f.finding_id, f.feed, coalesce(signals, 0) AS signals, coalesce(actionable, 0) AS actionable,
                     best_lead, coalesce(recurrence, 0) AS recurrence, coalesce(hurt, 0) AS recurrence_hurt
              FROM v_feed f LEFT JOIN (
                SELECT c.finding_id, count(*) AS signals,
                       count(*) FILTER (is_public AND severity IN ('amber', 'red') AND lead_time_hours >= 24)
                         AS actionable,
                       max(lead_time_hours) FILTER (is_public AND severity IN ('amber', 'red')
                         AND lead_time_hours >= 24) AS best_lead
                FROM v_covering_all c JOIN v_feed x ON x.finding_id = c.finding_id AND x.feed = c.signal_type
                GROUP BY c.finding_id) USING (finding_id)
              LEFT JOIN (SELECT replace(finding_id, '!', '') AS finding_id, count(*) AS recurrence,
                                count(*) FILTER (hurt) AS hurt
                         FROM v_hurt WHERE finding_id LIKE '%!' GROUP BY 1) USING (finding_id))""",
    "v_cards": f"""
        SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY loss DESC, doc_id) AS rank,
               loss * share AS recovery,
               CASE WHEN lever IS NOT NULL THEN 'apply ' || replace(lever, '_', ' ') || ' for '
                    || coalesce(channel, device, category, sku, nullif(array_to_string(exposed, ', '), ''),
                                'the affected slice') ELSE 'monitor only' END AS action,
               CASE WHEN driver IS NULL THEN 'no contract driver matches this cause'
                    WHEN lever IS NULL THEN 'observable but not controllable'
                    WHEN share IS NULL THEN 'no recovery share is declared for this lever' END AS caveat
        FROM (SELECT d.*, lever, owner, share, lever IS NOT NULL AS controllable, abs(contribution) AS loss
              FROM (SELECT *, CASE WHEN list_contains({KNOWN}, {DRIVER_OF}) THEN {DRIVER_OF} END AS driver
                    FROM v_sized) d
              LEFT JOIN (VALUES {values(LEVERS)}) l(driver, lever) USING (driver)
              LEFT JOIN (VALUES {values(OWNERS)}) o(driver, owner) USING (driver)
              LEFT JOIN (VALUES {values(config.RECOVERY_SHARE)}) r(lever, share) USING (lever))""",
    "v_fair": """
        SELECT c.*, d.total_change, g.verdict = 'gap_found' AND c.driver IS NOT DISTINCT FROM g.feed AS warned,
               round(contribution * CASE WHEN gross <> 0 THEN least(1.0, abs(d.total_change) / gross)
                                    ELSE 1.0 END, 2) AS amount
        FROM (SELECT *, sum(abs(contribution)) OVER (PARTITION BY finding_id) AS gross FROM v_cards) c
        JOIN v_diagnoses d USING (finding_id) LEFT JOIN v_gap g USING (finding_id)""",
    "v_asks": f"""
        SELECT target, subject, count(*) AS entries, count(DISTINCT submitted_by) AS supporting,
               max(abs(movement_inr)) AS largest_movement
        FROM (SELECT *, coalesce(candidate_id, kpi_id) AS subject FROM v_feedback)
        JOIN (VALUES {values(config.LEARNABLE)}) t(judgement, target) USING (judgement)
        GROUP BY target, subject""",
    "v_proposals": """
        SELECT *, contradicting / (entries + contradicting) > 0.25 AS contested,
               supporting >= 2 AND NOT contradicting / (entries + contradicting) > 0.25 AS applicable
        FROM (SELECT a.*, coalesce(n, 0) AS contradicting FROM v_asks a LEFT JOIN (
          SELECT coalesce(candidate_id, kpi_id) AS subject, count(*) AS n FROM v_feedback
          WHERE judgement = 'confirmed' GROUP BY 1) USING (subject))""",
    "v_numbered": """
        SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY start_day, doc_id) AS i FROM v_sized""",
    "v_ruled": """
        SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY start_day, doc_id) AS i FROM v_verdicts
        WHERE state = 'rejected'""",
    "v_facts_told": FACTS,
    "v_narrative": f"""
        SELECT finding_id, finding_id || '#' || doc_id AS sentence_id, i,
               replace(replace({pick(SENTENCES, 'i')}, '{{c}}', candidate_id), '{{n}}',
                       {display('contribution', 'INR')}) AS text,
               CASE WHEN i % 4 = 3 THEN CAST([] AS VARCHAR[]) ELSE ['f-cause-' || i] END AS cites
        FROM v_numbered""",
    "v_seen": """
        SELECT * FROM v_cards WHERE len(exposed) = 0 OR list_has_any(exposed, ['ASIA', 'EUROPE'])""",
    "v_persona": """
        SELECT d.finding_id, round(total_change, 5) AS total_change, round(explained, 5) AS explained,
               round(overlap, 5) AS overlap, round(score, 5) AS score, band, verdict,
               coalesce(n, 0) AS causes, top_action, top_owner, coalesce(can, 0) AS controllable_actions,
               coalesce(watch, 0) AS watch_only, round(recoverable, 5) AS recoverable,
               coalesce(ruled_out, 0) AS ruled_out
        FROM v_diagnoses d LEFT JOIN (
          SELECT finding_id, count(*) AS n, arg_min(action, rank) AS top_action,
                 first(owner ORDER BY rank) AS top_owner, count(*) FILTER (controllable) AS can,
                 count(*) FILTER (NOT controllable) AS watch,
                 sum(coalesce(recovery, 0.0)) FILTER (controllable) AS recoverable
          FROM v_seen GROUP BY finding_id) USING (finding_id)
        LEFT JOIN (SELECT finding_id, count(*) AS ruled_out FROM v_verdicts WHERE state <> 'verified'
                   GROUP BY finding_id) USING (finding_id)
        WHERE d.finding_id IN (SELECT finding_id FROM v_cases WHERE region IN ('ASIA', 'EUROPE'))""",
    "v_evidence": """
        SELECT 'bridge-' || leg || '|' || finding_id AS evidence_id, 'decomposition' AS kind, 'INR' AS unit,
               'pvm_bridge' AS method, NULL AS state, v AS value, CAST([] AS VARCHAR[]) AS supports
        FROM (UNPIVOT (SELECT finding_id, volume, mix, price FROM v_pvm WHERE q0 > 0
                AND abs(current_revenue - base_revenue - volume - mix - price) <= 0.10)
              ON volume, mix, price INTO NAME leg VALUE v)
        UNION ALL SELECT 'cause|' || finding_id || '|' || doc_id, 'causal_test', 'pct_point', 'did', 'verified',
               did * 100, ['bridge-volume|' || finding_id] FROM v_sized
        UNION ALL SELECT 'gap|' || finding_id, 'signal_gap', 'hours', 'signal_gap', NULL, best_lead,
               CAST([] AS VARCHAR[]) FROM v_gap
        UNION ALL SELECT 'note|' || finding_id, 'contribution', 'hours', 'ridge', NULL, NULL,
               ['missing|' || finding_id] FROM v_gap WHERE verdict = 'gap_found'""",
    "v_chain": """
        SELECT a.seq, CASE WHEN a.prev IS DISTINCT FROM
                 CASE WHEN a.seq = 1 THEN repeat('0', 64) ELSE b.hash END
               THEN 'prev is not the hash of row seq - 1'
               WHEN a.hash <> sha256(a.body) THEN 'hash differs from the digest of the row' END AS problem
        FROM v_audit a LEFT JOIN v_audit b ON b.seq = a.seq - 1""",
}

FAILED = f"""CASE WHEN len(cites) = 0 OR unknown > 0 THEN 'unbound'
    WHEN len(list_filter(numerals, lambda n: NOT (list_contains({listing(BARE_NUMBERS)}, {normal('n')})
         OR list_contains(allowed, {normal('n')}) OR contains(quoted, lower(trim(n)))))) > 0
    THEN 'invented_numeral'
    WHEN len(list_filter(names, lambda n: NOT (n = 'net_revenue' OR contains(quoted, n)))) > 0
    THEN 'unknown_entity'
    WHEN cites_rejected AND regexp_matches(lower(text), '{"|".join(CAUSAL_VERBS)}')
    THEN 'rejected_as_cause' ELSE 'accepted' END"""

ANSWERS = {
    "explained": """SELECT finding_id, causes, round(total_change, 5) AS total_change,
        round(explained, 5) AS explained, round(overlap, 5) AS overlap FROM v_explained""",
    "sized_causes": """SELECT finding_id, doc_id, candidate_id, round(contribution, 4) AS contribution
        FROM v_sized""",
    "confidence": """SELECT finding_id, round(coverage, 6) AS coverage,
        round(causal_strength, 6) AS causal_strength, round(corroboration, 6) AS corroboration,
        freshness, round(score, 6) AS score FROM v_diagnoses""",
    "bands": """SELECT finding_id, band, verdict, ledger, reasons,
        CASE WHEN overlap > 1 THEN 'the verified causes overlap' END AS caveat FROM v_diagnoses""",
    "stale_bands": f"""WITH stale AS (
          SELECT count(*) FILTER (coalesce(date_sub('second', as_of, observed_at) / 3600.0, h + 1) > h) AS n,
                 count(*) AS m
          FROM (VALUES {', '.join(f"('{s}', {h})" for s, h in KPI.sla_hours.items())}) s(source_id, h)
          LEFT JOIN v_freshness USING (source_id))
        SELECT 'unknown' AS band, CASE WHEN ledger = 'contradicted' THEN 'contradicted' ELSE 'unknown' END
               AS verdict, count(*) AS findings, round(avg(score - 0.15 * n / m), 6) AS score
        FROM v_diagnoses, stale GROUP BY 2""",
    "abstention": "SELECT * FROM v_abstain",
    "waterfall": """WITH rest AS (
          SELECT finding_id, 'rest' AS kind, 'not explained' AS step,
                 round(total_change - coalesce(told, 0), 2) AS value, CAST(NULL AS DOUBLE) AS measured
          FROM v_explained LEFT JOIN (SELECT finding_id, sum(value) AS told FROM v_steps GROUP BY finding_id)
            USING (finding_id)),
        steps AS (SELECT * FROM v_steps UNION ALL SELECT * FROM rest WHERE abs(value) >= 1.0)
        SELECT finding_id, kind, step, value, measured FROM steps WHERE finding_id IN (
          SELECT finding_id FROM steps JOIN v_explained x USING (finding_id)
          GROUP BY finding_id, x.base_revenue, x.current_revenue
          HAVING abs(round(x.base_revenue + sum(value), 2) - round(x.current_revenue, 2)) <= 0.05)""",
    "brier": """SELECT count(*) AS n, round(avg(pow(confidence - CASE WHEN correct THEN 1 ELSE 0 END, 2)), 8)
        AS brier FROM v_judged""",
    "ece": """SELECT round(sum(n * abs(m - a)) / sum(n), 4) AS ece, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT count(*) AS n, avg(confidence) AS m, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS a
        FROM v_judged WHERE split = 'test' GROUP BY least(floor(confidence * 5), 4))""",
    "calibration_bins": """SELECT CAST(least(floor(confidence * 5), 4) AS INTEGER) AS bin, count(*) AS n,
        round(avg(confidence), 6) AS mean_score,
        round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM v_judged GROUP BY 1""",
    "calibrated": "SELECT case_id, confidence, round(probability, 6) AS probability FROM v_probabilities",
    "calibration_gain": """SELECT count(*) AS n, round(avg(pow(confidence - CASE WHEN correct THEN 1 ELSE 0 END, 2)), 6) AS before,
        round(avg(pow(probability - CASE WHEN correct THEN 1 ELSE 0 END, 2)), 6) AS after FROM v_probabilities""",
    "rank_drivers": ridge_sql(),
    "bench_metrics": """SELECT count(*) AS cases, count(top1) AS with_planted_cause,
        count(*) FILTER (verdict = 'explained') AS reported_a_cause,
        count(*) FILTER (verdict = 'unknown') AS abstained,
        round(count(*) FILTER (top1) / nullif(count(top1), 0), 3) AS top1_accuracy,
        round(count(*) FILTER (top1 AND verdict <> 'no_movement')
          / nullif(count(top1) FILTER (verdict <> 'no_movement'), 0), 3) AS top1_when_material,
        round(count(*) FILTER (topk) / nullif(count(top1), 0), 3) AS topk_accuracy,
        round(count(*) FILTER (expected = 'no_anomaly' AND verdict = 'explained')
          / nullif(count(*) FILTER (expected = 'no_anomaly'), 0), 3) AS false_alarm_rate,
        round(count(*) FILTER (decoy_rejected) / nullif(count(decoy_rejected), 0), 3)
          AS negative_control_rejection,
        round(count(*) FILTER (verdict = 'unknown' AND (expected IN ('unknown', 'cannot_verify')
          OR NOT coalesce(topk, FALSE))) / nullif(count(*) FILTER (verdict = 'unknown'), 0), 3)
          AS abstention_precision,
        round(count(*) FILTER (verdict = 'unknown' AND expected IN ('unknown', 'cannot_verify'))
          / nullif(count(*) FILTER (expected IN ('unknown', 'cannot_verify')), 0), 3) AS abstention_recall,
        count(*) FILTER (verdict <> 'unknown' AND expected IN ('unknown', 'cannot_verify'))
          AS missed_abstentions,
        round(count(*) FILTER (detected AND top1 IS NOT NULL) / nullif(count(top1), 0), 3) AS detection_rate,
        round(count(*) FILTER (material_detected AND top1 IS NOT NULL) / nullif(count(top1), 0), 3)
          AS material_detection_rate,
        round((list_sort(list(seconds)))[CAST(floor(count(*) * 0.5) AS INTEGER) + 1], 3) AS p50_seconds,
        round((list_sort(list(seconds)))[CAST(floor(count(*) * 0.95) AS INTEGER) + 1], 3) AS p95_seconds,
        round(sum(seconds), 1) AS total_seconds FROM v_outcomes""",
    "event_proximity": """SELECT kpi_id, region, strftime(day, '%Y-%m-%d') AS day,
        arg_min('peak ' || strftime(peak, '%Y-%m-%d'), (abs(day - peak), peak)) AS event,
        min(abs(day - peak)) AS days_away
        FROM (SELECT DISTINCT kpi_id, region, CAST(ts AS DATE) AS day FROM v_flagged WHERE material)
        JOIN v_peaks ON abs(day - peak) <= 10 GROUP BY kpi_id, region, day""",
    # Easter as the first Sunday after the paschal full moon, taken from its table of 19 dates for 1900 to 2199.
    "holiday_proximity": """WITH years AS (SELECT unnest(range(1990, 2036)) AS y),
        easter AS (SELECT y, m + ((7 - isodow(m)) % 7 + CASE WHEN isodow(m) = 7 THEN 7 ELSE 0 END)::INT AS sunday FROM (
          SELECT y, make_date(y, 3, 21) + [24, 13, 2, 21, 10, 29, 18, 7, 26, 15, 4, 23, 12, 1, 20, 9, 27, 17, 6][(y % 19 + 1)::INT]::INT AS m
          FROM years)),
        fixed AS (
          SELECT 'new year''s day' AS event, make_date(y, 1, 1) AS d FROM years
          UNION ALL SELECT 'christmas day', make_date(y, 12, 25) FROM years UNION ALL SELECT 'boxing day', make_date(y, 12, 26) FROM years),
        named AS (
          SELECT event, d FROM fixed
          UNION ALL SELECT 'good friday', sunday - 2 FROM easter UNION ALL SELECT 'easter monday', sunday + 1 FROM easter
          UNION ALL SELECT 'early may', min(d) FROM (SELECT y, make_date(y, 5, k::INT) AS d FROM years, range(1, 32) r(k)) WHERE isodow(d) = 1 GROUP BY y
          UNION ALL SELECT 'spring', max(d) FROM (SELECT y, make_date(y, 5, k::INT) AS d FROM years, range(1, 32) r(k)) WHERE isodow(d) = 1 GROUP BY y
          UNION ALL SELECT 'summer', max(d) FROM (SELECT y, make_date(y, 8, k::INT) AS d FROM years, range(1, 32) r(k)) WHERE isodow(d) = 1 GROUP BY y
          UNION ALL SELECT event || ' (observed)', CASE WHEN event <> 'new year''s day' THEN d + 2 WHEN isodow(d) = 6 THEN d + 2 ELSE d + 1 END
          FROM fixed WHERE isodow(d) >= 6)
        SELECT kpi_id, region, strftime(day, '%Y-%m-%d') AS day, arg_min(event, (abs(day - d), d, event)) AS event, min(abs(day - d)) AS days_away
        FROM (SELECT DISTINCT kpi_id, region, CAST(ts AS DATE) AS day FROM v_flagged WHERE material)
        JOIN named ON abs(day - d) <= 3 GROUP BY kpi_id, region, day""",
    "actionable": """SELECT signal_type, region, severity,
        is_public AND severity IN ('amber', 'red') AND lead_time_hours >= 24 AS actionable,
        count(*) AS warnings FROM v_signals GROUP BY ALL""",
    "signal_overlap": """SELECT finding_id, signal_id, signal_type, severity, lead_time_hours
        FROM v_covering_all""",
    "cause_feed": "SELECT finding_id, feed FROM v_feed",
    "precedents": """SELECT finding_id, feed, strftime(from_day, '%Y-%m-%d') AS from_day,
        strftime(to_day, '%Y-%m-%d') AS to_day, CAST(warnings AS BIGINT) AS warnings,
        CASE rank WHEN 2 THEN 'red' ELSE 'amber' END AS max_severity
        FROM v_precedents WHERE finding_id NOT LIKE '%!'""",
    "precedent_hurt": """SELECT finding_id, feed, count(*) AS episodes, count(hurt) AS judged,
        count(*) FILTER (hurt) AS hurt FROM v_hurt WHERE finding_id NOT LIKE '%!' GROUP BY finding_id, feed""",
    "gap_verdict": """SELECT finding_id, feed, signals, actionable, best_lead, recurrence, recurrence_hurt,
        verdict FROM v_gap""",
    "near_misses": """SELECT finding_id, signals, severe_lead,
        CASE timely WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' WHEN 2 THEN 'amber' WHEN 3 THEN 'red' END
          AS timely_severity,
        CASE WHEN severe_lead IS NOT NULL AND timely IS NOT NULL THEN 'none was both serious and early'
             WHEN severe_lead IS NOT NULL THEN 'serious but late' WHEN timely IS NOT NULL THEN 'early but minor'
             WHEN private = signals THEN 'none was public'
             ELSE 'none was public, serious and early' END AS why
        FROM (SELECT finding_id, count(*) AS signals, count(*) FILTER (NOT is_public) AS private,
                count(*) FILTER (is_public AND severity IN ('amber', 'red') AND lead_time_hours >= 24) AS good,
                max(lead_time_hours) FILTER (is_public AND severity IN ('amber', 'red')) AS severe_lead,
                max(list_position(['green', 'yellow', 'amber', 'red'], severity) - 1)
                  FILTER (is_public AND lead_time_hours >= 24) AS timely
              FROM v_covering_all GROUP BY finding_id) WHERE good = 0""",
    "cause_signals": """SELECT finding_id, doc_id, rank, signal_id, signal_type, lead_time_hours FROM (
        SELECT v.finding_id, v.doc_id, s.*, row_number() OVER (PARTITION BY v.finding_id, v.doc_id
                 ORDER BY lead_time_hours DESC, signal_id) AS rank
        FROM v_verified v JOIN v_signals s ON list_contains(v.exposed, s.region)
          AND s.valid_from < v.case_end + INTERVAL 1 DAY AND s.valid_to >= v.start_day) WHERE rank <= 4""",
    "monitoring": """SELECT finding_id, replace(feed, '_', ' ') || ' warnings covering the affected region' AS watch,
        'severity amber or above with at least 24 hours of lead time' AS threshold,
        'finance_director' AS route_to, coalesce(best_lead >= 24, FALSE) AS would_have_fired,
        recurrence AS prior_occurrences FROM v_gap WHERE verdict = 'gap_found'""",
    "decision_cards": """SELECT finding_id, doc_id, rank, driver, lever, owner, controllable, action,
        round(loss, 4) AS loss, round(recovery, 4) AS recovery, caveat FROM v_cards""",
    "price_grid": """SELECT finding_id, d AS delta,
        round(current_revenue * ((1 + d) * (1 - 1.4 * d) - 1), 4) AS revenue_change,
        round(current_revenue * (1 - 1.4 * d) * (1 + d - 0.68) - current_revenue * 0.32, 4) AS profit_change,
        1 + d < 0.68 AS below_cost
        FROM v_moved, (VALUES (-0.35::DOUBLE), (-0.10::DOUBLE), (-0.05::DOUBLE), (0.05::DOUBLE), (0.10::DOUBLE)) g(d)""",
    "projections": """SELECT finding_id, round(loss * 0.9, 4) AS reversal_per_day,
        round(-outside, 4) AS sustained_per_day, round(-outside * 14, 4) AS sustained_total
        FROM v_cases
        LEFT JOIN (SELECT finding_id, arg_min(abs(contribution), (start_day, doc_id)) AS loss FROM v_sized
                   WHERE kind = 'release_log' GROUP BY finding_id) USING (finding_id)
        LEFT JOIN (SELECT finding_id, sum(abs(contribution)) FILTER (kind IN ('ops_note', 'promotion'))
                     AS outside FROM v_sized GROUP BY finding_id) USING (finding_id)""",
    "fair_target": """SELECT finding_id, round(any_value(total_change), 2) AS net,
        count(*) FILTER (NOT controllable) AS factors,
        round(any_value(total_change) - coalesce(sum(amount) FILTER (NOT controllable AND NOT warned), 0), 2)
          AS policy,
        round(any_value(total_change) - coalesce(sum(amount) FILTER (NOT controllable), 0), 2) AS all_excused
        FROM v_fair GROUP BY finding_id""",
    "recovery_outlook": """SELECT finding_id,
        round(sum(CASE WHEN controllable THEN coalesce(recovery, 0) ELSE 0 END) / greatest(overlap, 1), 2)
          AS recoverable,
        round(sum(CASE WHEN controllable THEN 0 ELSE loss END) / greatest(overlap, 1), 2) AS not_actionable,
        overlap > 1 AS adjusted
        FROM v_cards JOIN v_explained USING (finding_id) GROUP BY finding_id, overlap""",
    "accountability": """SELECT finding_id, 'zonal_sales_manager' AS explains,
        'national_sales_manager' AS reviews, acts, 'finance_director' AS signs,
        CASE WHEN acts IS NOT NULL THEN NULL WHEN verdict = 'contradicted'
             THEN 'the two systems disagree, so the extract is checked first'
             ELSE 'no verified cause has a lever; the response is to monitor' END AS no_action
        FROM v_diagnoses LEFT JOIN (SELECT finding_id, string_agg(DISTINCT owner, ',' ORDER BY owner) AS acts
          FROM v_cards WHERE controllable GROUP BY finding_id) USING (finding_id)""",
    "proposals": """SELECT target, subject, entries, supporting, round(largest_movement, 4) AS largest_movement,
        contradicting, contested, applicable FROM v_proposals""",
    "feedback_summary": """SELECT count(*) AS total, count(DISTINCT run_id) AS runs,
        round(count(*) FILTER (judgement = 'confirmed') / count(*) FILTER (judgement <> 'comment'), 3)
          AS agreement_rate,
        count(*) FILTER (judgement = 'missed_cause' AND correction IS NOT NULL) AS eval_cases FROM v_feedback""",
    "eval_cases": """SELECT 'fb-' || feedback_id AS case_id, run_id, kpi_id, correction AS expected_cause
        FROM v_feedback WHERE judgement = 'missed_cause' AND correction IS NOT NULL""",
    "threshold_proposal": """SELECT kpi_id AS subject, people AS supporting,
        CASE WHEN people < 2 THEN 'no_quorum' WHEN biggest * 1.01 <= min_money THEN 'not_needed'
             ELSE 'proposed' END AS status,
        round(CASE WHEN people >= 2 AND biggest * 1.01 > min_money THEN least(biggest * 1.01, min_money * 2) END, 4)
          AS to_value
        FROM (SELECT kpi_id, count(DISTINCT submitted_by) AS people, max(abs(movement_inr)) AS biggest
              FROM v_feedback WHERE judgement = 'not_material' GROUP BY kpi_id) JOIN v_contracts USING (kpi_id)""",
    "overlay": f"""SELECT kpi_id, field, round(coalesce(to_value, value), 4) AS value,
        to_value IS NOT NULL AS changed
        FROM (SELECT kpi_id, 'min_abs_money' AS field, min_money AS value FROM v_contracts
              UNION ALL SELECT kpi_id, 'min_abs_z', min_z FROM v_contracts)
        LEFT JOIN (SELECT kpi_id, {pick(('min_abs_money', 'no_such_field'), 'seq')} AS field,
                     arg_max(movement_inr, seq) AS to_value
                   FROM v_feedback WHERE judgement = 'not_material' GROUP BY ALL) USING (kpi_id, field)""",
    "entitled_causes": """SELECT finding_id, doc_id, candidate_id, state FROM v_verdicts
        WHERE len(exposed) = 0 OR list_has_any(exposed, ['ASIA', 'EUROPE'])""",
    "withheld_counts": """SELECT finding_id, count(*) AS withheld, max(abs(contribution)) > 0 AS material
        FROM v_sized WHERE NOT (len(exposed) = 0 OR list_has_any(exposed, ['ASIA', 'EUROPE']))
        GROUP BY finding_id""",
    "persona_cfo": """SELECT finding_id, total_change, explained, band, causes, top_action, top_owner,
        recoverable FROM v_persona""",
    "persona_ops": "SELECT finding_id, band, controllable_actions, watch_only FROM v_persona",
    "persona_analyst": """SELECT finding_id, total_change, explained, overlap, score, band, verdict, causes,
        ruled_out, recoverable FROM v_persona""",
    "sentence_redaction": """SELECT finding_id, sentence_id, text FROM v_narrative n WHERE NOT EXISTS (
        SELECT 1 FROM v_sized s WHERE s.finding_id = n.finding_id
          AND NOT (len(exposed) = 0 OR list_contains(exposed, 'ASIA'))
          AND (contains(n.text, candidate_id) OR contains(n.text, rtrim(description, '.'))
               OR (contains(description, ':')
                   AND contains(n.text, rtrim(trim(substr(description, strpos(description, ':') + 1)), '.')))))""",
    "fact_table": """SELECT finding_id, kind, unit, state, count(*) AS facts, round(sum(value), 5) AS value,
        min(claim) AS first_claim FROM v_facts_told GROUP BY finding_id, kind, unit, state""",
    "fact_display": "SELECT finding_id, fact_id, unit, display FROM v_facts_told",
    "claim_checks": f"""SELECT finding_id, sentence_id, {FAILED} AS outcome FROM (
        SELECT n.*, coalesce(unknown, 0) AS unknown, coalesce(allowed, []) AS allowed,
               coalesce(quoted, '') AS quoted, coalesce(cites_rejected, FALSE) AS cites_rejected,
               list_filter(regexp_extract_all(regexp_replace(text, '\\bf-[a-z]+(-[a-z0-9]+)*\\b', ' ', 'g'),
                 '(?i)[+-]?(?:Rs )?\\s?\\d+(?:,\\d+)*(?:\\.\\d+)?\\s*(?:percentage points?|%|hours?)?'),
                 lambda x: x <> '') AS numerals,
               regexp_extract_all(text, '\\b[a-z]+(?:_[a-z]+)+\\b') AS names
        FROM v_narrative n LEFT JOIN (
          SELECT c.finding_id, c.sentence_id, count(*) FILTER (f.claim IS NULL) AS unknown,
                 list({normal('f.display')}) AS allowed,
                 lower(string_agg(f.claim || ' ' || f.display, ' ')) AS quoted,
                 bool_or(f.state = 'rejected') AS cites_rejected
          FROM (SELECT finding_id, sentence_id, unnest(cites) AS fact_id FROM v_narrative) c
          LEFT JOIN v_facts_told f ON f.finding_id = c.finding_id AND f.fact_id = c.fact_id
          GROUP BY c.finding_id, c.sentence_id) q USING (finding_id, sentence_id))""",
    "next_check_gates": """SELECT 'names something this run does not contain' AS rejected,
        count(*) AS proposals FROM v_abstain""",
    "evidence_rows": """SELECT kind, unit, method, state, count(*) AS rows,
        CAST(sum(len(supports)) AS BIGINT) AS supports, round(sum(value), 2) AS value
        FROM v_evidence GROUP BY kind, unit, method, state""",
    "evidence_refs": """SELECT DISTINCT evidence_id, 'unresolved reference' AS problem
        FROM (SELECT evidence_id, unnest(supports) AS ref FROM v_evidence)
        WHERE ref NOT IN (SELECT evidence_id FROM v_evidence)
        UNION ALL SELECT evidence_id, 'unit not allowed for method' FROM v_evidence
        WHERE method = 'ridge' AND unit <> 'ratio'""",
    "fingerprint": """SELECT finding_id, sha256(concat_ws('|', finding_id, verdict,
          printf('%.2f', floor(base_revenue * 100 + 0.5) / 100), printf('%.2f', floor(current_revenue * 100 + 0.5) / 100),
          printf('%.2f', floor(total_change * 100 + 0.5) / 100), coalesce(told, ''))) AS fingerprint
        FROM v_diagnoses LEFT JOIN (
          SELECT finding_id, array_to_string(list_sort(list(concat_ws(':', candidate_id, doc_id,
                   printf('%.2f', floor(contribution * 100 + 0.5) / 100)))), ',') AS told
          FROM v_sized GROUP BY finding_id) USING (finding_id)""",
    "hash_chain": """SELECT count(problem) = 0 AS intact, count(problem) AS breaks,
        min(seq) FILTER (problem IS NOT NULL) AS broken_at,
        arg_min(problem, seq) FILTER (problem IS NOT NULL) AS reason FROM v_chain""",
    "chain_breaks": "SELECT seq, problem FROM v_chain WHERE problem IS NOT NULL",
}

# The whole chain with each movement's direction measured against the expected line.
OVERRIDES = {
    "diagnosed_queue": {
        "v_direction": """
            SELECT finding_id, sign(nullif(sum(value - expected), 0)) AS movement
            FROM v_cases c JOIN v_scored s ON s.kpi_id = 'net_revenue' AND s.region = c.region
              AND CAST(s.ts AS DATE) BETWEEN case_start AND case_end GROUP BY finding_id""",
    },
}
ANSWERS["diagnosed_queue"] = """SELECT finding_id, round(total_change, 5) AS total_change, causes,
    coalesce(rejected, 0) AS rejected, coalesce(untested, 0) AS untested, round(explained, 5) AS explained,
    round(score, 5) AS score, band, verdict
    FROM v_diagnoses LEFT JOIN (
      SELECT finding_id, count(*) FILTER (state = 'rejected') AS rejected,
             count(*) FILTER (state = 'cannot_verify') AS untested FROM v_verdicts GROUP BY finding_id)
      USING (finding_id)"""
