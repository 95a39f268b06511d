"""Jobs from verified causes to confidence, warnings, decisions and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise import config
from driftwise.config import RETAIL
from driftwise.functions.columns import day_text, pick
from driftwise.functions.holidays import holidays
from driftwise.operators import actions, calibration, confidence, detection, governance, lineage, signals
from driftwise.operators import decomposition as parts
from driftwise.plans.cause_jobs import (
    cases,
    facts,
    gather,
    movements,
    net_by_day,
    posted,
    slices,
    test_all,
    tested,
)
from driftwise.plans.registry import job
from driftwise.plans.series_jobs import (
    ENTITLED,
    contracts,
    findings,
    flagged,
    peaks,
    rounded,
    scored,
)
from driftwise.plans.text_jobs import support_all, supported, verified
from driftwise.sources.estate import Estate

KPI = RETAIL["net_revenue"]
# What the planning process is on record as reading.
CONSUMED = ("historical_sales", "inventory_position", "capacity_metrics", "financial_plan",
            "carrier_disruption")


def sized(e: Estate) -> DataFrame:
    """Verified causes with the money each accounts for, kept as a stage."""
    return e.stage("sized", lambda: confidence.contributions_of(verified(e), facts(e)))


def stale_sources(e: Estate) -> tuple[float, str]:
    """Freshness of the metric's sources: a handful of configured feeds."""
    limits = [(KPI.kpi_id, s, h) for s, h in KPI.sla_hours.items()]
    sla = e.spark.createDataFrame(limits, "kpi_id string, source_id string, sla_hours int")
    breached = sorted(r["source_id"] for r in lineage.freshness(e.freshness(), sla)
                      .filter("not sla_met").collect())
    return 1.0 - len(breached) / len(limits), ", ".join(breached)


def diagnoses(e: Estate) -> DataFrame:
    """One row per finding with its score, band and verdict, kept as a stage."""
    return e.stage("diagnoses", lambda: diagnose(e))


def diagnose(e: Estate, freshness: float = 1.0, stale: str = "") -> DataFrame:
    return judge(e, cases(e), sized(e), supported(e), freshness, stale)


def judge(e: Estate, found: DataFrame, causes: DataFrame, support: DataFrame,
          freshness: float = 1.0, stale: str = "") -> DataFrame:
    """Contradicted beats unknown, and unknown beats explained."""
    backed = support.groupBy("finding_id").agg(F.sum("supporting").alias("supporting"))
    judged = confidence.scored(
        confidence.explained(movements(e, found), causes), confidence.strongest(causes), backed,
        F.lit(freshness), F.lit(stale), confidence.contradictions(causes))
    days = parts.reconcile_days(found, net_by_day(e), posted(e))
    state = parts.reconcile_state(found, days).select("finding_id", F.col("state").alias("ledger"))
    verdict = F.when(F.col("ledger") == "contradicted", "contradicted") \
        .when(F.col("band") == "unknown", "unknown").otherwise("explained")
    return judged.join(found, "finding_id").join(state, "finding_id").withColumn("verdict", verdict)


@job("diagnosed_queue")
def diagnosed_queue(e: Estate) -> DataFrame:
    """Detection to verdict: every revenue finding, diagnosed.

    The movement's direction is measured against the expected line, not against
    the fortnight before, which a seasonal ramp can point the wrong way.
    """
    places = cases(e)
    found = places.withColumn("kpi_id", F.lit(KPI.kpi_id))
    moved = detection.expected_direction(scored(e), found).select(
        "finding_id", F.signum("gap").alias("movement"))
    causes = e.stage("queue_causes", lambda: test_all(e, gather(e, places), moved))
    proven = confidence.contributions_of(causes.filter("state = 'verified'"), facts(e))
    out = judge(e, places, proven, support_all(e, causes.filter("state = 'verified'")))
    ruled = causes.groupBy("finding_id").agg(
        F.count_if(F.col("state") == "rejected").alias("rejected"),
        F.count_if(F.col("state") == "cannot_verify").alias("untested"))
    return rounded(out.join(ruled, "finding_id", "left").na.fill(0, ["rejected", "untested"]).select(
        "finding_id", "total_change", "causes", "rejected", "untested", "explained", "score", "band",
        "verdict"), 5, "total_change", "explained", "score")


@job("explained")
def explained(e: Estate) -> DataFrame:
    out = confidence.explained(movements(e), sized(e)).select(
        "finding_id", "causes", "total_change", "explained", "overlap")
    return rounded(out, 5, "total_change", "explained", "overlap")


@job("sized_causes")
def sized_causes(e: Estate) -> DataFrame:
    return rounded(sized(e).select("finding_id", "doc_id", "candidate_id", "contribution"), 4, "contribution")


@job("confidence")
def confidence_job(e: Estate) -> DataFrame:
    out = diagnoses(e).select("finding_id", "coverage", "causal_strength", "corroboration",
                              "freshness", "score")
    return rounded(out, 6, "coverage", "causal_strength", "corroboration", "freshness", "score")


@job("bands")
def bands(e: Estate) -> DataFrame:
    return diagnoses(e).select("finding_id", "band", "verdict", "ledger",
                               F.array_join("reasons", "; ").alias("reasons"), "caveat")


@job("stale_bands")
def stale_bands(e: Estate) -> DataFrame:
    """The same diagnoses under the feeds' real freshness, most of them stale."""
    fresh, stale = stale_sources(e)
    out = diagnose(e, fresh, stale).groupBy("band", "verdict").agg(
        F.count(F.lit(1)).alias("findings"), F.avg("score").alias("score"))
    return rounded(out, 6, "score")


@job("abstention")
def abstention(e: Estate) -> DataFrame:
    ranked = parts.rank_exact(slices(e), 1)
    return confidence.abstentions(diagnoses(e), tested(e), ranked)


@job("waterfall")
def waterfall(e: Estate) -> DataFrame:
    return parts.waterfall(movements(e), sized(e).select("finding_id", "candidate_id", "contribution"))


# --- evaluation -----------------------------------------------------------------------------
def judged_outcomes(e: Estate) -> DataFrame:
    return e.outcomes().filter("top1 is not null").withColumn("correct", F.col("top1"))


@job("brier")
def brier(e: Estate) -> DataFrame:
    return rounded(confidence.brier(judged_outcomes(e)), 8, "brier")


@job("ece")
def ece(e: Estate) -> DataFrame:
    return confidence.calibration_error(judged_outcomes(e).filter("split = 'test'"))


@job("calibration_bins")
def calibration_bins(e: Estate) -> DataFrame:
    return rounded(confidence.calibration_bins(judged_outcomes(e)), 6, "mean_score", "accuracy")


def split_of(e: Estate, name: str) -> DataFrame:
    return judged_outcomes(e).filter(F.col("split") == name).select("case_id", "confidence", "correct")


def probabilities(e: Estate) -> DataFrame:
    """Outcomes held out from the fit, with the probability the others' curve gives them."""
    return calibration.calibrated(split_of(e, "test"), split_of(e, "train"))


@job("calibrated")
def calibrated(e: Estate) -> DataFrame:
    return rounded(probabilities(e).select("case_id", "confidence", "probability"), 6, "probability")


@job("calibration_gain")
def calibration_gain(e: Estate) -> DataFrame:
    """Squared errors of score and probability on outcomes that the curve was not fitted on."""
    label = F.when(F.col("correct"), 1.0).otherwise(0.0)
    out = probabilities(e).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("confidence") - label, 2)).alias("before"),
        F.avg(F.pow(F.col("probability") - label, 2)).alias("after"))
    return rounded(out, 6, "before", "after")


@job("bench_metrics")
def bench_metrics(e: Estate) -> DataFrame:
    return confidence.bench_metrics(e.outcomes())


@job("event_proximity")
def event_proximity(e: Estate) -> DataFrame:
    days = flagged(e).filter("material").select("kpi_id", "region", F.to_date("ts").alias("day")).distinct()
    events = peaks(e).select(F.concat(F.lit("peak "), day_text("peak")).alias("event"),
                             F.col("peak").alias("on"))
    return confidence.near_events(days, events, 10).withColumn("day", day_text("day"))


@job("holiday_proximity")
def holiday_proximity(e: Estate) -> DataFrame:
    """Material days within three days of a public holiday, each with the nearest one."""
    days = flagged(e).filter("material").select("kpi_id", "region", F.to_date("ts").alias("day")).distinct()
    # A holiday may lie just over the end of a year.
    years = days.select(F.explode(F.array(*[F.year("day") + k for k in (-1, 0, 1)])).alias("year")).distinct()
    return confidence.near_events(days, holidays(years), 3).withColumn("day", day_text("day"))


# --- outside warnings ---------------------------------------------------------------------------
@job("actionable")
def actionable(e: Estate) -> DataFrame:
    return e.signals().withColumn("actionable", signals.is_actionable()).groupBy(
        "signal_type", "region", "severity", "actionable").agg(F.count(F.lit(1)).alias("warnings"))


@job("signal_overlap")
def signal_overlap(e: Estate) -> DataFrame:
    return signals.overlapping(cases(e), e.signals(), ("finding_id",)).select(
        "finding_id", "signal_id", "signal_type", "severity", "lead_time_hours")


def fed(e: Estate) -> DataFrame:
    return signals.feed_of(verified(e), cases(e))


@job("cause_feed")
def cause_feed(e: Estate) -> DataFrame:
    return fed(e).select("finding_id", "feed")


def every_feed(e: Estate) -> DataFrame:
    """Each finding asked about every kind of warning, for the precedent jobs."""
    kinds = F.explode(F.array(*[F.lit(k) for k, _ in signals.CAUSE_TO_SIGNAL]))
    return cases(e).select("finding_id", "region", "start", kinds.alias("feed"))


@job("precedents")
def precedents(e: Estate) -> DataFrame:
    out = signals.precedents(every_feed(e), signals.warning_days(e.signals()))
    return out.select("finding_id", "feed", day_text("from_day").alias("from_day"),
                      day_text("to_day").alias("to_day"), "warnings", "max_severity")


def history(e: Estate) -> DataFrame:
    return net_by_day(e).select("region", "d", F.col("primary").alias("value"))


@job("precedent_hurt")
def precedent_hurt(e: Estate) -> DataFrame:
    out = signals.hurt(signals.precedents(every_feed(e), signals.warning_days(e.signals())), history(e))
    return out.groupBy("finding_id", "feed").agg(
        F.count(F.lit(1)).alias("episodes"), F.count("hurt").alias("judged"),
        F.count_if(F.coalesce("hurt", F.lit(False))).alias("hurt"))


def covering(e: Estate) -> DataFrame:
    """Warnings of the kind each finding's causes call for."""
    wanted = fed(e).select("finding_id", F.col("feed").alias("signal_type"))
    return signals.overlapping(cases(e), e.signals(), ("finding_id",)).join(
        wanted, ["finding_id", "signal_type"], "left_semi")


def gaps(e: Estate) -> DataFrame:
    """The signal-gap verdict of every finding, kept as a stage."""
    return e.stage("gaps", lambda: assess_all(e))


def assess_all(e: Estate) -> DataFrame:
    judged = signals.hurt(signals.precedents(fed(e), signals.warning_days(e.signals())), history(e))
    return signals.assess(fed(e), covering(e), judged, CONSUMED)


@job("gap_verdict")
def gap_verdict(e: Estate) -> DataFrame:
    return gaps(e).select("finding_id", "feed", "signals", "actionable", "best_lead", "recurrence",
                          "recurrence_hurt", "verdict")


@job("near_misses")
def near_misses(e: Estate) -> DataFrame:
    return signals.near_misses(signals.overlapping(cases(e), e.signals(), ("finding_id",)))


@job("cause_signals")
def cause_signals(e: Estate) -> DataFrame:
    return signals.cause_signals(verified(e), e.signals()).select(
        "finding_id", "doc_id", "rank", "signal_id", "signal_type", "lead_time_hours")


@job("monitoring")
def monitoring(e: Estate) -> DataFrame:
    return signals.monitoring(gaps(e), KPI.owner)


# --- decisions -----------------------------------------------------------------------------------
def cards(e: Estate) -> DataFrame:
    return actions.decision_cards(sized(e), KPI)


@job("decision_cards")
def decision_cards(e: Estate) -> DataFrame:
    out = cards(e).select("finding_id", "doc_id", "rank", "driver", "lever", "owner", "controllable",
                          "action", "loss", "recovery", "caveat")
    return rounded(out, 4, "loss", "recovery")


@job("price_grid")
def price_grid(e: Estate) -> DataFrame:
    out = actions.price_grid(movements(e), (-0.35, -0.10, -0.05, 0.05, 0.10), -1.4, KPI.gross_margin)
    return rounded(out.select("finding_id", "delta", "revenue_change", "profit_change", "below_cost"),
                   4, "revenue_change", "profit_change")


@job("projections")
def projections(e: Estate) -> DataFrame:
    return rounded(actions.projections(cases(e), sized(e), KPI), 4,
                   "reversal_per_day", "sustained_per_day", "sustained_total")


@job("fair_target")
def fair_target(e: Estate) -> DataFrame:
    """Judged on every finding, so that both kinds of verdict show."""
    asked = diagnoses(e).withColumn("verdict", F.lit("explained"))
    return rounded(actions.fair_target(asked, cards(e), gaps(e)), 2, "net", "policy", "all_excused")


@job("recovery_outlook")
def recovery_outlook(e: Estate) -> DataFrame:
    return actions.outlook(cards(e), diagnoses(e))


@job("accountability")
def accountability(e: Estate) -> DataFrame:
    return actions.accountability(diagnoses(e), cards(e), KPI)


# --- feedback --------------------------------------------------------------------------------------
@job("proposals")
def proposals(e: Estate) -> DataFrame:
    out = governance.proposals(e.feedback())
    return rounded(out, 4, "largest_movement")


@job("feedback_summary")
def feedback_summary(e: Estate) -> DataFrame:
    return governance.feedback_summary(e.feedback())


@job("eval_cases")
def eval_cases(e: Estate) -> DataFrame:
    return governance.eval_cases(e.feedback())


@job("threshold_proposal")
def threshold_proposal(e: Estate) -> DataFrame:
    """Feedback about metrics as a whole, without a named cause."""
    whole = e.feedback().withColumn("candidate_id", F.lit(None).cast("string")).filter(
        "judgement <> 'confirmed'")
    out = governance.threshold_proposals(governance.proposals(whole), contracts(e))
    return rounded(out.select("subject", "supporting", "status", "to_value"), 4, "to_value")


@job("overlay")
def overlay(e: Estate) -> DataFrame:
    fields = F.explode(F.array(
        F.struct(F.lit("min_abs_money").alias("field"), F.col("min_abs_money").alias("value")),
        F.struct(F.lit("min_abs_z").alias("field"), F.col("min_abs_z").alias("value"))))
    long_ = contracts(e).select("kpi_id", fields.alias("f")).select("kpi_id", "f.*")
    changes = e.feedback().filter("judgement = 'not_material'").select(
        "kpi_id", pick(("min_abs_money", "no_such_field"), F.col("seq")).alias("field"),
        F.col("movement_inr").alias("to_value"), "seq")
    return rounded(governance.overlay(long_, changes), 4, "value")


# --- entitlement --------------------------------------------------------------------------------------
@job("entitled_causes")
def entitled_causes(e: Estate) -> DataFrame:
    """Tested causes, whatever came of them, that a reader of some regions may see."""
    return governance.visible_causes(tested(e), ENTITLED).select("finding_id", "doc_id", "candidate_id", "state")


@job("withheld_counts")
def withheld_counts(e: Estate) -> DataFrame:
    return governance.withheld(sized(e), ENTITLED)


def persona_rows(e: Estate, persona: str) -> DataFrame:
    ruled = tested(e).filter("state <> 'verified'").groupBy("finding_id").agg(
        F.count(F.lit(1)).alias("ruled_out"))
    frame = diagnoses(e).join(ruled, "finding_id", "left").na.fill(0, ["ruled_out"])
    out = governance.persona_view(frame, cards(e), ENTITLED, persona)
    numbers = [c for c in ("total_change", "explained", "overlap", "score", "recoverable")
               if c in out.columns]
    return rounded(out, 5, *numbers)


for _persona in governance.PERSONA_COLUMNS:
    job(f"persona_{_persona}")(lambda e, persona=_persona: persona_rows(e, persona))


def narrative(e: Estate) -> DataFrame:
    """Sentences about each verified cause, some of them not fit to publish."""
    said = sized(e).select(
        "finding_id", "doc_id", "candidate_id", "description", "contribution",
        F.row_number().over(_by_cause()).alias("i"))
    text = pick(("The fall was caused by {c}, worth {n}.", "{c} moved first and led to the change.",
                 "A verified note names {c} in the payment_gateway layer.",
                 "Nothing else in the record fits {c}."), F.col("i"))
    cites = F.when(F.col("i") % 4 == 3, F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("f-cause-"), F.col("i"))))
    return said.select(
        "finding_id", F.concat("finding_id", F.lit("#"), "doc_id").alias("sentence_id"),
        F.replace(F.replace(text, F.lit("{c}"), F.col("candidate_id")), F.lit("{n}"),
                  governance.display(F.col("contribution"), "INR")).alias("text"),
        cites.alias("cites"))


def _by_cause():
    from pyspark.sql import Window
    return Window.partitionBy("finding_id").orderBy("start", "doc_id")


@job("sentence_redaction")
def sentence_redaction(e: Estate) -> DataFrame:
    hidden = sized(e).filter(~governance.in_scope(("ASIA",)))
    return governance.redacted_sentences(narrative(e), hidden).select("finding_id", "sentence_id", "text")


# --- claims, evidence, audit -----------------------------------------------------------------------------
def facts_told(e: Estate) -> DataFrame:
    aside = tested(e).filter("state = 'rejected'")
    return governance.fact_table(diagnoses(e), sized(e), aside, cards(e), gaps(e), KPI.kpi_id)


@job("fact_table")
def fact_table(e: Estate) -> DataFrame:
    return facts_told(e).groupBy("finding_id", "kind", "unit", "state").agg(
        F.count(F.lit(1)).alias("facts"), F.round(F.sum("value"), 5).alias("value"),
        F.min("claim").alias("first_claim"))


@job("fact_display")
def fact_display(e: Estate) -> DataFrame:
    return facts_told(e).select("finding_id", "fact_id", "unit", "display")


@job("claim_checks")
def claim_checks(e: Estate) -> DataFrame:
    return governance.claim_checks(narrative(e), facts_told(e), (KPI.kpi_id,))


@job("next_check_gates")
def next_check_gates(e: Estate) -> DataFrame:
    """Every abstention's proposed check, held to the names its finding contains."""
    proposed = abstention(e).join(cases(e).select("finding_id", "region"), "finding_id")
    text = F.initcap(F.substring("next_check", 1, 1))
    allowed = F.array_distinct(F.concat(
        F.split(F.lower("region"), " "),
        F.transform(F.regexp_extract_all("next_check", F.lit(r"[A-Za-z0-9._-]+"), F.lit(0)),
                    lambda w: F.lower(w))))
    out = governance.next_check_gates(proposed.select(
        "finding_id", F.concat(text, F.expr("substring(next_check, 2)"), F.lit(" in "),
                               "region", F.lit(" or Zone_9")).alias("text"), allowed.alias("allowed")))
    return out.groupBy("rejected").agg(F.count(F.lit(1)).alias("proposals"))


def evidence_rows(e: Estate) -> DataFrame:
    """What each stage found, in one shape, with its trail."""
    from functools import reduce
    key = lambda prefix, *cols: F.concat_ws("|", F.lit(prefix), *cols)
    bridge = parts.price_volume_mix(parts.two_periods(cases(e), facts(e), ("sku",)))
    legs = [governance.evidence(
        bridge.filter("status = 'ok'"), key(f"bridge-{leg}", "finding_id"), "decomposition",
        F.lit(f"the {leg} effect"), F.col(leg), "INR", "pvm_bridge", "deterministic", "pos_txn")
        for leg in ("volume", "mix", "price")]
    cause = governance.evidence(
        sized(e), key("cause", "finding_id", "doc_id"), "causal_test", F.col("candidate_id"),
        F.col("did") * 100, "pct_point", "did", "causal", "pos_txn",
        F.array(key("bridge-volume", "finding_id")), F.lit("verified"))
    gap = governance.evidence(
        gaps(e), key("gap", "finding_id"), "signal_gap", F.col("verdict"), F.col("best_lead"),
        "hours", "signal_gap", "deterministic", "ext_signals")
    odd = governance.evidence(
        gaps(e).filter("verdict = 'gap_found'"), key("note", "finding_id"), "contribution",
        F.col("feed"), None, "hours", "ridge", "statistical", "ext_signals",
        F.array(key("missing", "finding_id")))
    return reduce(DataFrame.unionByName, (*legs, cause, gap, odd))


@job("evidence_rows")
def evidence_rows_job(e: Estate) -> DataFrame:
    return evidence_rows(e).groupBy("kind", "unit", "method", "state").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.size("supports")).alias("supports"),
        F.round(F.sum("value"), 2).alias("value"))


@job("evidence_refs")
def evidence_refs(e: Estate) -> DataFrame:
    return governance.evidence_problems(evidence_rows(e))


@job("fingerprint")
def fingerprint(e: Estate) -> DataFrame:
    return governance.fingerprints(diagnoses(e), sized(e))


@job("hash_chain")
def hash_chain(e: Estate) -> DataFrame:
    return governance.chain_report(e.audit_log(), F.sha2("body", 256))


@job("chain_breaks")
def chain_breaks(e: Estate) -> DataFrame:
    return governance.chain_breaks(e.audit_log(), F.sha2("body", 256))
