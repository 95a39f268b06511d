"""Confidence, warnings, feedback, entitlement, claims and the audit trail."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from driftwise.config import RETAIL
from driftwise.operators import actions, confidence, governance, signals
from driftwise.operators.lineage import PolicyError

KPI = RETAIL["net_revenue"]
CAUSE = ("finding_id string, doc_id string, candidate_id string, kind string, description string,"
         " start date, exposed array<string>, channel string, device string, category string,"
         " sku string, effect double, placebo_max double, contribution double")
D = dt.date(2022, 5, 1)


def cause(doc, contribution=-50.0, effect=-0.2, exposed=("N",), kind="release_log", text="release 4: card page"):
    return ("f", doc, doc, kind, text, D, list(exposed), None, None, None, None, effect, 0.05, contribution)


def judged(spark, causes, change=-100.0, supporting=3, stale=""):
    sized = spark.createDataFrame(causes, CAUSE)
    moved = spark.createDataFrame([("f", 500.0, 500.0 + change, change)],
                                  "finding_id string, base_revenue double, current_revenue double, total_change double")
    support = spark.createDataFrame([("f", supporting)], "finding_id string, supporting int")
    return confidence.scored(confidence.explained(moved, sized), confidence.strongest(sized), support,
                             F.lit(1.0), F.lit(stale), confidence.contradictions(sized)).first()


def test_a_covered_supported_movement_is_high(spark):
    row = judged(spark, [cause("a", -95.0)])
    assert row.band == "high" and row.score == pytest.approx(0.35 * 0.95 + 0.30 + 0.20 + 0.15)


def test_overlap_discounts_the_score_but_not_the_threshold(spark):
    row = judged(spark, [cause("a", -95.0), cause("b", -105.0)])
    assert row.overlap == pytest.approx(2.0) and row.explained == -100.0
    assert row.coverage == pytest.approx(0.5) and row.raw_share == 1.0
    assert "verified causes cover too little of the movement" not in row.reasons


@pytest.mark.parametrize("causes,kw,reason", [
    ([cause("a", -20.0)], {}, "verified causes cover too little of the movement"),
    ([cause("a", -95.0)], {"stale": "pos_txn"}, "pos_txn is stale beyond its SLA"),
    ([cause("a", -95.0), cause("b", 5.0, 0.1)], {}, "verified causes disagree in N")])
def test_reasons_to_abstain(spark, causes, kw, reason):
    row = judged(spark, causes, **kw)
    assert row.band == "unknown" and reason in row.reasons


def test_the_last_bin_is_closed(spark):
    rows = [("a", 1.0, True), ("b", 0.8, False), ("c", 0.0, False)]
    got = confidence.calibration_error(spark.createDataFrame(
        rows, "case_id string, confidence double, correct boolean")).first()
    assert got.ece == pytest.approx((2 * 0.4 + 0) / 3, abs=1e-4)


# --- warnings ----------------------------------------------------------------------
SIGNAL = ("signal_id string, signal_type string, city string, region string, severity string,"
          " valid_from timestamp_ntz, valid_to timestamp_ntz, lead_time_hours double, is_public boolean")


def warning(id_, day=0, severity="amber", lead=30.0, public=True, kind="severe_weather", hours=24):
    at = dt.datetime(2022, 5, 1, 6) + dt.timedelta(days=day)
    return (id_, kind, "c", "N", severity, at, at + dt.timedelta(hours=hours), lead, public)


def verdict(spark, rows, text="storm at the depot", causes=True, consumed=()):
    found = spark.createDataFrame([("f", "N", D, D + dt.timedelta(days=2))],
                                  "finding_id string, region string, start date, end date")
    told = spark.createDataFrame([("f", "d", D, text)] if causes else [],
                                 "finding_id string, doc_id string, start date, description string")
    feed = spark.createDataFrame(rows, SIGNAL)
    fed = signals.feed_of(told, found)
    wanted = fed.select("finding_id", F.col("feed").alias("signal_type"))
    covering = signals.overlapping(found, feed, ("finding_id",)).join(
        wanted, ["finding_id", "signal_type"], "left_semi")
    before = signals.hurt(signals.precedents(fed, signals.warning_days(feed)), spark.createDataFrame(
        [], "region string, d date, value double"))
    return signals.assess(fed, covering, before, consumed).first()


def test_validity_overlaps_and_pairs_once(spark):
    got = verdict(spark, [warning("long", -1, hours=72), warning("gone", -5)])
    assert got.signals == 1 and got.verdict == "gap_found"


@pytest.mark.parametrize("row,want", [
    (warning("late", lead=23.9), "not_foreseeable"), (warning("minor", severity="yellow"), "not_foreseeable"),
    (warning("secret", public=False), "not_foreseeable"), (warning("good", lead=24.0), "gap_found"),
    (warning("other", kind="competitor_action"), "no_gap")])
def test_the_ladder(spark, row, want):
    assert verdict(spark, [row]).verdict == want


def test_no_cause_internal_cause_and_consumed_feed(spark):
    rows = [warning("good")]
    assert verdict(spark, rows, causes=False).verdict == "coverage_unknown"
    assert verdict(spark, rows, text="release 4 rollout").verdict == "no_gap"
    assert verdict(spark, rows, consumed=("severe_weather",)).verdict == "no_gap"


def test_precedents_merge_at_five_days_and_are_judged(spark):
    rows = [warning(str(i), d, hours=1) for i, d in enumerate((-40, -35, -29))]
    feed = spark.createDataFrame(rows, SIGNAL)
    found = spark.createDataFrame([("f", "N", D, "severe_weather")],
                                  "finding_id string, region string, start date, feed string")
    history = spark.createDataFrame(
        [("N", D - dt.timedelta(days=b), 50.0 if 35 <= b <= 40 else 100.0) for b in range(1, 80)],
        "region string, d date, value double")
    out = signals.hurt(signals.precedents(found, signals.warning_days(feed)), history).orderBy("from_day").collect()
    assert [(r.warnings, r.hurt) for r in out] == [(2, True), (1, False)]


# --- decisions -----------------------------------------------------------------------
def test_cards(spark):
    sized = spark.createDataFrame([
        cause("a", -50.0), cause("b", -80.0, kind="promotion", text="promo"),
        cause("c", -10.0, kind="ops_note", text="no stock from the suppliers"),
        cause("d", -5.0, kind="ops_note", text="mystery")], CAUSE)
    cards = {r.doc_id: r for r in actions.decision_cards(sized, KPI).collect()}
    assert cards["a"].lever == "release_rollback" and cards["a"].recovery == pytest.approx(45.0)
    assert cards["b"].rank == 1 and not cards["b"].controllable and cards["b"].recovery is None
    assert cards["c"].lever == "replenishment" and cards["c"].owner == "supply_planner"
    assert cards["d"].driver is None and cards["d"].action == "monitor only"


def test_each_industry_reads_its_own_playbook(spark):
    from driftwise.config import PETROLEUM, POWER
    note = lambda text: spark.createDataFrame([cause("a", kind="ops_note", text=text)], CAUSE)
    fuel = actions.decision_cards(note("tanker fleet short"), PETROLEUM["net_realisation"],
                                  actions.PETROLEUM_PLAYBOOK).first()
    assert (fuel.driver, fuel.owner, fuel.recovery) == ("carrier_capacity", "logistics_lead", 35.0)
    grid = actions.decision_cards(note("line outage on the corridor"), POWER["dispatch_realisation"],
                                  actions.POWER_PLAYBOOK).first()
    assert (grid.lever, grid.recovery) == ("corridor_booking", 30.0)


def test_a_price_cut_can_raise_revenue_and_lower_profit(spark):
    moved = spark.createDataFrame([("f", 100.0, 100.0, 0.0)],
                                  "finding_id string, base_revenue double, current_revenue double, total_change double")
    row = actions.price_grid(moved, (-0.05,), -1.4, 0.32).first()
    assert row.revenue_change > 0 > row.profit_change
    assert actions.price_grid(moved, (-0.05,), None, None).first().revenue_change is None


# --- feedback and entitlement -----------------------------------------------------------
FEEDBACK = ("feedback_id string, run_id string, kpi_id string, judgement string, submitted_by string,"
            " candidate_id string, correction string, movement_inr double")


def test_support_counts_people_and_confirmations_contest(spark):
    rows = [("1", "r", "k", "wrong_cause", "u1", "c", None, None), ("2", "r", "k", "wrong_cause", "u1", "c", None, None),
            ("3", "r", "k", "wrong_cause", "u2", "d", None, None), ("4", "r", "k", "wrong_cause", "u3", "d", None, None),
            ("5", "r", "k", "confirmed", "u4", "d", None, None)]
    got = {r.subject: r for r in governance.proposals(spark.createDataFrame(rows, FEEDBACK)).collect()}
    assert got["c"].supporting == 1 and not got["c"].applicable
    assert got["d"].supporting == 2 and got["d"].contested and not got["d"].applicable


@pytest.mark.parametrize("largest,status,value", [(80.0, "not_needed", None), (150.0, "proposed", 151.5),
                                                  (900.0, "proposed", 200.0)])
def test_threshold_is_raised_just_clear_and_never_more_than_doubled(spark, largest, status, value):
    asked = spark.createDataFrame([("materiality_threshold", "k", False, True, largest)],
                                  "target string, subject string, contested boolean, applicable boolean, largest_movement double")
    contracts = spark.createDataFrame([("k", 100.0)], "kpi_id string, min_abs_money double")
    row = governance.threshold_proposals(asked, contracts).first()
    assert row.status == status and row.to_value == (None if value is None else pytest.approx(value))


def test_entitlement_never_widens_as_regions_shrink(spark):
    sized = spark.createDataFrame([cause("n", exposed=("N",)), cause("s", exposed=("S",)),
                                   cause("ns", exposed=("N", "S")), cause("all", exposed=())], CAUSE)
    seen = lambda regions: {r.doc_id for r in governance.visible_causes(sized, regions).collect()}
    assert seen(None) >= seen(["N", "S"]) >= seen(["N"]) >= seen([])
    assert seen(["N"]) == {"n", "ns", "all"} and seen([]) == {"all"}
    hidden = governance.withheld(sized, ["N"]).first()
    assert hidden.withheld == 1 and set(hidden.asDict()) == {"finding_id", "withheld", "material"}


def test_sentences_about_a_withheld_cause_go(spark):
    hidden = spark.createDataFrame([("f", "4.2", "release 4.2: card page moved.")],
                                   "finding_id string, candidate_id string, description string")
    told = spark.createDataFrame([("f", "1", "The card page moved and sales fell."), ("f", "2", "Stock was low."),
                                  ("g", "3", "The card page moved.")], "finding_id string, sentence_id string, text string")
    assert {r.sentence_id for r in governance.redacted_sentences(told, hidden).collect()} == {"2", "3"}


# --- claims and audit --------------------------------------------------------------------
def test_claims(spark):
    facts = spark.createDataFrame([
        ("f", "f-a", "sales moved in north_zone", "Rs 1,200", None), ("f", "f-b", "ruled out: promo", "x", "rejected")],
        "finding_id string, fact_id string, claim string, display string, state string")
    said = [("ok", "Sales fell by Rs 1,200 in north_zone over 3 days.", ["f-a"]), ("none", "Sales fell.", []),
            ("ghost", "Sales fell.", ["f-z"]), ("number", "Sales fell by Rs 1,300.", ["f-a"]),
            ("name", "Sales fell in south_zone.", ["f-a"]), ("blame", "The promo caused it.", ["f-b"])]
    got = {r.sentence_id: r.outcome for r in governance.claim_checks(spark.createDataFrame(
        [("f", i, t, c) for i, t, c in said], "finding_id string, sentence_id string, text string, cites array<string>"),
        facts).collect()}
    assert got == {"ok": "accepted", "none": "unbound", "ghost": "unbound", "number": "invented_numeral",
                   "name": "unknown_entity", "blame": "rejected_as_cause"}


def test_next_checks(spark):
    rows = [("ok", "Check stock in North."), ("long", " ".join(["word"] * 31)), ("cause", "It was caused by rain."),
            ("name", "Ask Vendor about it."), ("name2", "Check depot_9 first.")]
    got = {r.i: r.rejected for r in governance.next_check_gates(spark.createDataFrame(
        [(i, t, ["north", "stock"]) for i, t in rows], "i string, text string, allowed array<string>")).collect()}
    assert got["ok"] == "" and got["long"] == "too long" and got["cause"] == "asserts a cause"
    assert got["name2"].startswith("names something") and got["name"].startswith("names something")


def test_evidence_rules_and_cycles(spark):
    rows = spark.createDataFrame([
        ("a", "did", "INR", ["b"]), ("b", "ridge", "INR", ["a"]), ("c", "made_up", "INR", ["zz"]), ("d", "did", "INR", ["c"]),
        ("d", "did", "INR", [])], "evidence_id string, method string, unit string, supports array<string>")
    got = {(r.evidence_id, r.problem) for r in governance.evidence_problems(rows).collect()}
    assert got == {("b", "unit not allowed for method"), ("c", "unresolved reference"), ("d", "repeated id")}
    from driftwise.session import shared_folder
    shared_folder(spark)
    assert {r.evidence_id for r in governance.support_cycles(rows).collect()} == {"a", "b"}


def test_a_true_chain_holds_and_a_touched_row_breaks_it(spark):
    rows, prev = [], "0" * 64
    for seq in range(1, 40):
        digest = hashlib.sha256(f"{seq}|e{seq}|{prev}".encode()).hexdigest()
        rows.append((seq, f"e{seq}", prev, digest))
        prev = digest
    digest = F.sha2(F.concat_ws("|", "seq", "body", "prev"), 256)
    schema = "seq long, body string, prev string, hash string"
    assert governance.chain_report(spark.createDataFrame(rows, schema), digest).first().intact
    rows[20] = (21, "touched", *rows[20][2:])
    report = governance.chain_report(spark.createDataFrame(rows, schema), digest).first()
    assert (report.intact, report.broken_at) == (False, 21)
    del rows[5]
    assert governance.chain_report(spark.createDataFrame(rows, schema), digest).first().broken_at == 7


def test_fingerprint_ignores_row_order(spark):
    d = spark.createDataFrame([("f", "explained", 1.0, 2.0, 1.0)],
                              "finding_id string, verdict string, base_revenue double, current_revenue double, total_change double")
    sized = spark.createDataFrame([cause("a"), cause("b", -7.0)], CAUSE)
    one = governance.fingerprints(d, sized).first().fingerprint
    assert one == governance.fingerprints(d, sized.orderBy(F.desc("doc_id"))).first().fingerprint
    assert one != governance.fingerprints(d, sized.filter("doc_id = 'a'")).first().fingerprint


def test_persona_refuses_an_empty_list_of_regions(spark):
    findings = spark.createDataFrame([("f1", "ASIA"), ("f2", "AFRICA")], "finding_id string, region string")
    with pytest.raises(PolicyError):
        governance.persona_view(findings, findings, (), "ops")
