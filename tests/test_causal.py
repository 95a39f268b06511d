"""Planted causes, decoys and causes that cannot be tested."""

import datetime as dt

import numpy as np
import pytest

from driftwise.operators import candidates as cands
from driftwise.operators import causal

START, END = dt.date(2022, 9, 1), dt.date(2022, 9, 10)
REGIONS = ("N", "S", "E", "W")
PANEL = "d date, region string, channel string, device string, category string, sku string, revenue double"
CAND = ("finding_id string, doc_id string, candidate_id string, kind string, start date, end date,"
        " exposed array<string>, channel string, device string, category string, sku string,"
        " finding_region string, finding_start date, finding_end date, movement double")


def panel(spark, hits):
    """Steady revenue, times ``hits[(region, channel)]`` inside the window."""
    rng = np.random.default_rng(7)
    rows = []
    for back in range(220):
        day = END - dt.timedelta(days=back)
        for region in REGIONS:
            for channel in ("web", "store"):
                level = 100 * float(np.exp(rng.normal(0, 0.004)))
                if day >= START:
                    level *= hits.get((region, channel), 1.0)
                rows.append((day, region, channel, "d", "c", "s", level))
    return spark.createDataFrame(rows, PANEL)


def cand(name, exposed, channel=None, start=START, sku=None, movement=-1.0):
    return ("f", name, name, "release_log", start, END, list(exposed), channel, None, None, sku,
            "N", START, END, movement)


def judged(spark, rows, hits):
    out = causal.verify(spark.createDataFrame(rows, CAND), panel(spark, hits)).collect()
    return {r.candidate_id: r for r in out}


@pytest.fixture(scope="module")
def regional(spark):
    hits = {("N", "web"): 0.7, ("N", "store"): 0.7}
    rows = [cand("true", ["N"]), cand("decoy", ["S"]), cand("everywhere", REGIONS), cand("nowhere", []),
            cand("unknown_sku", ["N"], sku="zz"), cand("wrong_way", ["S", "E", "W"])]
    return judged(spark, rows, hits)


def test_planted_cause_is_verified(regional):
    row = regional["true"]
    assert row.state == "verified" and row.effect == pytest.approx(-0.3, abs=0.02)
    assert row.did == pytest.approx(-0.3, abs=0.02) and row.placebo_count == 6
    assert row.consistency == "unavailable"


def test_decoy_is_rejected(regional):
    assert regional["decoy"].state == "rejected"


def test_a_cause_that_moved_the_other_way_is_rejected(regional):
    row = regional["wrong_way"]
    assert row.direction_test == "fail" and row.state == "rejected"


@pytest.mark.parametrize("name", ["everywhere", "nowhere", "unknown_sku"])
def test_untestable_is_not_verified(regional, name):
    assert regional[name].state in ("cannot_verify", "rejected")
    assert regional[name].state != "verified"


def test_no_comparison_group_leaves_the_test_unavailable(regional):
    assert regional["everywhere"].difference == "unavailable"
    assert regional["nowhere"].state == "cannot_verify"


def test_scope_is_tested_at_its_own_slice(spark):
    out = judged(spark, [cand("web", ["N"], "web"), cand("store", ["N"], "store")], {("N", "web"): 0.6})
    assert out["web"].state == "verified" and out["web"].effect == pytest.approx(-0.4, abs=0.02)
    assert out["store"].state == "rejected"


def test_too_little_history_cannot_verify(spark):
    rows = spark.createDataFrame([cand("new", ["N"])], CAND)
    short = panel(spark, {("N", "web"): 0.7, ("N", "store"): 0.7}).filter("d >= '2022-08-05'")
    row = causal.verify(rows, short).first()
    assert row.placebo == "unavailable" and row.state == "cannot_verify"


def test_present_in_two_moved_in_one_is_not_consistent(spark):
    row = judged(spark, [cand("two", ["N", "S"])], {("N", "web"): 0.6, ("N", "store"): 0.6})["two"]
    assert row.usable_regions == 2 and row.responding == 1 and row.consistency == "fail"


def test_candidates_alike_are_one_test(spark):
    """Many notes of one slice, days and exposure cost one test; each still gets its own row."""
    hits = {("N", "web"): 0.6, ("N", "store"): 0.6}
    many = [cand(f"n{i}", ["N"], "web") for i in range(60)] + [cand(f"m{i}", ["N"]) for i in range(60)]
    frame = spark.createDataFrame(many, CAND)
    named = causal.alike(frame, causal.KEY, (*causal.SCOPE, "start", "end", "exposed"))
    assert causal.distinct_tests(named).count() == 2
    out = causal.verify(frame, panel(spark, hits)).collect()
    alone = {name: judged(spark, [cand(name, ["N"], channel)], hits)[name] for name, channel in (("n0", "web"), ("m0", None))}
    assert len(out) == 120
    for r in out:
        want = alone[r.doc_id[0] + "0"]
        assert r.effect == want.effect and r.placebo_max == want.placebo_max and r.state == want.state == "verified"


def test_rows_that_share_a_key_are_tested_together(spark):
    """As before: the sums of a key's rows are one, and a null key has none."""
    hits = {("N", "web"): 0.6, ("N", "store"): 1.0}
    twice = [cand("two", ["N"], "web"), cand("two", ["N"], "store"), cand(None, ["N"], "web")]
    both = judged(spark, [cand("both", ["N"])], hits)["both"]
    out = causal.verify(spark.createDataFrame(twice, CAND), panel(spark, hits)).collect()
    assert [r.effect for r in out if r.doc_id] == [both.effect] * 2
    lost = next(r for r in out if r.doc_id is None)
    assert lost.effect is None and (lost.usable_regions, lost.responding, lost.placebo_count) == (0, 0, 0)


# --- candidates -----------------------------------------------------------------------
NOTES = "doc_id string, doc_type string, ts timestamp_ntz, region string, text string"
SCOPE = {"channel": {"app": "app", "mobile app": "app", "web": "web"}, "device": {"android": "mobile"},
         "category": {"snack": "snacks"}}


@pytest.fixture(scope="module")
def notes(spark):
    at = dt.datetime(2022, 9, 1, 9)
    return spark.createDataFrame([
        ("1", "release_log", at, "N", "release 4.2: card entry moved on android app"),
        ("2", "ops_note", at, "All", "Snacks short, PC 0001 delayed"),
        ("3", "release_log", at + dt.timedelta(days=2), "N", "Rolled back release 4.2 for checkout"),
        ("4", "support_ticket", at, "N", "app broken"),
        ("5", "release_log", at + dt.timedelta(days=1), "N", "hotfix 4.21 shipped")], NOTES)


def test_notes_are_read(spark, notes):
    skus = spark.createDataFrame([("PC-0001",), ("PC-00012",)], "sku string")
    read = {r.doc_id: r for r in cands.read_notes(notes, skus, SCOPE).collect()}
    assert set(read) == {"1", "2"}
    assert (read["1"].candidate_id, read["1"].channel, read["1"].device) == ("4.2", "app", "mobile")
    assert read["2"].exposed == [] and read["2"].sku == "PC-0001" and read["2"].category == "snacks"


def test_undoing_note_is_found_by_version(spark, notes):
    skus = spark.createDataFrame([], "sku string")
    parsed = cands.read_notes(notes, skus, SCOPE)
    undone = {r.doc_id: r for r in cands.remediations(parsed, notes).collect()}
    assert undone["1"].undone_by in ("3", "5")
    assert undone["1"].undone_on >= dt.date(2022, 9, 2)


def test_gates_name_the_first_failure(spark):
    rows = [cand("late", ["N"], start=dt.date(2022, 9, 20)), cand("elsewhere", ["S"]), cand("here", ["N"], "web")]
    out = {r.doc_id: r for r in cands.relevance(spark.createDataFrame(rows, CAND), {"channel": "store"}).collect()}
    assert out["late"].set_aside == "began after the movement ended"
    assert out["elsewhere"].set_aside == "was confined to S"
    assert out["here"].set_aside == "was confined to channel web"
