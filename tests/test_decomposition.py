"""Identities of the bridge, slices, ledger check, ridge and waterfall."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwise.operators import decomposition as parts

START = dt.date(2022, 6, 15)
PERIODS = "finding_id string, sku string, units_0 double, units_1 double, revenue_0 double, revenue_1 double"


def test_random_bridges_reconcile(spark):
    rng = np.random.default_rng(11)
    rows = []
    for f in range(60):
        for s in range(rng.integers(1, 12)):
            u0, u1 = (float(rng.integers(0, 50)) for _ in range(2))
            rows.append((f"f{f}", f"s{s}", u0, u1, u0 * float(rng.uniform(1, 9)), u1 * float(rng.uniform(1, 9))))
    out = parts.price_volume_mix(spark.createDataFrame(rows, PERIODS)).collect()
    for r in out:
        if r.q0 > 0:
            assert r.status == "ok" and abs(r.residual) < 1e-6
        else:
            assert r.status == "no_baseline"


def test_price_rise_is_price_and_launch_is_mix(spark):
    out = {r.finding_id: r for r in parts.price_volume_mix(spark.createDataFrame([
        ("price", "a", 10.0, 10.0, 100.0, 120.0),
        ("launch", "a", 10.0, 5.0, 100.0, 50.0), ("launch", "b", 0.0, 5.0, 0.0, 100.0)], PERIODS)).collect()}
    assert out["price"].price == pytest.approx(20.0) and out["price"].volume == 0.0
    assert out["launch"].mix == pytest.approx(50.0) and out["launch"].price == pytest.approx(0.0)


@pytest.fixture(scope="module")
def finding(spark):
    return spark.createDataFrame([("f", "N", START, START + dt.timedelta(days=1))],
                                 "finding_id string, region string, start date, end date")


def test_means_are_over_calendar_days(spark, finding):
    facts = spark.createDataFrame(
        [("N", START - dt.timedelta(days=3), "x", 1.0, 140.0), ("N", START, "x", 1.0, 50.0)],
        "region string, d date, sku string, units double, revenue double")
    row = parts.two_periods(finding, facts, ("sku",)).first()
    assert row.revenue_0 == pytest.approx(10.0) and row.revenue_1 == pytest.approx(25.0)


def test_slices_sum_to_the_movement(spark, finding):
    rng = np.random.default_rng(5)
    rows = [("N", START + dt.timedelta(days=int(d)), c, s, 1.0, float(rng.uniform(1, 9)))
            for d in range(-14, 2) for c in "ab" for s in "xyz"]
    facts = spark.createDataFrame(rows, "region string, d date, channel string, sku string, units double, revenue double")
    out = parts.contributions(finding, facts, ("channel", "sku"))
    sums = [r.s for r in out.groupBy("dimension").agg(F.sum("delta").alias("s")).collect()]
    assert sums[0] == pytest.approx(sums[1])
    assert out.agg(F.sum("share")).first()[0] == pytest.approx(2.0)


@pytest.mark.parametrize("gap,state", [(0.02, "agreed"), (0.08, "drift"), (-0.40, "contradicted")])
def test_ledger_gaps(spark, finding, gap, state):
    mine = spark.createDataFrame([("N", START, 100.0 * (1 + gap))], "region string, d date, primary double")
    theirs = spark.createDataFrame([("N", START, 100.0)], "region string, d date, secondary double")
    assert parts.reconcile_state(finding, parts.reconcile_days(finding, mine, theirs)).first().state == state


def test_no_common_day_is_not_agreement(spark, finding):
    empty = spark.createDataFrame([], "region string, d date, primary double")
    other = spark.createDataFrame([("N", START, 1.0)], "region string, d date, secondary double")
    assert parts.reconcile_state(finding, parts.reconcile_days(finding, empty, other)).first().state == "not_reconciled"


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 2))
    y = 2 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(0, 0.1, 40)
    frame = spark.createDataFrame([("s", float(a), float(b), float(c), 5.0) for (a, b), c in zip(x, y)],
                                  "k string, p double, q double, y double, flat double")
    names = ("p", "q", "flat")
    got = {r.driver: r.coefficient for r in parts.ridge(parts.driver_moments(frame, "k", "y", names), "k", names).collect()}
    xz = (x - x.mean(0)) / x.std(0, ddof=1)
    yz = (y - y.mean()) / y.std()
    want = np.linalg.solve(xz.T @ xz + np.eye(2), xz.T @ yz)
    assert set(got) == {"p", "q"}
    assert got["p"] == pytest.approx(want[0]) and got["q"] == pytest.approx(want[1])


def test_rejected_drivers_are_not_ranked(spark):
    fitted = spark.createDataFrame(
        [("s", "p", 0.9, 40), ("s", "q", -0.4, 40)], "key string, driver string, coefficient double, observations bigint")
    rejected = spark.createDataFrame([("p",)], "driver string")
    rows = parts.rank_drivers(fitted, rejected).collect()
    assert [(r.driver, r.state) for r in rows] == [("q", "hypothesis")]


def test_a_rejected_driver_leaves_the_fit_not_only_the_ranking(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    x[:, 2] = x[:, 0] + 0.2 * x[:, 2]
    y = x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 0.1, 60)
    names = ("p", "q", "r")
    frame = spark.createDataFrame([(k, *map(float, row), float(v)) for k in ("s", "t", "few") for row, v in list(zip(x, y))[:9 if k == "few" else 60]],
                                  "k string, p double, q double, r double, y double")
    barred = spark.createDataFrame([("s", "p"), ("s", "p"), ("u", "q")], "k string, driver string")
    moments = parts.driver_moments(frame, "k", "y", names)
    got = {(r.key, r.driver): r.coefficient for r in parts.ridge(moments, "k", names, floor=0.0, rejected=barred).collect()}
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    yz = (y - y.mean()) / y.std()
    for key, kept in (("s", [1, 2]), ("t", [0, 1, 2])):
        want = np.linalg.solve(z[:, kept].T @ z[:, kept] + np.eye(len(kept)), z[:, kept].T @ yz)
        assert {d for k, d in got if k == key} == {names[i] for i in kept}
        assert [got[key, names[i]] for i in kept] == pytest.approx(list(want))
    assert not any(k == "few" for k, _ in got)
    assert "Python" not in parts.ridge(moments, "k", names)._jdf.queryExecution().toString()


def test_waterfall_scales_overlap_and_adds_back(spark):
    moved = spark.createDataFrame([("f", 100.0, 40.0, -60.0)],
                                  "finding_id string, base_revenue double, current_revenue double, total_change double")
    cause = spark.createDataFrame([("f", "a", -60.0), ("f", "b", -60.0)],
                                  "finding_id string, candidate_id string, contribution double")
    steps = parts.waterfall(moved, cause).collect()
    assert sorted(r.value for r in steps) == [-30.0, -30.0]
    half = parts.waterfall(moved, cause.filter("candidate_id = 'a'").withColumn("contribution", F.lit(-20.0))).collect()
    assert {r.kind: r.value for r in half} == {"cause": -20.0, "rest": -40.0}
