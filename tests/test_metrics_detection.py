"""Roll-ups, baselines, episodes and the queue."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwise.config import RETAIL, Kpi
from driftwise.operators import detection, metrics
from driftwise.operators.lineage import PolicyError

DAY0 = dt.datetime(2022, 1, 3)


def series(spark, values, kpi="net_revenue", region="North", n=None):
    rows = [(kpi, region, DAY0 + dt.timedelta(days=i), float(v),
             None if n is None else float(n[i]), 1.0, n is not None, False)
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "kpi_id string, region string, ts timestamp_ntz, value double,"
                                 " n double, festival double, proportion boolean, counting boolean")


def weekly(days=500, seed=3):
    rng = np.random.default_rng(seed)
    shape = np.array([1.0, 0.95, 0.97, 1.02, 1.2, 1.4, 0.8])
    return 1000 * shape[np.arange(days) % 7] * np.exp(rng.normal(0, 0.02, days))


def test_a_ratio_is_never_an_average_of_ratios(spark):
    kpi = RETAIL["checkout_conversion"]
    rows = [(1, "a", 1.0, 100.0), (1, "b", 90.0, 900.0), (2, "a", 0.0, 0.0)]
    rolled = metrics.roll_up(spark.createDataFrame(
        rows, "ts int, device string, converted double, sessions double"), kpi)
    got = {r.ts: (r.value, r.n) for r in rolled.collect()}
    assert got[1] == (pytest.approx(0.091), 1000.0)
    assert got[2] == (None, 0.0)


def test_a_ratio_without_its_parts_is_refused(spark):
    with pytest.raises(PolicyError):
        metrics.roll_up(spark.createDataFrame([(1, 0.5)], "ts int, value double"),
                        RETAIL["on_time_delivery"])
    with pytest.raises(ValueError):
        Kpi("x", "net", "ratio", "day", (), "o", (), aggregation="mean")


@pytest.mark.parametrize("fit", [detection.baseline, detection.loess_baseline])
def test_a_planted_drop_is_the_worst_day(spark, fit):
    values = weekly()
    values[300:304] *= 0.6
    scored = fit(series(spark, values), "day")
    worst = scored.orderBy("z").first()
    assert DAY0 + dt.timedelta(days=300) <= worst.ts <= DAY0 + dt.timedelta(days=303)
    assert worst.z < -6
    flagged = {r.ts for r in scored.filter(F.abs("z") >= 3).collect()}
    assert {DAY0 + dt.timedelta(days=d) for d in range(300, 304)} <= flagged
    assert len(flagged) < 0.06 * len(values)


def test_expected_lies_inside_its_band(spark):
    row = detection.baseline(series(spark, weekly()), "day").filter(
        "not (band_low <= expected and expected <= band_high)")
    assert row.count() == 0


def test_short_history_is_not_fitted(spark):
    frame = series(spark, weekly(59))
    assert detection.baseline(frame, "day").count() == 0
    assert detection.sparse(frame, "day").first().verdict == "sparse_history"
    assert detection.sparse(series(spark, weekly(60)), "day").first().verdict == "fitted"


def test_thin_readings_get_wider_bands(spark):
    n = np.where(np.arange(400) % 2 == 0, 50, 900)
    rng = np.random.default_rng(1)
    rate = rng.binomial(n, 0.05) / n
    scale = {bool(r.thin): r.s for r in detection.baseline(
        series(spark, rate, "checkout_conversion", n=n), "day")
        .groupBy((F.col("n") < 100).alias("thin")).agg(F.avg("scale").alias("s")).collect()}
    assert scale[True] > 3 * scale[False]


def test_zero_rates_stay_finite(spark):
    n = np.full(200, 50)
    scored = detection.baseline(series(spark, np.where(np.arange(200) % 9 == 0, 0.0, 0.05),
                                       "checkout_conversion", n=n), "day")
    assert all(math.isfinite(r.z) for r in scored.select("z").collect())


def test_festival_curve(spark):
    peaks = spark.createDataFrame([(dt.date(2022, 10, 24), 0.85)], "peak date, weight double")
    days = spark.createDataFrame([(dt.date(2022, 10, 24) + dt.timedelta(days=o),)
                                  for o in range(-20, 10)], "day date")
    got = {r.day: r.festival for r in detection.festival_factor(days, peaks).collect()}
    at = lambda o: got[dt.date(2022, 10, 24) + dt.timedelta(days=o)]
    assert at(0) == pytest.approx(1.85) and at(-18) == 1.0 and at(-19) == 1.0
    assert at(-9) == pytest.approx(1 + 0.85 * 0.25)
    assert at(1) == pytest.approx(1 - 0.85 * 0.25 * 6 / 7) and at(7) == 1.0 and at(9) == 1.0


def flags(spark, offsets):
    return spark.createDataFrame(
        [("k", "r", DAY0 + dt.timedelta(days=o), d, 100.0, -4.0, "drop", 2.0) for o, d in offsets],
        "kpi_id string, region string, ts timestamp_ntz, delta double, expected double, z double,"
        " direction string, value_per_unit double")


def test_gaps_of_two_days_join_and_three_split(spark):
    found = detection.episodes(flags(spark, [(0, -10.0), (2, -30.0), (5, -20.0)])).orderBy("start").collect()
    assert [r.days for r in found] == [2, 1]
    assert found[0].worst_day == (DAY0 + dt.timedelta(days=2)).date()
    assert found[0].impact == pytest.approx(40.0)


def test_closure_reaches_grandparents(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a")], "child string, parent string")
    assert {tuple(r) for r in detection.ancestors(edges).collect()} == {("c", "b"), ("c", "a"), ("b", "a")}


def test_plan_holds_until_replaced(spark):
    facts = spark.createDataFrame([("N", dt.date(2022, 1, d), 2.0, 10.0) for d in (1, 4, 9)],
                                  "region string, d date, units double, revenue double")
    plan = spark.createDataFrame([("N", dt.date(2022, 1, 3), 7.0, 1.1), ("N", dt.date(2022, 1, 9), 8.0, 1.2)],
                                 "region string, week date, spend double, idx double")
    got = [(r.d.day, r.spend) for r in metrics.price_path(facts, plan, ("spend",), "idx").orderBy("d").collect()]
    assert got == [(1, None), (4, 7.0), (9, 8.0)]
