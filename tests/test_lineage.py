"""Row transforms, policy and stages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftwise.operators import lineage

SCHEMA = ("order_id string, order_ts timestamp_ntz, region string, channel string,"
          " qty long, is_test boolean")
T0 = dt.datetime(2024, 1, 1, 12)


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([
        ("a", T0, "East", "web", 1, False), ("a", T0, "East", "web", 1, False),
        ("a", T0 + dt.timedelta(hours=1), "East", "web", 9, False),
        ("b", T0, "West", "store", 2, False), ("c", T0, "West", "app", 3, True)], SCHEMA)


def test_one_row_per_key_whatever_the_partitioning(facts):
    once = {tuple(r) for r in lineage.dedupe_order_id(facts).collect()}
    again = {tuple(r) for r in lineage.dedupe_order_id(facts.repartition(7, "qty")).collect()}
    assert once == again and len(once) == 3


def test_only_the_late_clock_moves(facts):
    moved = {r.region: r.order_ts for r in lineage.tz_normalise(facts).filter("qty in (1, 2)").collect()}
    assert moved["East"] == T0 - dt.timedelta(hours=5, minutes=30)
    assert moved["West"] == T0


def test_an_undeclared_transform_is_refused(facts):
    with pytest.raises(lineage.PolicyError):
        lineage.apply_chain(facts, ["no_such_step"])


def test_chain_order_matters(facts):
    first = lineage.apply_chain(facts, ["exclude_test_accounts", "dedupe_order_id"]).count()
    assert first == 2


def test_none_is_unrestricted_and_empty_is_refused(facts):
    assert lineage.entitled(facts, None).count() == 5
    assert lineage.entitled(facts, ["West"]).count() == 2
    with pytest.raises(lineage.PolicyError):
        lineage.entitled(facts, [])
    with pytest.raises(lineage.PolicyError):
        lineage.entitled(facts.drop("region"), ["West"])


def test_masks_and_slices(facts):
    assert "qty" not in lineage.masked(facts, ["qty", "absent"]).columns
    assert lineage.narrowed(facts, {"channel": "web"}).count() == 3
    with pytest.raises(lineage.PolicyError):
        lineage.narrowed(facts, {"device": "mobile"})


def test_missing_reading_is_stale(spark):
    sla = spark.createDataFrame([("k", "seen", 6), ("k", "unseen", 6)],
                                "kpi_id string, source_id string, sla_hours int")
    readings = spark.createDataFrame([("seen", T0, T0 + dt.timedelta(hours=5))],
                                     "source_id string, as_of timestamp_ntz, observed_at timestamp_ntz")
    met = {r.source_id: (r.lag_hours, r.sla_met) for r in lineage.freshness(readings, sla).collect()}
    assert met == {"seen": (5.0, True), "unseen": (7.0, False)}


def test_a_stage_is_built_once_and_equals_its_source(spark, facts, tmp_path, monkeypatch):
    monkeypatch.setattr(lineage, "shared_folder", lambda _: str(tmp_path))
    built = []

    def build():
        built.append(1)
        return lineage.dedupe_order_id(facts)

    first = lineage.materialise(spark, build, "facts", ("v1",))
    second = lineage.materialise(spark, build, "facts", ("v1",))
    assert built == [1]
    assert first.exceptAll(second).count() == 0
    assert second.exceptAll(lineage.dedupe_order_id(facts)).count() == 0
    lineage.materialise(spark, build, "facts", ("v2",))
    assert built == [1, 1]


def test_replication_keeps_totals_per_copy(facts):
    many = lineage.replicated(facts, 3, ("order_id",))
    sums = {r.region: r.q for r in many.groupBy("region").agg(F.sum("qty").alias("q")).collect()}
    assert sums["East-r0"] == sums["East-r2"] == 11 and len(sums) == 6
