import datetime as dt
import random

import pytest

from driftwise.operators import folding

FINDING = "kpi_id string, direction string, start date, end date, impact double, region string"
D = dt.date(2022, 1, 1)


def above(parents):
    """Every metric's ancestors."""
    out = {}

    def climb(kpi):
        return {p for q in parents.get(kpi, ()) for p in {q, *climb(q)}}

    for kpi in {*parents, *(p for ps in parents.values() for p in ps)}:
        out[kpi] = climb(kpi)
    return out


def one_after_the_other(rows, ancestors):
    """The definition itself: findings taken by falling impact, in each region."""
    events = []
    for kpi, direction, start, end, impact, region in sorted(rows, key=lambda r: (-r[4], r[0], r[2], r[3], r[1])):
        fitting = [e for e in events if e["region"] == region and kpi not in {m[0] for m in e["rows"]} and any(
            m[2] <= end and start <= m[3] and (m[0] in ancestors.get(kpi, ()) or kpi in ancestors.get(m[0], ())) for m in e["rows"])]
        if fitting:
            fitting[0]["rows"].append((kpi, direction, start, end, impact))
        else:
            events.append({"region": region, "rows": [(kpi, direction, start, end, impact)]})
    out = set()
    for e in events:
        head = min(e["rows"], key=lambda m: (len(ancestors.get(m[0], ())), -m[4], m[0], m[2]))
        out.add((e["region"], *head[:5], ",".join(sorted(m[0] for m in e["rows"] if m is not head))))
    return out


def folded(spark, rows, ancestors):
    pairs = [(k, a) for k, up in ancestors.items() for a in up]
    got = folding.fold(spark.createDataFrame(rows, FINDING), spark.createDataFrame(pairs, "kpi_id string, ancestor string"))
    return [(r.region, r.kpi_id, r.direction, r.start, r.end, r.impact, ",".join(r.also_moved)) for r in got.collect()]


def test_children_fold_into_the_parent(spark):
    rows = [("net_revenue", "drop", D, D, 50.0, "North"), ("orders", "drop", D, D, 90.0, "North"),
            ("orders", "drop", dt.date(2022, 3, 1), dt.date(2022, 3, 2), 10.0, "North"), ("orders", "drop", D, D, 90.0, "South")]
    kept = folded(spark, rows, {"orders": {"net_revenue"}, "net_revenue": set()})
    assert len(kept) == 3
    assert [k[-1] for k in kept if k[1] == "net_revenue"] == ["orders"]


@pytest.mark.parametrize("seed", range(2))
def test_events_as_one_finding_after_the_other(spark, seed):
    r = random.Random(seed)
    ancestors = above({"orders": ["revenue"], "aov": ["revenue"], "visits": ["orders"], "rate": ["orders", "visits"], "late": []})
    rows = set()
    for _ in range(160):
        start = D + dt.timedelta(r.randrange(120 if seed % 2 else 600))
        rows.add((r.choice([*ancestors]), r.choice(["drop", "spike"]), start, start + dt.timedelta(r.choice([0, 1, 2, 9, 40])),
                  float(r.choice([r.randint(1, 9), r.randint(1, 5000)])), r.choice(["N", "S"])))
    got = folded(spark, sorted(rows), ancestors)
    want = one_after_the_other(rows, ancestors)
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(bool(e[-1]) for e in want) > 10


def test_a_long_chain_of_overlaps_in_one_region(spark):
    """Each finding overlaps the one before, and which event it joins hangs on all before it."""
    ancestors = above({"b": ["a"], "c": ["b"]})
    rows = [("abc"[i % 3], "drop", D + dt.timedelta(2 * i), D + dt.timedelta(2 * i + 2), 1000.0 - i, "N") for i in range(24)]
    assert set(folded(spark, rows, ancestors)) == one_after_the_other(rows, ancestors)


def test_nothing_folds_into_nothing(spark):
    assert folded(spark, [], {"b": {"a"}}) == []
    alone = [("x", "drop", D, D, 1.0, "N"), ("y", "drop", D, D, 1.0, "N")]
    assert len(folded(spark, alone, {"b": {"a"}})) == 2


def test_no_python_worker_and_no_window_over_a_region(spark):
    frame = folding.heavier_kin(
        folding.weighed(spark.createDataFrame([("b", "drop", D, D, 1.0, "N")], FINDING)),
        folding.kin_pairs(spark.createDataFrame([("b", "a")], "kpi_id string, ancestor string")))
    home = frame.select("me", frame["me"].alias("home"))
    plan = folding.chosen(frame, home)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Window" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
