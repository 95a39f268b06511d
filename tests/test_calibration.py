"""The isotonic curve against its max-min definition."""

import random

import pytest

from driftwise.operators import calibration

CASE = "case_id string, confidence double, correct boolean"


def table(spark, rows):
    return spark.createDataFrame([(f"c{i}", float(x), bool(y)) for i, (x, y) in enumerate(rows)], CASE)


def steps(rows):
    """(score, fit): the largest of the least means, by definition."""
    xs = sorted({x for x, _ in rows})
    n = {x: sum(a == x for a, _ in rows) for x in xs}
    h = {x: sum(b for a, b in rows if a == x) for x in xs}

    def mean(i, j):
        return sum(h[x] for x in xs[i:j + 1]) / sum(n[x] for x in xs[i:j + 1])

    return [(x, max(min(mean(i, j) for j in range(k, len(xs))) for i in range(k + 1))) for k, x in enumerate(xs)]


def read(curve, x):
    below, above = [s for s in curve if s[0] <= x], [s for s in curve if s[0] >= x]
    if not below or not above:
        return (below[-1] if below else above[0])[1]
    (a, u), (b, v) = below[-1], above[0]
    return u if a == b else u + (v - u) * (x - a) / (b - a)


@pytest.mark.parametrize("parts", [1, 7])
def test_curve_and_reading_as_the_definition(spark, parts):
    r = random.Random(parts)
    rows = [(round(x, 2), r.random() < 0.2 + 0.6 * x) for x in (0.05 + 0.9 * r.random() for _ in range(150))]
    pieces = {x: p.value for p in calibration.curve(table(spark, rows), parts).collect() for x, _ in rows if p.lo <= x <= p.hi}
    want = steps(rows)
    assert pieces == pytest.approx(dict(want))
    asked = [(x, True) for x in (0.0, 0.01, 0.04, 0.5, 0.555, 0.7777, 0.97, 1.0, *(a for a, _ in rows[:20]))]
    got = calibration.calibrated(table(spark, asked), table(spark, rows)).collect()
    assert len(got) == len(asked)
    assert all(g.probability == pytest.approx(read(want, g.confidence)) for g in got)


def test_calibration_needs_outcomes_and_both_classes(spark):
    rows = [(i / 60, i > 30) for i in range(60)]
    told = calibration.calibrated(table(spark, rows), table(spark, rows)).orderBy("confidence").collect()
    probs = [r.probability for r in told]
    assert probs == sorted(probs) and probs[0] == 0.0 and probs[-1] == 1.0
    for few in (rows[:30], [(x, True) for x, _ in rows], [(x, False) for x, _ in rows], []):
        got = calibration.calibrated(table(spark, rows), table(spark, few)).collect()
        assert len(got) == 60 and {r.probability for r in got} == {None}


def test_nothing_to_calibrate(spark):
    rows = [(i / 60, i > 30) for i in range(60)]
    assert calibration.calibrated(table(spark, []), table(spark, rows)).collect() == []
