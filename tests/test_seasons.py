"""Decomposition by local lines against the same definition in plain Python."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from driftwise.operators import seasons

DAY0 = dt.datetime(2021, 3, 1)


def line(points, at, reach):
    """The weighted line through (x, y) points, by the usual formulas around their weighted mean."""
    near = [(x, y, (1 - (abs(x - at) / (reach + 1)) ** 3) ** 3) for x, y in points if abs(x - at) <= reach]
    total = sum(w for *_, w in near)
    mx, my = sum(x * w for x, _, w in near) / total, sum(y * w for _, y, w in near) / total
    spread = sum(w * (x - mx) ** 2 for x, _, w in near)
    if total * spread <= 1e-9:
        return my
    return my + sum(w * (x - mx) * (y - my) for x, y, w in near) / spread * (at - mx)


def mean(values, at, period):
    def over(low, high):
        held = [y for x, y in values.items() if at + low <= x <= at + high]
        return sum(held) / len(held)

    half = period // 2
    return over(-half, half) if period % 2 else (over(-half, half - 1) + over(1 - half, half)) / 2


def plain(values, periods, least):
    rest, parts = dict(values), {p: dict.fromkeys(values, 0.0) for p in periods}
    for period in [*periods] * seasons.PASSES:
        if len(values) < least * period:
            continue
        held = {x: rest[x] + parts[period][x] for x in values}
        swing = {x: held[x] - mean(held, x, period) for x in values}
        raw = {x: line([(o // period, swing[o]) for o in values if o % period == x % period], x // period, seasons.CYCLES) for x in values}
        parts[period] = {x: raw[x] - mean(raw, x, period) for x in values}
        rest = {x: held[x] - parts[period][x] for x in values}
    stiff = [p for p in periods if len(values) >= least * p]
    reach = 2 * (stiff[-1] if stiff else periods[0])
    trend = {x: line(list(rest.items()), x, reach) for x in values}
    return {x: (trend[x], *(parts[p][x] for p in periods)) for x in values}


def frame(spark, named, step):
    rows = [(k, DAY0 + x * step, float(y), len(values)) for k, values in named.items() for x, y in values.items()]
    return spark.createDataFrame(rows, "kpi_id string, ts timestamp_ntz, level double, rows long")


@pytest.mark.parametrize(("grain", "step", "unit", "periods"), [
    ("day", dt.timedelta(days=1), 86400, (7, 30)), ("hour", dt.timedelta(hours=1), 3600, (6, 24))])
def test_as_the_definition(spark, monkeypatch, grain, step, unit, periods):
    monkeypatch.setitem(seasons.SEASONS, grain, periods)
    r = random.Random(4)

    def some(n):
        return {x: 5 + 0.01 * x + math.sin(x * 6.283 / periods[0]) + r.gauss(0, 0.2) for x in range(n) if r.random() < 0.95}

    named = {"long": some(170), "short": some(70), "tiny": some(9), "one": {0: 2.0}}
    got = seasons.decompose(frame(spark, named, step), grain, ["kpi_id"], 4).collect()
    first = int((DAY0 - dt.datetime(1970, 1, 1)).total_seconds()) // unit
    for name, values in named.items():
        want = plain({first + x: y for x, y in values.items()}, periods, 4)
        mine = {r.ts: r for r in got if r.kpi_id == name}
        assert len(mine) == len(values)
        for x in values:
            row = mine[DAY0 + x * step]
            trend, short, long = want[first + x]
            assert row.log_trend == pytest.approx(trend, abs=1e-9)
            assert row[f"season_{periods[0]}"] == pytest.approx(short, abs=1e-9)
            assert row[f"season_{periods[1]}"] == pytest.approx(long, abs=1e-9)
            assert row.log_season == pytest.approx(short + long, abs=1e-9)


def test_two_planted_seasons_are_told_apart(spark):
    week = [0.3, 0, 0, 0, 0.1, 0, -0.4]
    values = {x: 3 + 0.002 * x + week[x % 7] + 0.5 * math.sin(2 * math.pi * x / 365) for x in range(1600)}
    rows = seasons.decompose(frame(spark, {"k": values}, dt.timedelta(days=1)), "day", ["kpi_id"], 4)
    rows = rows.withColumn("x", F.datediff("ts", F.lit(DAY0.date()))).filter("x between 550 and 1050").collect()
    assert max(abs(r.season_7 - week[r.x % 7]) for r in rows) < 0.02
    assert max(abs(r.season_365 - 0.5 * math.sin(2 * math.pi * r.x / 365)) for r in rows) < 0.12
    assert max(abs(r.log_trend - 3 - 0.002 * r.x) for r in rows) < 0.12


def test_a_straight_line_is_its_own_trend(spark):
    got = seasons.decompose(frame(spark, {"k": {x: 1 + 0.25 * x for x in range(90)}}, dt.timedelta(days=1)), "day", ["kpi_id"], 4).collect()
    middle = [r for r in got if 20 <= (r.ts - DAY0).days < 70]
    assert max(abs(r.level - r.log_trend) for r in middle) < 0.02 and {r.season_365 for r in got} == {0.0}


def test_nothing_and_no_python_worker(spark):
    out = seasons.decompose(frame(spark, {}, dt.timedelta(days=1)), "day", ["kpi_id"], 4)
    assert out.count() == 0 and "Python" not in out._jdf.queryExecution().toString()
