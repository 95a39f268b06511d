"""Trend and several seasons of many series at once, by local weighted regression.

Readings stand at whole numbers of days or hours, so gaps stay gaps. Seasons are fitted in
turn, the shortest first, each on what the others leave, and again ``PASSES`` times:

* the level under a season is the centred mean over one period;
* what is left is smoothed phase by phase, along the cycles, by local lines;
* of that, the centred mean over one period is taken out, so a season has no level.

The trend is a local line through the readings less all seasons. A local line weighs the
readings within its reach by the tricube of their distance; its value comes from five sums
over a sliding window, so a series is sorted once and never joined to itself. At the ends
of a series the window has one side only and the line leans on it.

A series is bounded by the calendar. All windows are over one series, or one phase of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seasons by grain, in readings; one with fewer than MIN_CYCLES periods of readings is left out.
SEASONS = {"hour": (24, 168), "day": (7, 365), "week": (52,)}
STEP = {
    "hour": "timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', ts)",
    "day": "cast(datediff(ts, date'1970-01-01') as bigint)",
    "week": "datediff(ts, date'1970-01-05') div 7",
}
PASSES = 2
#: Cycles to either side that smooth a phase.
CYCLES = 5


def local_line(x: Column, y: Column, reach: int, window) -> Column:
    """The value at x of the line through the readings within reach, weighed by tricube."""
    points = F.collect_list(F.struct(x.alias("x"), y.alias("y"))).over(window.rangeBetween(-reach, reach))

    def weighed(p: Column) -> Column:
        d = (p["x"] - x).cast("double")
        near = 1.0 - F.pow(F.abs(d) / F.lit(float(reach + 1)), 3)
        return F.struct((near * near * near).alias("w"), d.alias("d"), p["y"].alias("y"))

    zero = F.lit(0.0)
    start = F.struct(*[zero.alias(n) for n in ("s0", "s1", "s2", "t0", "t1")])

    def add(a: Column, p: Column) -> Column:
        w, d = p["w"], p["d"]
        return F.struct((a["s0"] + w).alias("s0"), (a["s1"] + w * d).alias("s1"), (a["s2"] + w * d * d).alias("s2"),
                        (a["t0"] + w * p["y"]).alias("t0"), (a["t1"] + w * d * p["y"]).alias("t1"))

    def value(s: Column) -> Column:
        spread = s["s0"] * s["s2"] - s["s1"] * s["s1"]
        return F.when(spread > 1e-9, (s["s2"] * s["t0"] - s["s1"] * s["t1"]) / spread).otherwise(s["t0"] / s["s0"])

    return F.aggregate(F.transform(points, weighed), start, add, value)


def centred_mean(y: Column, period: int, window) -> Column:
    """The mean over one period around each reading; for an even one, of the two windows that are nearest."""
    half = period // 2
    if period % 2:
        return F.avg(y).over(window.rangeBetween(-half, half))
    return (F.avg(y).over(window.rangeBetween(-half, half - 1)) + F.avg(y).over(window.rangeBetween(1 - half, half))) / 2


def season(frame: DataFrame, keys: Sequence[str], period: int, least_cycles: int) -> DataFrame:
    """Fits ``season_<period>`` anew on what the other seasons leave in ``rest``, and takes it out of ``rest``."""
    name = f"season_{period}"
    whole = Window.partitionBy(*keys).orderBy("at")
    phase = Window.partitionBy(*keys, "phase").orderBy("cycle")
    fitted = (
        frame.withColumn("open", F.col("rest") + F.col(name))
        .withColumns({"phase": F.expr(f"pmod(at, {period})"), "cycle": F.expr(f"floor(at / {period})")})
        .withColumn("swing", F.col("open") - centred_mean(F.col("open"), period, whole))
        .withColumn("raw", local_line(F.col("cycle"), F.col("swing"), CYCLES, phase))
        .withColumn("fit", F.col("raw") - centred_mean(F.col("raw"), period, whole))
        .withColumn(name, F.when(F.col("rows") >= least_cycles * period, F.col("fit")).otherwise(F.lit(0.0)))
        .withColumn("rest", F.col("open") - F.col(name))
    )
    return fitted.drop("open", "phase", "cycle", "swing", "raw", "fit")


def decompose(logged: DataFrame, grain: str, keys: Sequence[str], least_cycles: int) -> DataFrame:
    """Adds log_trend, log_season (all seasons) and season_<period> to rows with keys, ts, level and rows (their number)."""
    periods = SEASONS[grain]
    frame = logged.withColumns({"at": F.expr(STEP[grain]), "rest": F.col("level"),
                                **{f"season_{p}": F.lit(0.0) for p in periods}})
    for _ in range(PASSES):
        for period in periods:
            frame = season(frame, keys, period, least_cycles)
    # The trend is as stiff as the longest season that the series can carry.
    whole = Window.partitionBy(*keys).orderBy("at")
    trend = None
    for period in periods:
        line = local_line(F.col("at"), F.col("rest"), 2 * period, whole)
        trend = line if trend is None else F.when(F.col("rows") >= least_cycles * period, line).otherwise(trend)
    return frame.withColumn("log_trend", trend).withColumn(
        "log_season", sum((F.col(f"season_{p}") for p in periods), F.lit(0.0))).drop("at", "rest")
