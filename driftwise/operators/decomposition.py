"""Where a movement sits: second ledgers, price/volume/mix, slices, drivers.

All of these take a table of findings (finding_id, region, start, end) and answer
for every finding at once. A finding's two periods are spread to days and matched
to daily facts by equality on (region, day), so no range join is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwise.config import (
    BASELINE_DAYS,
    CONTRADICTION_MULTIPLE,
    IDENTITY_TOLERANCE,
    RECONCILE_TOLERANCE,
)
from driftwise.functions.columns import ratio


def reconcile_days(findings: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Both postings of every day of every finding, with their residual."""
    days = findings.select("finding_id", "region", F.explode(F.sequence("start", "end")).alias("d"))
    gap = F.when((F.col("secondary") == 0) | F.col("secondary").isNull(), 0.0).otherwise(
        (F.col("primary") - F.col("secondary")) / F.col("secondary"))
    return (
        days.join(primary.select("region", "d", "primary"), ["region", "d"])
        .join(secondary.select("region", "d", "secondary"), ["region", "d"])
        .select("finding_id", "d", "primary", "secondary", gap.alias("residual"))
    )


def reconcile_state(findings: DataFrame, days: DataFrame,
                    tolerance: float = RECONCILE_TOLERANCE) -> DataFrame:
    """agreed, drift or contradicted; with no common day, not_reconciled."""
    worst = days.groupBy("finding_id").agg(
        F.count(F.lit(1)).alias("days_compared"),
        F.max(F.abs("residual")).alias("worst"),
        F.count_if(F.abs("residual") > tolerance).alias("breaches"))
    state = (
        F.when(F.col("days_compared").isNull(), "not_reconciled")
        .when(F.col("worst") > tolerance * CONTRADICTION_MULTIPLE, "contradicted")
        .when(F.col("breaches") > 0, "drift")
        .otherwise("agreed")
    )
    return findings.select("finding_id").join(worst, "finding_id", "left").select(
        "finding_id", state.alias("state"),
        F.coalesce("days_compared", F.lit(0)).alias("days_compared"),
        F.coalesce("worst", F.lit(0.0)).alias("worst"),
        F.coalesce("breaches", F.lit(0)).alias("breaches"))


def two_periods(findings: DataFrame, facts: DataFrame, keys: Sequence[str],
                baseline_days: int = BASELINE_DAYS) -> DataFrame:
    """Units and revenue per finding and key, per calendar day, before and during.

    Each side is divided by the length of its period, not by the days seen.
    """
    days = findings.select(
        "finding_id", "region",
        F.explode(F.sequence(F.date_sub("start", baseline_days), F.col("end"))).alias("d"),
        (F.datediff("end", "start") + 1).alias("length"), "start")
    before = F.col("d") < F.col("start")

    def side(column: str, base: bool) -> Column:
        picked = F.when(before if base else ~before, F.col(column))
        total = F.coalesce(F.sum(picked), F.lit(0.0))
        return total / (F.lit(baseline_days) if base else F.first("length"))

    return days.join(facts, ["region", "d"]).groupBy("finding_id", *keys).agg(
        side("units", True).alias("units_0"), side("units", False).alias("units_1"),
        side("revenue", True).alias("revenue_0"), side("revenue", False).alias("revenue_1"))


def price_volume_mix(periods: DataFrame) -> DataFrame:
    """Split each finding's movement into volume, mix and price.

    ``periods`` has one row per finding and product. A product missing from one
    period borrows its price from the other, so launches and delistings count as
    mix. Everything reduces to five sums per finding:
      A = sum(units_0 * price_0), B = sum(units_1 * price_0), totals q0 and q1
      volume = (q1 - q0) * A / q0, mix = B - q1 * A / q0, price = revenue_1 - B
    """
    seen_0 = ratio(F.col("revenue_0"), F.col("units_0"))
    seen_1 = ratio(F.col("revenue_1"), F.col("units_1"))
    priced = periods.withColumn("price_0", F.coalesce(seen_0, seen_1, F.lit(0.0))) \
        .withColumn("price_1", F.coalesce(seen_1, seen_0, F.lit(0.0)))
    sums = priced.groupBy("finding_id").agg(
        F.sum("units_0").alias("q0"), F.sum("units_1").alias("q1"),
        F.sum("revenue_0").alias("base_revenue"), F.sum("revenue_1").alias("current_revenue"),
        F.sum(F.col("units_0") * F.col("price_0")).alias("a"),
        F.sum(F.col("units_1") * F.col("price_0")).alias("b"),
        F.sum(F.col("units_1") * F.col("price_1")).alias("c"),
        F.count(F.lit(1)).alias("products"))
    carried = F.when(F.col("q1") > 0, F.col("q1")).otherwise(0.0)
    average = F.col("a") / F.nullif(F.col("q0"), F.lit(0.0))
    legs = (
        sums.withColumn("volume", (F.col("q1") - F.col("q0")) * average)
        .withColumn("mix", F.when(F.col("q1") > 0, F.col("b") - carried * average)
                    .otherwise(-F.col("q1") * average))
        .withColumn("price", F.when(F.col("q1") > 0, F.col("c") - F.col("b")).otherwise(0.0))
        .withColumn("total_change", F.col("current_revenue") - F.col("base_revenue"))
    )
    left = F.col("total_change") - F.col("volume") - F.col("mix") - F.col("price")
    status = (
        F.when(F.col("q0") <= 0, "no_baseline")
        .when(F.abs(left) > IDENTITY_TOLERANCE, "does_not_reconcile")
        .otherwise("ok")
    )
    return legs.withColumn("residual", left).withColumn("status", status)


def contributions(findings: DataFrame, facts: DataFrame, dims: Sequence[str],
                  baseline_days: int = BASELINE_DAYS) -> DataFrame:
    """Each slice's part of each finding's movement, one dimension at a time.

    The facts are folded to finding and slice combination first and only then
    laid out per dimension, so the wide rows are never multiplied.
    """
    folded = two_periods(findings, facts, dims, baseline_days)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("slice")) for d in dims]))
    per_slice = (
        folded.select("finding_id", "revenue_0", "revenue_1", pairs.alias("p"))
        .groupBy("finding_id", "p.dimension", "p.slice")
        .agg(F.sum("revenue_0").alias("base"), F.sum("revenue_1").alias("current"))
        .withColumn("delta", F.col("current") - F.col("base"))
    )
    total = F.sum("delta").over(Window.partitionBy("finding_id", "dimension"))
    return (
        per_slice.withColumn("total", total)
        .withColumn("share", F.coalesce(ratio(F.col("delta"), F.col("total")), F.lit(0.0)))
        .withColumn("pct_change", ratio(F.col("current"), F.col("base")) - 1)
    )


def along(delta: str = "delta", total: str = "total") -> Column:
    """Sort key: largest in the movement's own direction first."""
    return F.when(F.col(total) < 0, -F.col(delta)).otherwise(F.col(delta)).desc()


def concentration(slices: DataFrame, top: int) -> DataFrame:
    """How much of the movement the first few slices of a dimension carry."""
    rank = F.row_number().over(
        Window.partitionBy("finding_id", "dimension").orderBy(along(), "slice"))
    return (
        slices.withColumn("rn", rank).filter(F.col("rn") <= top)
        .groupBy("finding_id", "dimension")
        .agg(F.coalesce(ratio(F.sum("delta"), F.first("total")), F.lit(0.0)).alias("top_share"))
    )


def rank_exact(slices: DataFrame, top: int = 8) -> DataFrame:
    """The largest slices over all dimensions; an identity, so state verified."""
    rank = F.row_number().over(
        Window.partitionBy("finding_id").orderBy(along(), "dimension", "slice"))
    return slices.withColumn("rank", rank).filter(F.col("rank") <= top).select(
        "finding_id", "rank", F.lit("exact").alias("track"), "dimension", "slice",
        F.col("delta").alias("value"), "share", F.lit("verified").alias("state"))


def driver_moments(series: DataFrame, key: str, target: str, drivers: Sequence[str]) -> DataFrame:
    """Everything a ridge fit needs, as sums: counts, spreads and correlations."""
    def corr(a: str, b: str) -> Column:
        """Null, not an error, where either side does not vary."""
        return F.covar_samp(a, b) / F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0))

    whole = series.dropna(subset=[target, *drivers])
    pair = [corr(a, b).alias(f"r_{i}_{j}") for i, a in enumerate(drivers)
            for j, b in enumerate(drivers) if i < j]
    return whole.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop(target).alias("s_y"),
        *[F.stddev_samp(d).alias(f"s_{i}") for i, d in enumerate(drivers)],
        *[corr(d, target).alias(f"r_y_{i}") for i, d in enumerate(drivers)], *pair)


RIDGE = "key string, driver string, coefficient double, observations bigint"


def ridge(moments: DataFrame, key: str, drivers: Sequence[str], alpha: float = 1.0,
          floor: float = 0.02, min_rows: int = 14, rejected: DataFrame | None = None) -> DataFrame:
    """Standardised ridge coefficients from the moments, by a Cholesky factor in columns.

    With x scaled by its sample and y by its population deviation, the normal
    equations are (n-1) R + alpha I and sqrt(n (n-1)) r. Drivers that do not vary, and
    those that ``rejected`` (key, driver) names, leave the fit: their line of the
    equations is that of the unit matrix.
    """
    names, size = list(drivers), range(len(drivers))
    frame = moments.withColumn("barred", F.array().cast("array<string>"))
    if rejected is not None:
        barred = rejected.groupBy(key).agg(F.collect_set("driver").alias("found"))
        frame = moments.join(barred, key, "left").withColumn("barred", F.coalesce("found", F.array().cast("array<string>")))
    frame = frame.filter((F.col("n") >= min_rows) & (F.col("s_y") > 0)).withColumns({
        f"kept_{i}": F.coalesce(F.col(f"s_{i}") > 0, F.lit(False)) & ~F.array_contains("barred", names[i]) for i in size})

    def cell(i: int, j: int) -> Column:
        if i == j:
            return F.when(F.col(f"kept_{i}"), F.col("n") - 1.0 + alpha).otherwise(F.lit(1.0))
        return F.when(F.col(f"kept_{i}") & F.col(f"kept_{j}"), (F.col("n") - 1.0) * F.col(f"r_{j}_{i}")).otherwise(F.lit(0.0))

    for i in size:
        for j in range(i + 1):
            rest = cell(i, j)
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            frame = frame.withColumn(f"l_{i}_{j}", F.sqrt(rest) if i == j else rest / F.col(f"l_{j}_{j}"))
    for i in size:
        rest = F.when(F.col(f"kept_{i}"), F.col(f"r_y_{i}") * F.sqrt(F.col("n") * (F.col("n") - 1.0))).otherwise(F.lit(0.0))
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        frame = frame.withColumn(f"z_{i}", rest / F.col(f"l_{i}_{i}"))
    for i in reversed(size):
        rest = F.col(f"z_{i}")
        for k in range(i + 1, len(names)):
            rest = rest - F.col(f"l_{k}_{i}") * F.col(f"b_{k}")
        frame = frame.withColumn(f"b_{i}", rest / F.col(f"l_{i}_{i}"))
    told = F.array(*[F.struct(F.lit(names[i]).alias("driver"), F.col(f"b_{i}").alias("coefficient"),
                              F.col(f"kept_{i}").alias("kept")) for i in size])
    return frame.select(F.col(key).alias("key"), F.col("n").alias("observations"), F.explode(told).alias("t")).filter(
        F.col("t.kept") & (F.abs("t.coefficient") >= floor)).select("key", "t.driver", "t.coefficient", "observations")


def rank_drivers(coefficients: DataFrame, rejected: DataFrame | None = None,
                 top: int = 6) -> DataFrame:
    """Drivers that moved with the metric. A hypothesis, never a stated cause."""
    if rejected is not None:
        coefficients = coefficients.join(rejected, "driver", "left_anti")
    rank = F.row_number().over(
        Window.partitionBy("key").orderBy(F.abs("coefficient").desc(), "driver"))
    return coefficients.withColumn("rank", rank).filter(F.col("rank") <= top).select(
        "key", "rank", F.lit("associational").alias("track"), "driver", "coefficient",
        "observations", F.lit("hypothesis").alias("state"))


def waterfall(movements: DataFrame, per_cause: DataFrame) -> DataFrame:
    """Steps from the base to the current level, scaled where causes overlap.

    Findings whose steps do not add back to the current level are left out.
    """
    causes = per_cause.filter("contribution <> 0").join(movements, "finding_id")
    gross = F.sum("contribution").over(Window.partitionBy("finding_id"))
    over = F.col("gross") / F.nullif(F.col("total_change"), F.lit(0.0))
    scaled = (
        causes.withColumn("gross", gross)
        .withColumn("scale", F.when((F.col("gross") != 0) & (over > 1.0),
                                    F.col("total_change") / F.col("gross")).otherwise(1.0))
        .select("finding_id", F.lit("cause").alias("kind"), F.col("candidate_id").alias("step"),
                F.round(F.col("contribution") * F.col("scale"), 2).alias("value"),
                F.round("contribution", 2).alias("measured"))
    )
    summed = scaled.groupBy("finding_id").agg(F.sum("value").alias("told"))
    rest = movements.join(summed, "finding_id", "left").select(
        "finding_id", F.lit("rest").alias("kind"), F.lit("not explained").alias("step"),
        F.round(F.col("total_change") - F.coalesce("told", F.lit(0.0)), 2).alias("value"),
        F.lit(None).cast("double").alias("measured")).filter(F.abs("value") >= 1.0)
    steps = scaled.unionByName(rest)
    adds_up = (
        steps.groupBy("finding_id").agg(F.sum("value").alias("walk"))
        .join(movements, "finding_id")
        .filter(F.abs(F.round(F.col("base_revenue") + F.col("walk"), 2)
                      - F.round("current_revenue", 2)) <= 0.05)
    )
    return steps.join(adds_up, "finding_id", "left_semi")
