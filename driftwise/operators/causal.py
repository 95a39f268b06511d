"""Causal tests of every candidate at once.

Revenue per day is laid out only for the slices that candidates name, and summed from the
first day on, once per slice and region. A window is then the difference of two such sums, so
fifteen windows cost thirty look-ups per region however long they are. Candidates of the same
slice, days and exposure are one test: the calendar bounds the tests, not the notes, and
everything after that is arithmetic on one row per test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwise.config import (
    BASELINE_DAYS,
    CONSISTENCY_FLOOR,
    EFFECT_FLOOR,
    ISOLATION_SHARE,
    PLACEBO_MARGIN,
    PLACEBO_MIN,
    PLACEBO_STEP_DAYS,
    PLACEBO_WINDOWS,
)
from driftwise.operators.candidates import SCOPE, alike

KEY = ("finding_id", "doc_id")


def scoped_panel(panel: DataFrame) -> DataFrame:
    """Daily revenue per region for every combination of scope dimensions.

    ``layout`` is a bit per dimension kept. The panel is already one row per day
    and slice, so this multiplies an aggregate, never the facts. It is dealt by day and region
    before, which every layout keeps, so the rows it makes are summed where they arise.
    """
    parts = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    layouts = F.explode(F.sequence(F.lit(0), F.lit(2 ** len(SCOPE) - 1)))
    laid = panel.repartition(parts, "d", "region").withColumn("layout", layouts)
    kept = [F.when(F.col("layout").bitwiseAND(1 << i) > 0, F.col(dim)).alias(dim)
            for i, dim in enumerate(SCOPE)]
    return laid.select("layout", "d", "region", "revenue", *kept) \
        .groupBy("layout", "d", "region", *SCOPE).agg(F.sum("revenue").alias("revenue"))


def layout_of() -> Column:
    return sum((F.when(F.col(dim).isNotNull(), 1 << i).otherwise(0) for i, dim in enumerate(SCOPE)),
               F.lit(0))


def scope_of() -> Column:
    """A slice's name: which dimensions it fixes, and to what."""
    return F.concat_ws("\u0001", layout_of().cast("string"), *[F.coalesce(F.col(dim), F.lit("")) for dim in SCOPE])


def scope_days(scopes: DataFrame, facts: DataFrame) -> DataFrame:
    """(scope, region, d, revenue) of the slices (scope, layout and dimensions) that are named.

    A dimension that the facts lack holds no value, so a slice that fixes it has no day.
    """
    absent = {dim: F.lit(None).cast("string") for dim in SCOPE if dim not in facts.columns}
    used = scopes.select("layout").distinct()  # one row per combination of dimensions at most
    laid = facts.withColumns(absent).crossJoin(F.broadcast(used)).select(
        "layout", "d", "region", F.col("revenue").cast("decimal(28,6)").alias("revenue"),
        *[F.when(F.col("layout").bitwiseAND(1 << i) > 0, F.col(dim)).alias(dim) for i, dim in enumerate(SCOPE)])
    match = laid["layout"] == scopes["layout"]
    for dim in SCOPE:
        match = match & laid[dim].eqNullSafe(scopes[dim])
    return laid.join(scopes, match).groupBy("scope", laid["region"], laid["d"]).agg(F.sum("revenue").alias("revenue"))


def window_sums(asked: DataFrame, facts: DataFrame, spans: dict[str, tuple[Column, Column]], by: Sequence[str],
                *carried: str) -> DataFrame:
    """Per key and region, the exact revenue and the days seen of each window (first, last day) of a slice.

    The windows follow from the columns ``by``, and are summed once for each slice and value of these.
    Days and the ends of windows run through one sorted pass per slice and region, which the
    calendar bounds: equal ends of many candidates are one row there.
    """
    named = asked.withColumns({"scope": scope_of(), "layout": layout_of().cast("int")})
    days = scope_days(named.select("scope", "layout", *SCOPE).distinct(), facts)
    ends = F.array(*[F.struct(F.lit(name).alias("window"), F.lit(sign).alias("sign"), day.alias("d"))
                     for name, (lo, hi) in spans.items() for sign, day in ((1, hi), (-1, F.date_sub(lo, 1)))])
    probes = named.select("scope", *by).distinct().select("scope", *by, F.explode(ends).alias("p")).select(
        "scope", *by, "p.window", "p.sign", "p.d")
    places = probes.select("scope", "d").distinct().join(days.select("scope", "region").distinct(), "scope")
    upto = Window.partitionBy("scope", "region").orderBy("d", "probe").rowsBetween(Window.unboundedPreceding, 0)
    running = (
        days.select("scope", "region", "d", "revenue", F.lit(1).alias("seen"), F.lit(0).alias("probe"))
        .unionByName(places.select("scope", "region", "d", F.lit(0).cast("decimal(38,6)").alias("revenue"), F.lit(0).alias("seen"),
                                   F.lit(1).alias("probe")))
        .withColumns({"total": F.sum("revenue").over(upto), "days": F.sum("seen").over(upto)})
        .filter("probe = 1").select("scope", "region", "d", "total", "days")
    )
    sums, folded = [], []
    for name in spans:
        inside = F.col("window") == name
        sums += [F.sum(F.when(inside, F.col("sign") * F.col("total"))).alias(f"{name}_sum"),
                 F.sum(F.when(inside, F.col("sign") * F.col("days"))).alias(f"{name}_n")]
        folded += [F.sum(f"{name}_sum").cast("double").alias(f"{name}_sum"), F.sum(f"{name}_n").alias(f"{name}_n")]
    told = probes.join(running, ["scope", "d"]).groupBy("scope", *by, "region").agg(*sums)
    return named.select(*KEY, *carried, "scope", *by).join(told, ["scope", *by]) \
        .groupBy(*KEY, *carried, "region").agg(*folded)


def windows(baseline: int = BASELINE_DAYS) -> dict[str, tuple[Column, Column]]:
    """First and last day of each window a candidate is tested on."""
    start, end = F.col("start"), F.col("end")
    length = F.greatest(F.datediff(end, start), F.lit(1))
    spans = {
        "during": (start, end),
        "before": (F.date_sub(start, baseline), F.date_sub(start, 1)),
        "earlier": (F.date_sub(start, baseline * 2), F.date_sub(start, baseline + 1)),
    }
    for k in range(1, PLACEBO_WINDOWS + 1):
        close = F.date_sub(start, baseline + 1 + k * PLACEBO_STEP_DAYS)
        opened = F.date_sub(close, length)
        spans[f"quiet_{k}"] = (opened, close)
        spans[f"prior_{k}"] = (F.date_sub(opened, baseline), F.date_sub(opened, 1))
    return spans


def region_sums(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """Revenue and days seen per candidate, region and window."""
    sums = window_sums(candidates, facts, windows(), ("start", "end"), "exposed")
    return sums.withColumn("treated", F.array_contains("exposed", F.col("region"))).drop("exposed")


def change(during: Column, before: Column) -> Column:
    """Proportional change; null when either side has no data or the base is 0."""
    return during / F.nullif(before, F.lit(0.0)) - 1.0


FOUND = ("effect", "control_change", "did", "pre_trend", "usable_regions", "responding", "placebo_max", "placebo_count")


def effects(candidates: DataFrame, sums: DataFrame) -> DataFrame:
    """Treated and control changes, pre-trend, placebos and responding regions.

    A cause present in every region has no control rows, so its control change
    is null and every test that needs a comparison group stays unavailable.
    """
    spans = windows()
    days_of = {name: F.datediff(hi, lo) + 1 for name, (lo, hi) in spans.items()}
    folded = []
    for name in spans:
        for side, flag in (("t", F.col("treated")), ("c", ~F.col("treated"))):
            folded += [F.sum(F.when(flag, F.col(f"{name}_sum"))).alias(f"{side}_{name}_sum"),
                       F.sum(F.when(flag, F.col(f"{name}_n"))).alias(f"{side}_{name}_n")]
    per_region = F.collect_list(F.when(F.col("treated"), F.struct(
        "during_sum", "before_sum", "during_n", "before_n"))).alias("exposed_sums")
    flat = candidates.join(sums.groupBy(*KEY).agg(*folded, per_region), list(KEY), "left")

    def mean(side: str, name: str) -> Column:
        return F.when(F.col(f"{side}_{name}_n") > 0,
                      F.col(f"{side}_{name}_sum") / F.greatest(days_of[name], F.lit(1)))

    quiet = F.array(*[
        change(mean("t", f"quiet_{k}"), mean("t", f"prior_{k}"))
        - change(mean("c", f"quiet_{k}"), mean("c", f"prior_{k}"))
        for k in range(1, PLACEBO_WINDOWS + 1)])
    treated = change(mean("t", "during"), mean("t", "before"))
    control = change(mean("c", "during"), mean("c", "before"))
    length = F.greatest(days_of["during"], F.lit(1))
    moves = F.transform("exposed_sums", lambda r: F.when(
        (r["during_n"] > 0) & (r["before_n"] > 0),
        change(r["during_sum"] / length, r["before_sum"] / BASELINE_DAYS)))
    usable = F.filter(moves, lambda m: m.isNotNull())
    sign = F.when(F.col("effect") < 0, -1.0).otherwise(1.0)
    return (
        flat.withColumn("effect", treated)
        .withColumn("control_change", control)
        .withColumn("did", F.col("effect") - F.col("control_change"))
        .withColumn("pre_trend", change(mean("t", "before"), mean("t", "earlier")))
        .withColumn("placebos", F.filter(quiet, lambda p: p.isNotNull()))
        .withColumn("usable_regions", F.coalesce(F.size(usable), F.lit(0)))
        .withColumn("responding", F.coalesce(
            F.size(F.filter(usable, lambda m: m * sign >= EFFECT_FLOOR)), F.lit(0)))
        .withColumn("placebo_max", F.array_max(F.transform("placebos", F.abs)))
        .withColumn("placebo_count", F.size("placebos"))
        .select(*candidates.columns, *FOUND)
    )


def passed(test: Column) -> Column:
    return F.when(test, "pass").otherwise("fail")


def outcomes(effects_: DataFrame) -> DataFrame:
    """pass, fail or unavailable for each test. ``movement`` may be null."""
    off = F.lit("unavailable")
    measured = F.col("effect").isNotNull()
    falling = (F.col("pre_trend") < 0) & (
        F.abs("pre_trend") > F.abs("effect") * ISOLATION_SHARE)
    did = F.col("did").isNotNull()
    wrong_way = F.col("movement").isNotNull() & (F.col("did") * F.col("movement") < 0)
    steady = (F.col("responding") / F.nullif(F.col("usable_regions"), F.lit(0)) >= CONSISTENCY_FLOOR) \
        & (F.col("responding") >= 2)
    return (
        effects_
        .withColumn("isolation", F.when(~measured | F.col("pre_trend").isNull(), off)
                    .otherwise(passed(~falling)))
        .withColumn("difference", F.when(~measured | ~did, off)
                    .otherwise(passed(F.abs("did") >= EFFECT_FLOOR)))
        .withColumn("direction_test", F.when(measured & did & wrong_way, "fail").otherwise(off))
        .withColumn("consistency", F.when(~measured | (F.col("usable_regions") < 2), off)
                    .otherwise(passed(steady)))
        .withColumn("placebo", F.when(~measured | ~did | (F.col("placebo_count") < PLACEBO_MIN), off)
                    .otherwise(passed(F.abs("did") >= F.col("placebo_max") * PLACEBO_MARGIN)))
    )


TESTS = ("isolation", "difference", "direction_test", "consistency", "placebo")
MANDATORY = ("isolation", "difference", "placebo")


def verdicts(tested: DataFrame) -> DataFrame:
    """Any failure rejects; a mandatory test not run leaves it unverifiable."""
    failed = F.array_compact(F.array(*[F.when(F.col(t) == "fail", F.lit(t)) for t in TESTS]))
    missing = F.array_compact(F.array(*[F.when(F.col(t) != "pass", F.lit(t)) for t in MANDATORY]))
    state = (
        F.when(F.col("effect").isNull(), "cannot_verify")
        .when(F.size(failed) > 0, "rejected")
        .when(F.size(missing) > 0, "cannot_verify")
        .otherwise("verified")
    )
    reason = (
        F.when(F.col("effect").isNull(), "no data for the exposed slices")
        .when(F.size(failed) > 0, F.concat(F.lit("failed "), F.array_join(failed, ", ")))
        .when(F.size(missing) > 0, F.concat(F.lit("could not run "),
                                            F.array_join(F.array_sort(missing), ", ")))
        .otherwise("passed every test that could be run")
    )
    return tested.withColumn("state", state).withColumn("reason", reason)


def distinct_tests(candidates: DataFrame) -> DataFrame:
    """One row per test of each kind of candidate, under the kind as key."""
    return candidates.filter("_kind is not null").select(
        F.col("_kind").alias("finding_id"), F.lit("").alias("doc_id"), "_test", "_nth", *SCOPE, "start", "end", "exposed").distinct()


def verify(candidates: DataFrame, panel: DataFrame) -> DataFrame:
    """Candidates with every test outcome and their verdict; those of one kind are tested once."""
    named = alike(candidates, KEY, (*SCOPE, "start", "end", "exposed"))
    asked = distinct_tests(named)
    found = effects(asked, region_sums(asked, panel)).dropDuplicates(["finding_id", "_test"]).select(
        F.col("finding_id").alias("_kind"), "_test", *FOUND)
    told = named.join(found, ["_kind", "_test"], "left").na.fill(0, ["usable_regions", "responding", "placebo_count"])
    return verdicts(outcomes(told.select(*candidates.columns, *FOUND)))
