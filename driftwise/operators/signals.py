"""Outside warnings: which covered a finding, and whether one was missed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwise.config import (
    ACTIONABLE_SEVERITY,
    MIN_LEAD_HOURS,
    PRECEDENT_BASELINE_DAYS,
    PRECEDENT_DROP,
    PRECEDENT_GAP_DAYS,
    PRECEDENT_LOOKBACK_DAYS,
    PRECEDENT_MIN_ROWS,
    SEVERITY_ORDER,
)
from driftwise.functions.columns import any_phrase, severity_rank

# Words that tie a cause to a kind of warning, in order.
CAUSE_TO_SIGNAL = (
    ("severe_weather", ("weather", "rainfall", "storm", "flood", "monsoon", "cyclone")),
    ("carrier_disruption", ("carrier", "courier", "logistics", "3pl")),
    ("competitor_action", ("competitor", "rival")),
    ("supply_disruption", ("supplier", "shortfall", "stockout", "out of stock")),
)
# Words that mark a cause as the business's own doing.
INTERNAL_MARKERS = (
    "release", "deploy", "rollout", "bug", "regression", "checkout flow", "pricing change",
    "list price", "discount", "campaign", "marketing",
)


def is_actionable() -> Column:
    return F.col("is_public") & F.col("severity").isin(*ACTIONABLE_SEVERITY) \
        & (F.col("lead_time_hours") >= MIN_LEAD_HOURS)


def overlapping(windows: DataFrame, signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Warnings whose validity overlaps each window in its region.

    A warning is valid for days, so it is spread to its days and met by equality
    on region and day. Each pair is kept on its first shared day only, which
    makes the result free of repeats without a distinct.
    """
    first = F.to_date("valid_from")
    valid = signals.withColumn("d", F.explode(F.sequence(first, F.to_date("valid_to"))))
    days = windows.select(*keys, "region", "start", F.explode(F.sequence("start", "end")).alias("d"))
    return days.join(valid, ["region", "d"]).filter(
        F.col("d") == F.greatest(F.col("start"), first)).drop("d", "start")


def feed_of(verified: DataFrame, findings: DataFrame) -> DataFrame:
    """Which kind of warning each finding's causes call for.

    no_cause where nothing was verified, internal where every cause is the
    business's own, else the first kind named by the first cause that names one.
    """
    text = F.lower("description")
    kind = F.coalesce(*[F.when(any_phrase(text, words), F.lit(k)) for k, words in CAUSE_TO_SIGNAL])
    told = verified.select("finding_id", "start", "doc_id", kind.alias("kind"),
                           any_phrase(text, INTERNAL_MARKERS).alias("internal"))
    folded = told.groupBy("finding_id").agg(
        F.every("internal").alias("all_internal"),
        F.min(F.when(F.col("kind").isNotNull(), F.struct("start", "doc_id", "kind")))["kind"].alias("kind"))
    feed = (
        F.when(F.col("all_internal").isNull(), "no_cause").when(F.col("all_internal"), "internal")
        .otherwise(F.coalesce("kind", F.lit("severe_weather")))
    )
    return findings.join(folded, "finding_id", "left").withColumn("feed", feed) \
        .drop("all_internal", "kind")


def warning_days(signals: DataFrame) -> DataFrame:
    """Serious public warnings folded to type, region and day, and numbered into
    episodes: days no more than five apart are one."""
    rank = severity_rank("severity", SEVERITY_ORDER)
    daily = (
        signals.filter(F.col("is_public") & F.col("severity").isin(*ACTIONABLE_SEVERITY))
        .groupBy("signal_type", "region", F.to_date("valid_from").alias("d"))
        .agg(F.count(F.lit(1)).alias("warnings"), F.max(rank).alias("rank"))
    )
    run = Window.partitionBy("signal_type", "region").orderBy("d")
    fresh = F.when(F.datediff("d", F.lag("d").over(run)) > PRECEDENT_GAP_DAYS, 1).otherwise(0)
    return daily.withColumn("_fresh", fresh).withColumn("episode", F.sum("_fresh").over(run)).drop("_fresh")


def precedents(findings: DataFrame, days: DataFrame) -> DataFrame:
    """Earlier episodes of each finding's kind of warning, over two years.

    Cutting an episode at the edge of the look-back leaves its days in one run,
    so episodes are found once for all findings and only clipped per finding.
    """
    known = days.withColumnRenamed("signal_type", "feed")
    floor = F.date_sub("start", PRECEDENT_LOOKBACK_DAYS)
    return (
        findings.select("finding_id", "region", "feed", "start").join(known, ["region", "feed"])
        .filter((F.col("d") >= floor) & (F.col("d") < F.col("start")))
        .groupBy("finding_id", "region", "feed", "episode")
        .agg(F.min("d").alias("from_day"), F.max("d").alias("to_day"),
             F.sum("warnings").alias("warnings"), F.max("rank").alias("rank"))
        .withColumn("max_severity", F.element_at(
            F.array(*[F.lit(s) for s in SEVERITY_ORDER]), (F.col("rank") + 1).cast("int")))
        .drop("rank")
    )


def hurt(episodes: DataFrame, history: DataFrame) -> DataFrame:
    """Whether the metric fell during each episode against the four weeks before.

    Null where the history is too thin to say.
    """
    spans = episodes.select("region", "from_day", "to_day").distinct()
    days = spans.withColumn("d", F.explode(F.sequence(
        F.date_sub("from_day", PRECEDENT_BASELINE_DAYS), F.col("to_day"))))
    before = F.col("d") < F.col("from_day")
    means = days.join(history, ["region", "d"]).groupBy("region", "from_day", "to_day").agg(
        F.avg(F.when(~before, F.col("value"))).alias("during"),
        F.avg(F.when(before, F.col("value"))).alias("base"),
        F.count(F.when(before, 1)).alias("rows"))
    judged = F.when(F.col("during").isNotNull() & (F.col("rows") >= PRECEDENT_MIN_ROWS)
                    & (F.col("base") != 0),
                    F.col("during") / F.nullif(F.col("base"), F.lit(0.0)) - 1.0 <= -PRECEDENT_DROP)
    return episodes.join(means, ["region", "from_day", "to_day"], "left") \
        .withColumn("hurt", judged).drop("during", "base", "rows")


def assess(fed: DataFrame, covering: DataFrame, judged: DataFrame, consumed: Sequence[str],
           documented: bool = True) -> DataFrame:
    """The verdict on each finding: was there a warning that nobody was reading?"""
    told = covering.groupBy("finding_id").agg(
        F.count(F.lit(1)).alias("signals"), F.count_if(is_actionable()).alias("actionable"),
        F.max(F.when(is_actionable(), F.col("lead_time_hours"))).alias("best_lead"))
    before = judged.groupBy("finding_id").agg(
        F.count(F.lit(1)).alias("recurrence"),
        F.count_if(F.coalesce("hurt", F.lit(False))).alias("recurrence_hurt"))
    verdict = (
        F.when(F.lit(not documented), "coverage_unknown")
        .when(F.col("feed") == "no_cause", "coverage_unknown")
        .when(F.col("feed") == "internal", "no_gap")
        .when(F.col("signals") == 0, "no_gap")
        .when(F.col("actionable") == 0, "not_foreseeable")
        .when(F.col("feed").isin(*consumed), "no_gap")
        .otherwise("gap_found")
    )
    frame = fed.join(told, "finding_id", "left").join(before, "finding_id", "left")
    for column in ("signals", "actionable", "recurrence", "recurrence_hurt"):
        frame = frame.withColumn(column, F.coalesce(column, F.lit(0)))
    return frame.withColumn("verdict", verdict)


def near_misses(covering: DataFrame) -> DataFrame:
    """For findings no warning could have served: the nearest miss per gate."""
    severe = F.col("severity").isin(*ACTIONABLE_SEVERITY) & F.col("is_public")
    timely = (F.col("lead_time_hours") >= MIN_LEAD_HOURS) & F.col("is_public")
    rank = severity_rank("severity", SEVERITY_ORDER)
    folded = covering.groupBy("finding_id").agg(
        F.count(F.lit(1)).alias("signals"), F.count_if(is_actionable()).alias("actionable"),
        F.count_if(~F.col("is_public")).alias("private"),
        F.max(F.when(severe, F.col("lead_time_hours"))).alias("severe_lead"),
        F.max(F.when(timely, rank)).alias("timely_rank"))
    why = (
        F.when(F.col("severe_lead").isNotNull() & F.col("timely_rank").isNotNull(),
               "none was both serious and early")
        .when(F.col("severe_lead").isNotNull(), "serious but late")
        .when(F.col("timely_rank").isNotNull(), "early but minor")
        .when(F.col("private") == F.col("signals"), "none was public")
        .otherwise("none was public, serious and early")
    )
    ladder = F.array(*[F.lit(s) for s in SEVERITY_ORDER])
    return folded.filter("actionable = 0").select(
        "finding_id", "signals", "severe_lead",
        F.when(F.col("timely_rank").isNotNull(),
               F.element_at(ladder, (F.col("timely_rank") + 1).cast("int"))).alias("timely_severity"),
        why.alias("why"))


def cause_signals(verified: DataFrame, signals: DataFrame, top: int = 4) -> DataFrame:
    """Warnings on each cause's own regions from its start to the finding's end."""
    windows = verified.select(
        "finding_id", "doc_id", "start", F.col("finding_end").alias("end"),
        F.explode("exposed").alias("region")).filter(F.col("start") <= F.col("end"))
    place = Window.partitionBy("finding_id", "doc_id").orderBy(F.desc("lead_time_hours"), "signal_id")
    return overlapping(windows, signals, ("finding_id", "doc_id")) \
        .withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)


def monitoring(assessed: DataFrame, owner: str) -> DataFrame:
    """The rule that would have caught each gap found."""
    return assessed.filter("verdict = 'gap_found'").select(
        "finding_id",
        F.concat(F.replace("feed", F.lit("_"), F.lit(" ")),
                 F.lit(" warnings covering the affected region")).alias("watch"),
        F.lit("severity amber or above with at least 24 hours of lead time").alias("threshold"),
        F.lit(owner).alias("route_to"),
        F.coalesce(F.col("best_lead") >= MIN_LEAD_HOURS, F.lit(False)).alias("would_have_fired"),
        F.col("recurrence").alias("prior_occurrences"))
