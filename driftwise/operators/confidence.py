"""How much of a movement is explained, how sure that is, and when to abstain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwise.config import (
    ABSTAIN_BELOW,
    BASELINE_DAYS,
    CONFIDENCE_WEIGHTS,
    CORROBORATION_SATURATION,
    HIGH_ABOVE,
    MIN_COVERAGE,
    STRENGTH_SATURATION,
)
from driftwise.functions.columns import ratio
from driftwise.operators.causal import KEY, window_sums


def contributions_of(verified: DataFrame, panel: DataFrame) -> DataFrame:
    """Money each verified cause accounts for: its slice's usual day times its effect.

    A cause recorded for no region is sized over all of them.
    """
    usual = {"usual": (F.date_sub("finding_start", BASELINE_DAYS), F.date_sub("finding_start", 1))}
    sums = window_sums(verified, panel, usual, ("finding_start",), "exposed")
    held = (F.size("exposed") == 0) | F.array_contains("exposed", F.col("region"))
    base = sums.filter(held & (F.col("usual_n") > 0)).groupBy(*KEY).agg(
        (F.sum("usual_sum") / BASELINE_DAYS).alias("slice_base"))
    return verified.join(base, list(KEY), "left").withColumn(
        "contribution", F.coalesce("slice_base", F.lit(0.0)) * F.col("effect"))


def explained(movements: DataFrame, sized: DataFrame) -> DataFrame:
    """Total explained per finding, capped at the movement, and how far causes overlap."""
    total = sized.groupBy("finding_id").agg(
        F.sum("contribution").alias("gross"), F.count(F.lit(1)).alias("causes"))
    gross = F.coalesce("gross", F.lit(0.0))
    over = F.when((F.col("total_change") != 0) & (gross != 0),
                  F.greatest(F.abs(gross) / F.abs("total_change"), F.lit(1.0))).otherwise(1.0)
    return (
        movements.join(total, "finding_id", "left")
        .withColumn("causes", F.coalesce("causes", F.lit(0)))
        .withColumn("overlap", over)
        .withColumn("explained", F.when(F.col("overlap") > 1.0, F.col("total_change")).otherwise(gross))
        .drop("gross")
    )


def strongest(sized: DataFrame) -> DataFrame:
    """Largest verified effect over the largest movement seen on quiet days."""
    times = F.when((F.col("placebo_max") != 0) & (F.col("effect") != 0),
                   F.abs("effect") / F.abs("placebo_max"))
    return sized.groupBy("finding_id").agg(F.max(times).alias("times_quiet"))


def contradictions(sized: DataFrame) -> DataFrame:
    """Regions in which verified causes of one finding move opposite ways.

    One pass per region finds both signs; causes are never paired off.
    """
    region = sized.filter("effect <> 0").select(
        "finding_id", "candidate_id", "effect", F.explode("exposed").alias("region"))
    both = region.groupBy("finding_id", "region").agg(
        F.min("effect").alias("low"), F.max("effect").alias("high")).filter("low < 0 and high > 0")
    return both.groupBy("finding_id").agg(
        F.array_join(F.array_sort(F.collect_set("region")), ",").alias("contested"))


def scored(explained_: DataFrame, strength: DataFrame, support: DataFrame, freshness: Column,
           stale: Column, contested: DataFrame) -> DataFrame:
    """Score, band and the reasons for abstaining, per finding.

    The thresholds read the share before the overlap discount, so a discount
    lowers the score without turning a covered movement into an uncovered one.
    """
    share = F.when(F.col("total_change") == 0, 0.0).otherwise(
        F.least(F.abs(F.col("explained") / F.nullif(F.col("total_change"), F.lit(0.0))), F.lit(1.0)))
    weights = CONFIDENCE_WEIGHTS
    frame = (
        explained_.join(strength, "finding_id", "left").join(support, "finding_id", "left")
        .join(contested, "finding_id", "left")
        .withColumn("supporting", F.coalesce("supporting", F.lit(0)))
        .withColumn("raw_share", share)
        .withColumn("coverage", F.col("raw_share") / F.col("overlap"))
        .withColumn("causal_strength", F.least(
            F.coalesce("times_quiet", F.lit(0.0)) / STRENGTH_SATURATION, F.lit(1.0)))
        .withColumn("corroboration", F.least(
            F.col("supporting") / CORROBORATION_SATURATION, F.lit(1.0)))
        .withColumn("freshness", freshness)
        .withColumn("score", sum((F.col(name) * weight for name, weight in weights.items()), F.lit(0.0)))
    )
    reasons = F.array_compact(F.array(
        F.when(F.col("causes") == 0, "no candidate survived testing"),
        F.when(F.col("raw_share") < MIN_COVERAGE, "verified causes cover too little of the movement"),
        F.when(F.col("contested").isNotNull(),
               F.concat(F.lit("verified causes disagree in "), F.col("contested"))),
        F.when(stale != "", F.concat(stale, F.lit(" is stale beyond its SLA"))),
        F.when(F.col("score") < ABSTAIN_BELOW, "the combined score is below the reporting threshold")))
    return frame.withColumn("reasons", reasons).withColumn(
        "band", F.when(F.size("reasons") > 0, "unknown")
        .when(F.col("score") >= HIGH_ABOVE, "high").otherwise("moderate")) \
        .withColumn("caveat", F.when(F.col("overlap") > 1.0, "the verified causes overlap"))


def abstentions(diagnoses: DataFrame, verdicts: DataFrame, slices: DataFrame) -> DataFrame:
    """What was ruled out and the one next check, for findings left unknown."""
    out = verdicts.filter("state in ('rejected', 'cannot_verify')")
    first = F.min(F.when(F.col("state") == "cannot_verify", F.struct("start", "doc_id", "candidate_id")))
    ruled = out.groupBy("finding_id").agg(
        F.count(F.lit(1)).alias("ruled_out"), first["candidate_id"].alias("untestable"))
    top = slices.filter("rank = 1").select("finding_id", "dimension", "slice")
    check = (
        F.when(F.col("untestable").isNotNull(),
               F.concat(F.lit("establish a comparison group for "), F.col("untestable"),
                        F.lit(", or extend history until one exists")))
        .when(F.col("coverage") < MIN_COVERAGE,
              F.concat(F.lit("break the movement down further, starting with "), F.col("dimension"),
                       F.lit(" "), F.col("slice")))
        .otherwise("widen the search window and re-run")
    )
    question = F.when(F.col("untestable").isNotNull(),
                      F.concat(F.lit("was "), F.col("untestable"),
                               F.lit(" limited to a particular region, channel or category?"))) \
        .when(F.col("coverage") < MIN_COVERAGE,
              F.lit("is there an event in this window that was not written down anywhere?"))
    return (
        diagnoses.filter("band = 'unknown'").join(ruled, "finding_id", "left")
        .join(top, "finding_id", "left")
        .select("finding_id", F.coalesce("ruled_out", F.lit(0)).alias("ruled_out"),
                check.alias("next_check"), question.alias("question"))
    )


# --- calibration and evaluation -------------------------------------------------------
MIN_OUTCOMES = 40


def brier(outcomes: DataFrame) -> DataFrame:
    correct = F.when(F.col("correct"), 1.0).otherwise(0.0)
    return outcomes.agg(F.count(F.lit(1)).alias("n"),
                        F.avg(F.pow(F.col("confidence") - correct, 2)).alias("brier"))


def calibration_bins(outcomes: DataFrame, bins: int = 5) -> DataFrame:
    """Equal bins of score with their accuracy; the last one is closed at 1."""
    correct = F.when(F.col("correct"), 1.0).otherwise(0.0)
    bin_ = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return outcomes.groupBy(bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_score"),
        F.avg(correct).alias("accuracy"))


def calibration_error(outcomes: DataFrame, bins: int = 5) -> DataFrame:
    """Gap between score and accuracy, weighted by bin size."""
    gap = F.col("n") * F.abs(F.col("mean_score") - F.col("accuracy"))
    return calibration_bins(outcomes, bins).agg(
        F.round(F.sum(gap) / F.sum("n"), 4).alias("ece"), F.sum("n").alias("n"))


UNANSWERABLE = ("unknown", "cannot_verify")


def bench_metrics(outcomes: DataFrame) -> DataFrame:
    """Every headline rate of a benchmark run, in one pass.

    ``top1`` is null for cases without a planted cause, ``decoy_rejected`` for
    cases without a decoy.
    """
    caused, decoy = F.col("top1").isNotNull(), F.col("decoy_rejected").isNotNull()
    moved = F.col("verdict") != "no_movement"
    open_ = F.col("expected").isin(*UNANSWERABLE)
    unknown = F.col("verdict") == "unknown"
    quiet = F.col("expected") == "no_anomaly"

    def rate(hit: Column, among: Column, name: str) -> Column:
        hits = F.count_if(among & F.coalesce(hit, F.lit(False))).cast("double")
        return F.round(ratio(hits, F.count_if(among).cast("double")), 3).alias(name)

    rest = ~F.coalesce(F.col("topk"), F.lit(False))
    n = F.count(F.lit(1))
    held = outcomes.count()

    def at(share: float) -> Column:
        """The value at that place of the sorted times, without interpolation."""
        place = min(int(held * share), held - 1)
        return F.percentile("seconds", place / (held - 1) if held > 1 else 0.0)

    return outcomes.agg(
        n.alias("cases"),
        F.count_if(caused).alias("with_planted_cause"),
        F.count_if(F.col("verdict") == "explained").alias("reported_a_cause"),
        F.count_if(unknown).alias("abstained"),
        rate(F.col("top1"), caused, "top1_accuracy"),
        rate(F.col("top1"), caused & moved, "top1_when_material"),
        rate(F.col("topk"), caused, "topk_accuracy"),
        rate(F.col("verdict") == "explained", quiet, "false_alarm_rate"),
        rate(F.col("decoy_rejected"), decoy, "negative_control_rejection"),
        rate(open_ | rest, unknown, "abstention_precision"),
        rate(unknown, open_, "abstention_recall"),
        F.count_if(open_ & ~unknown).alias("missed_abstentions"),
        rate(F.col("detected"), caused, "detection_rate"),
        rate(F.col("material_detected"), caused, "material_detection_rate"),
        F.round(at(0.5), 3).alias("p50_seconds"),
        F.round(at(0.95), 3).alias("p95_seconds"),
        F.round(F.sum("seconds"), 1).alias("total_seconds"),
    )


def near_events(flagged: DataFrame, events: DataFrame, reach: int) -> DataFrame:
    """Flagged days within reach of a dated event, each with the nearest one."""
    around = events.select("event", "on", F.explode(F.sequence(
        F.date_sub("on", reach), F.date_add("on", reach))).alias("day"))
    away = F.abs(F.datediff("day", "on"))
    return (
        flagged.join(around, "day")
        .groupBy("kpi_id", "region", "day")
        .agg(F.min_by("event", F.struct(away, F.col("on"), F.col("event"))).alias("event"),
             F.min(away).alias("days_away"))
    )
