"""What to do about a verified cause, who does it, and what it should bring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwise.config import RECOVERY_SHARE, Kpi
from driftwise.functions.text import longest_term

@dataclass(frozen=True)
class Playbook:
    """What one industry's records point to, and what undoing a cause recovers."""

    kind_to_driver: dict[str, str]
    note_to_driver: tuple[tuple[str, tuple[str, ...]], ...]
    recovery: dict[str, float]
    external_kinds: tuple[str, ...]
    reversal_driver: str
    reversal_lever: str
    reversal_kind: str = "release_log"


# Which driver a record's kind, or its wording, points to, and the
# share of a loss each lever recovers.
KIND_TO_DRIVER = {"release_log": "release_quality", "promotion": "competitor_price_index"}
NOTE_TO_DRIVER = (
    ("stock_position", ("stockout", "out of stock", "shortfall", "supplier", "inventory")),
    ("unit_price", ("price", "pricing", "discount")),
    ("marketing_spend", ("marketing", "campaign", "spend", "media")),
    ("severe_weather", ("weather", "rainfall", "storm", "flood", "monsoon")),
)
RETAIL_PLAYBOOK = Playbook(
    KIND_TO_DRIVER, NOTE_TO_DRIVER, RECOVERY_SHARE, ("ops_note", "promotion"),
    "release_quality", "release_rollback")
PETROLEUM_PLAYBOOK = Playbook(
    {"release_log": "refinery_availability", "turnaround": "refinery_availability"},
    (
        ("pipeline_integrity", ("pipeline", "pumping", "leak", "integrity", "sectionalis")),
        ("refinery_availability", ("turnaround", "shutdown", "unit trip", "refinery", "maintenance")),
        ("excise_duty", ("duty", "excise", "levy", "price revision", "rate revision")),
        ("port_closure", ("cyclone", "storm", "berth", "port closed", "flood", "weather")),
        ("carrier_capacity", ("tanker", "transporter", "haulage", "fleet", "carrier", "rake")),
        ("crude_benchmark", ("crude", "benchmark", "brent", "parity")),
    ),
    {"alternate_sourcing": 0.45, "mode_switch": 0.60, "fleet_augmentation": 0.70,
     "pricing_revision": 0.25, "allocation_mix": 0.40},
    ("ops_note", "turnaround"), "refinery_availability", "alternate_sourcing")
POWER_PLAYBOOK = Playbook(
    {"release_log": "plant_availability", "outage": "plant_availability"},
    (
        ("fuel_supply", ("coal", "rake", "linkage", "fuel", "gas supply")),
        ("grid_constraint", ("constraint", "backing down", "curtail", "evacuation", "line outage")),
        ("tariff_order", ("tariff", "true-up", "regulatory order", "surcharge")),
        ("plant_availability", ("trip", "boiler", "off bar", "forced outage", "overhaul")),
        ("weather_load", ("monsoon", "cyclone", "heat wave", "wind speed", "irradiance", "weather")),
        ("demand_shift", ("demand", "load curve", "peak deficit")),
    ),
    {"outage_rescheduling": 0.75, "fuel_sourcing": 0.55, "corridor_booking": 0.60,
     "despatch_mix": 0.45, "regulatory_filing": 0.10},
    ("ops_note", "outage"), "plant_availability", "outage_rescheduling")


def driver_of(kind: Column, description: Column, playbook: Playbook = RETAIL_PLAYBOOK) -> Column:
    """The driver a cause belongs to: by kind, else an ops note's first wording."""
    by_kind = [F.when(kind == k, F.lit(d)) for k, d in playbook.kind_to_driver.items()]
    by_note = [F.when((kind == "ops_note") & longest_term(description, dict.fromkeys(words, d)).isNotNull(),
                      F.lit(d)) for d, words in playbook.note_to_driver]
    return F.coalesce(*by_kind, *by_note)


def lookup(column: Column, table: dict[str, str | float]) -> Column:
    """A short fixed table as a map; a missing key gives null."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), column)


def decision_cards(sized: DataFrame, kpi: Kpi, playbook: Playbook = RETAIL_PLAYBOOK) -> DataFrame:
    """One card per verified cause: its lever, owner, loss and expected recovery.

    A lever with no declared share leaves recovery empty rather than guessed; a
    driver with no lever can only be watched.
    """
    levers = {d.driver_id: d.lever for d in kpi.drivers if d.lever}
    owners = {d.driver_id: d.owner for d in kpi.drivers if d.owner}
    known = [d.driver_id for d in kpi.drivers]
    driver = driver_of(F.col("kind"), F.col("description"), playbook)
    loss = F.abs("contribution")
    place = Window.partitionBy("finding_id").orderBy(F.desc("loss"), "doc_id")
    return (
        sized.withColumn("driver", F.when(driver.isin(*known), driver))
        .withColumn("lever", lookup(F.col("driver"), levers))
        .withColumn("controllable", F.col("lever").isNotNull())
        .withColumn("owner", F.when(F.col("controllable"), lookup(F.col("driver"), owners)))
        .withColumn("loss", loss)
        .withColumn("recovery", F.col("loss") * lookup(F.col("lever"), playbook.recovery))
        .withColumn("scope", F.coalesce("channel", "device", "category", "sku",
                                        F.nullif(F.array_join("exposed", ", "), F.lit("")),
                                        F.lit("the affected slice")))
        .withColumn("action", F.when(F.col("controllable"), F.concat(
            F.lit("apply "), F.replace("lever", F.lit("_"), F.lit(" ")), F.lit(" for "), F.col("scope")))
            .otherwise("monitor only"))
        .withColumn("caveat", F.when(F.col("driver").isNull(), "no contract driver matches this cause")
                    .when(~F.col("controllable"), "observable but not controllable")
                    .when(F.col("recovery").isNull(), "no recovery share is declared for this lever"))
        .withColumn("rank", F.row_number().over(place))
    )


def price_grid(movements: DataFrame, deltas: Sequence[float], elasticity: float | None,
               margin: float | None) -> DataFrame:
    """What each price change on the grid would do to each finding's revenue."""
    laid = movements.withColumn("delta", F.explode(F.array(*[F.lit(float(d)) for d in deltas])))
    nothing = F.lit(None).cast("double")
    if elasticity is None:
        return laid.withColumn("revenue_change", nothing).withColumn("profit_change", nothing) \
            .withColumn("unavailable", F.lit("no price elasticity is declared"))
    volume = 1 + F.lit(elasticity) * F.col("delta")
    revenue = F.col("current_revenue") * ((1 + F.col("delta")) * volume - 1)
    profit = nothing if margin is None else (
        F.col("current_revenue") * volume * (1 + F.col("delta") - (1 - margin))
        - F.col("current_revenue") * margin)
    below = F.lit(False) if margin is None else (1 + F.col("delta") < 1 - margin)
    return laid.withColumn("revenue_change", revenue).withColumn("profit_change", profit) \
        .withColumn("below_cost", below).withColumn("unavailable", F.lit(None).cast("string"))


def projections(findings: DataFrame, sized: DataFrame, kpi: Kpi, horizon: int = 14,
                playbook: Playbook = RETAIL_PLAYBOOK) -> DataFrame:
    """Undoing the first shipped release, and outside pressure carried forward."""
    can_undo = any(d.driver_id == playbook.reversal_driver for d in kpi.drivers)
    share = playbook.recovery.get(playbook.reversal_lever)
    undone = sized.filter((F.col("kind") == playbook.reversal_kind) & F.lit(can_undo))
    outside = F.sum(F.when(F.col("kind").isin(*playbook.external_kinds), F.abs("contribution")))
    first = undone.groupBy("finding_id").agg(
        F.min_by(F.abs("contribution"), F.struct("start", "doc_id")).alias("reversal_loss"))
    pressed = sized.groupBy("finding_id").agg(outside.alias("outside"))
    return findings.select("finding_id").join(first, "finding_id", "left") \
        .join(pressed, "finding_id", "left").select(
        "finding_id",
        (F.col("reversal_loss") * F.lit(share)).alias("reversal_per_day"),
        (-F.col("outside")).alias("sustained_per_day"),
        (-F.col("outside") * horizon).alias("sustained_total"))


def fair_target(diagnoses: DataFrame, cards: DataFrame, gaps: DataFrame) -> DataFrame:
    """How much of an explained movement the team should be judged on.

    Causes with no lever are excused unless a warning of their kind came in
    time; pieces are scaled back so that together they never exceed the movement.
    """
    gross = F.sum(F.abs("contribution")).over(Window.partitionBy("finding_id"))
    scale = F.when(F.col("gross") != 0, F.least(F.lit(1.0), F.abs("total_change") / F.col("gross"))) \
        .otherwise(1.0)
    pieces = (
        cards.withColumn("gross", gross)
        .join(diagnoses.filter("verdict = 'explained'").select("finding_id", "total_change"), "finding_id")
        .join(gaps.select("finding_id", F.col("verdict").alias("gap"), "feed"), "finding_id", "left")
        .withColumn("amount", F.round(F.col("contribution") * scale, 2))
        .withColumn("warned", (F.col("gap") == "gap_found") & F.col("driver").eqNullSafe(F.col("feed")))
    )
    free = ~F.col("controllable")
    return pieces.groupBy("finding_id").agg(
        F.round(F.first("total_change"), 2).alias("net"),
        F.count_if(free).alias("factors"),
        F.round(F.first("total_change") - F.coalesce(
            F.sum(F.when(free & ~F.col("warned"), F.col("amount"))), F.lit(0.0)), 2).alias("policy"),
        F.round(F.first("total_change") - F.coalesce(
            F.sum(F.when(free, F.col("amount"))), F.lit(0.0)), 2).alias("all_excused"))


def outlook(cards: DataFrame, explained: DataFrame) -> DataFrame:
    """Recoverable against merely watchable loss, scaled where causes overlap."""
    scale = 1.0 / F.greatest(F.first("overlap"), F.lit(1.0))
    return cards.join(explained.select("finding_id", "overlap"), "finding_id").groupBy("finding_id").agg(
        F.round(F.sum(F.when(F.col("controllable"), F.coalesce("recovery", F.lit(0.0))).otherwise(0.0))
                * scale, 2).alias("recoverable"),
        F.round(F.sum(F.when(~F.col("controllable"), F.col("loss")).otherwise(0.0)) * scale, 2)
        .alias("not_actionable"),
        (F.first("overlap") > 1.0).alias("adjusted"))


# The line that explains and reviews a regional movement.
LADDER = {"explains": "zonal_sales_manager", "reviews": "national_sales_manager"}


def accountability(diagnoses: DataFrame, cards: DataFrame, kpi: Kpi) -> DataFrame:
    """Who explains, reviews, acts on and signs each finding."""
    acts = cards.filter("controllable").groupBy("finding_id").agg(
        F.array_join(F.array_sort(F.collect_set("owner")), ",").alias("acts"))
    regional = F.col("region").isNotNull()
    why = F.when(F.col("acts").isNotNull(), F.lit(None)).when(
        F.col("verdict") == "contradicted", "the two systems disagree, so the extract is checked first") \
        .otherwise("no verified cause has a lever; the response is to monitor")
    return diagnoses.join(acts, "finding_id", "left").select(
        "finding_id",
        F.when(regional, LADDER["explains"]).otherwise(LADDER["reviews"]).alias("explains"),
        F.when(regional, LADDER["reviews"]).alias("reviews"),
        "acts", F.lit(kpi.owner).alias("signs"), why.alias("no_action"))
