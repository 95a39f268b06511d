"""Metric series: the declared query of each contract, and its roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.config import Kpi
from driftwise.functions.columns import money, ratio
from driftwise.operators.lineage import PolicyError

EXACT = "qty * unit_price - discount"


def _day(column: str, grain: str):
    return F.date_trunc(grain, F.col(column))


def net_value(sales: DataFrame, dims: Sequence[str], grain: str = "day") -> DataFrame:
    return (
        sales.filter("status <> 'cancelled'")
        .groupBy(_day("order_ts", grain).alias("ts"), *dims)
        .agg(F.sum(money(EXACT)).cast("double").alias("value"))
    )


def order_count(sales: DataFrame, dims: Sequence[str], grain: str = "day") -> DataFrame:
    return (
        sales.filter("status <> 'cancelled'")
        .groupBy(_day("order_ts", grain).alias("ts"), *dims)
        .agg(F.count_distinct("order_id").alias("value"))
    )


def order_value(sales: DataFrame, dims: Sequence[str], numerator: str, denominator: str,
                grain: str = "day") -> DataFrame:
    """Net per order, with both parts carried so it can be rolled up."""
    return (
        sales.filter("status <> 'cancelled'")
        .groupBy(_day("order_ts", grain).alias("ts"), *dims)
        .agg(F.sum(money(EXACT)).cast("double").alias(numerator),
             F.count_distinct("order_id").cast("double").alias(denominator))
        .withColumn("value", ratio(F.col(numerator), F.col(denominator)))
    )


def conversion(sessions: DataFrame, orders: DataFrame, channels: Sequence[str],
               numerator: str, denominator: str) -> DataFrame:
    """Hourly orders over sessions; both sides are aggregated before the join."""
    dims = ["ts", "region", "device"]
    visits = (
        sessions.filter(F.col("channel").isin(*channels))
        .groupBy(_day("session_ts", "hour").alias("ts"), "region", "device")
        .agg(F.sum("sessions").alias("_visits"))
    )
    bought = (
        orders.filter(F.col("channel").isin(*channels) & (F.col("status") != "cancelled"))
        .groupBy(_day("order_ts", "hour").alias("ts"), "region", "device")
        .agg(F.count_distinct("order_id").alias("_bought"))
    )
    top = F.coalesce(F.col("_bought"), F.lit(0)).cast("double")
    return visits.join(bought, dims, "left").select(
        *dims,
        ratio(top, F.col("_visits").cast("double")).alias("value"),
        top.alias(numerator),
        F.col("_visits").cast("double").alias(denominator),
    )


def on_time(shipments: DataFrame, dims: Sequence[str], as_of: str,
            numerator: str, denominator: str) -> DataFrame:
    """Share delivered by the promise; open promises not yet due are left out."""
    kept = F.when(F.col("delivered_date") <= F.col("promised_date"), 1.0).otherwise(0.0)
    return (
        shipments
        .filter(F.col("delivered_date").isNotNull()
                | (F.col("promised_date") < F.lit(as_of).cast("timestamp_ntz")))
        .groupBy(_day("promised_date", "day").alias("ts"), *dims)
        .agg(F.avg(kept).alias("value"), F.sum(kept).alias(numerator),
             F.count(F.lit(1)).cast("double").alias(denominator))
    )


def roll_up(series: DataFrame, kpi: Kpi, keys: Sequence[str] = ("ts",)) -> DataFrame:
    """Collapse slices to one value per key as the contract says.

    A ratio is re-divided from its summed parts and carries its trial count;
    averaging slice rates would weigh an empty slice like a busy one.
    """
    if kpi.aggregation == "ratio_of_sums":
        missing = [c for c in (kpi.numerator, kpi.denominator) if c not in series.columns]
        if missing:
            raise PolicyError(f"{kpi.kpi_id}: cannot roll up a ratio without {missing}")
        top, bottom = F.sum(kpi.numerator), F.sum(kpi.denominator)
        return series.groupBy(*keys).agg(ratio(top, bottom).alias("value"), bottom.alias("n"))
    fold = F.avg("value") if kpi.aggregation == "mean" else F.sum("value")
    return series.groupBy(*keys).agg(fold.alias("value"))


def region_series(order_totals: DataFrame, grain: str = "day") -> DataFrame:
    """Net, orders and order value per region, from one pass over order totals.

    Orders are already one row each, so counting them needs no distinct, and the
    three metrics share one aggregation instead of three scans.
    """
    folded = (
        order_totals
        .groupBy("region", _day("order_ts", grain).alias("ts"))
        .agg(
            F.sum("net").cast("double").alias("net"),
            F.sum(F.when(~F.col("is_test"), F.col("net"))).cast("double").alias("live_net"),
            F.count(F.when(~F.col("is_test"), 1)).cast("double").alias("orders"),
        )
    )
    rows = F.explode(F.array(
        F.struct(F.lit("net_revenue").alias("kpi_id"), F.col("net").alias("value"),
                 F.lit(None).cast("double").alias("n")),
        F.struct(F.lit("orders").alias("kpi_id"), F.col("orders").alias("value"),
                 F.lit(None).cast("double").alias("n")),
        F.struct(F.lit("aov").alias("kpi_id"),
                 ratio(F.col("live_net"), F.col("orders")).alias("value"),
                 F.col("orders").alias("n")),
    ))
    return (
        folded.select("region", "ts", rows.alias("m"))
        .select("m.kpi_id", "region", "ts", "m.value", "m.n")
        .filter("value is not null")
    )


def bridge_facts(sales: DataFrame, key: str = "sku", dims: Sequence[str] = (),
                 since: str | None = None, until: str | None = None) -> DataFrame:
    """Exact units and revenue per day, product and slice, in a half-open window."""
    frame = sales.filter("status <> 'cancelled'")
    if since is not None:
        frame = frame.filter(F.col("order_ts") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        frame = frame.filter(
            F.col("order_ts") < F.lit(until).cast("timestamp_ntz") + F.expr("interval 1 day"))
    return (
        frame.groupBy(F.to_date("order_ts").alias("d"), key, *dims)
        .agg(F.sum(F.expr("cast(qty as decimal(18,6))")).cast("double").alias("units"),
             F.sum(money(EXACT)).cast("double").alias("revenue"))
    )


def price_path(facts: DataFrame, plan: DataFrame, levels: Sequence[str], index: str) -> DataFrame:
    """Daily drivers per region: realised price, and the plan held until replaced.

    Plan rows and metric days are laid on one axis and the last plan value is
    carried forward within its region, so nothing mid-week is invented.
    """
    from pyspark.sql import Window

    daily = facts.groupBy("region", "d").agg(
        ratio(F.sum("revenue"), F.sum("units")).alias("realised_price"))
    weekly = plan.groupBy("region", F.col("week").alias("d")).agg(
        *[F.sum(c).alias(c) for c in levels], F.avg(index).alias(index))
    both = daily.withColumn("_day", F.lit(1)).unionByName(weekly, allowMissingColumns=True)
    held = Window.partitionBy("region").orderBy("d", F.col("_day").asc_nulls_first()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    carried = [F.last(c, ignorenulls=True).over(held).alias(c) for c in (*levels, index)]
    return both.select("region", "d", "realised_price", "_day", *carried) \
        .filter("_day = 1").drop("_day")


def reproduced(first: DataFrame, second: DataFrame, keys: Sequence[str],
               tolerance: float) -> DataFrame:
    """Two routes to one metric compared row by row."""
    a = first.select(*keys, F.col("value").alias("a"))
    b = second.select(*keys, F.col("value").alias("b"))
    gap = F.abs(F.col("a") - F.col("b"))
    return a.join(b, list(keys), "full").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"),
        F.count_if(gap > tolerance).alias("differing"),
    )


def invoices(frame: DataFrame, invoice: str) -> DataFrame:
    """Shape an invoice book whose only status mark is a leading C."""
    return frame.withColumn("status", F.when(F.col(invoice).startswith("C"), "cancelled")
                            .otherwise("complete")).withColumn("discount", F.lit(0.0))
