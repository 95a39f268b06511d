"""Jobs over source tables, metric series and detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwise import config
from driftwise.config import PETROLEUM, POWER, RETAIL, UK_RETAIL, Kpi
from driftwise.functions.columns import day_text, severity_rank
from driftwise.operators import detection, folding, lineage, metrics, seasons
from driftwise.plans.registry import job
from driftwise.sources.estate import LATE_CLOCK_REGION, Estate

DELIVERY_AS_OF = "2001-06-01"
ENTITLED = ("ASIA", "EUROPE")
MONEY = 4


def stamped(frame: DataFrame, *columns: str) -> DataFrame:
    """Times as text, so results compare across engines."""
    for column in columns:
        frame = frame.withColumn(column, F.date_format(column, "yyyy-MM-dd HH:mm:ss"))
    return frame


def rounded(frame: DataFrame, places: int, *columns: str) -> DataFrame:
    for column in columns:
        frame = frame.withColumn(column, F.round(column, places))
    return frame


# --- scans and lineage ---------------------------------------------------------
@job("scan_limit")
def scan_limit(e: Estate) -> DataFrame:
    """A whole table through the allow-listed reader; its ``limit`` is for callers who want a look."""
    return e.table("lineitem").groupBy(F.col("l_returnflag").alias("status")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.expr("cast(l_quantity as bigint)")).alias("units"),
        F.max("l_orderkey").alias("last_order"))


@job("docs_window")
def docs_window(e: Estate) -> DataFrame:
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in ("1996-06-01", "1997-06-01"))
    return stamped(e.documents().filter(F.col("ts").between(lo, hi))
                   .select("doc_id", "doc_type", "ts", "region", "n_chars"), "ts")


@job("dedupe")
def dedupe(e: Estate) -> DataFrame:
    return e.lines().groupBy("status").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("part_id").alias("parts"),
        F.sum(F.expr("cast(qty as bigint)")).alias("units"))


@job("tz_normalise")
def tz_normalise(e: Estate) -> DataFrame:
    heads = lineage.tz_normalise(e.order_heads(), LATE_CLOCK_REGION)
    return heads.groupBy("region", day_text("order_ts").alias("day")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.min(F.date_format("order_ts", "HH:mm")).alias("first_clock"))


@job("lineage_filters")
def lineage_filters(e: Estate) -> DataFrame:
    live = lineage.apply_chain(
        e.purchases(), ("exclude_test_accounts", "digital_channels_only"))
    return live.groupBy("region", "channel", "status").agg(F.count(F.lit(1)).alias("orders"))


@job("lineage_chain")
def lineage_chain(e: Estate) -> DataFrame:
    chain = RETAIL["aov"].transforms
    sales = lineage.apply_chain(
        e.sales(dedupe=False, clock=False), chain,
        dedupe_order_id=lambda f: lineage.dedupe_order_id(
            f, ("order_id", "line_no"),
            ("order_ts", "part_id", "supplier_id", "delivered_date", "unit_price", "qty",
             "discount", "status")),
        tz_normalise=lambda f: lineage.tz_normalise(f, LATE_CLOCK_REGION),
    )
    return sales.groupBy("region", "status").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.expr("cast(qty as bigint)")).alias("units"))


@job("materialised_series")
def materialised_series(e: Estate) -> DataFrame:
    """The regional series read from a prepared table instead of the raw lines."""
    return rounded(
        e.order_totals().groupBy("region", day_text("order_ts").alias("day"))
        .agg(F.sum("net").cast("double").alias("value")), MONEY, "value")


@job("freshness")
def freshness(e: Estate) -> DataFrame:
    limits = [(k.kpi_id, s, h) for k in RETAIL.values() for s, h in k.sla_hours.items()]
    sla = e.spark.createDataFrame(limits, "kpi_id string, source_id string, sla_hours int")
    return rounded(lineage.freshness(e.freshness(), sla), 4, "lag_hours")


@job("entitled_series")
def entitled_series(e: Estate) -> DataFrame:
    series = metrics.net_value(e.sales(products=False), ("region", "channel"))
    return stamped(rounded(lineage.entitled(series, ENTITLED), MONEY, "value"), "ts")


@job("column_mask")
def column_mask(e: Estate) -> DataFrame:
    return lineage.masked(e.table("supplier"), ("s_acctbal", "customer_email"))


@job("reproduce_diff")
def reproduce_diff(e: Estate) -> DataFrame:
    """A regional series two ways: summed slices, and one statement per order."""
    sliced = metrics.net_value(e.sales(), config.SALES_DIMS)
    engine = metrics.roll_up(sliced, RETAIL["net_revenue"], ("ts", "region"))
    rerun = (
        e.fold_orders().groupBy(F.date_trunc("day", "order_ts").alias("ts"), "region")
        .agg(F.sum("net").cast("double").alias("value"))
    )
    return metrics.reproduced(engine, rerun, ("ts", "region"), 1e-6)


@job("row_export")
def row_export(e: Estate) -> DataFrame:
    rows = metrics.roll_up(conversion_of(e, RETAIL["checkout_conversion"], "retail"),
                           RETAIL["checkout_conversion"])
    inside = F.col("ts").between(F.lit("2024-01-10").cast("timestamp_ntz"),
                                 F.lit("2024-01-12 23:00:00").cast("timestamp_ntz"))
    return stamped(rounded(rows.withColumn("in_window", inside), 6, "value"), "ts")


@job("invoice_status")
def invoice_status(e: Estate) -> DataFrame:
    book = e.table("orders").withColumn("invoice", F.concat(
        F.when(F.col("o_orderstatus") == "F", "C").otherwise(""), F.col("o_orderkey")))
    return metrics.invoices(book, "invoice").groupBy("status").agg(
        F.count(F.lit(1)).alias("invoices"), F.max("discount").alias("discount"))


@job("replicated_facts")
def replicated_facts(e: Estate) -> DataFrame:
    many = lineage.replicated(e.order_totals(), 4, ("order_id",))
    return rounded(many.groupBy("region").agg(
        F.count_distinct("order_id").alias("orders"),
        F.sum("net").cast("double").alias("value")), MONEY, "value")


@job("latest_day")
def latest_day(e: Estate) -> DataFrame:
    held = lineage.latest_day((e.table("orders"), "o_orderdate"), (e.table("events"), "ts"),
                              (e.shipments(), "promised_date"))
    return held.select(day_text("latest_day").alias("latest_day"))


@job("dimension_values")
def dimension_values(e: Estate) -> DataFrame:
    return lineage.dimension_values(
        lineage.entitled(e.sales(), ENTITLED), config.SALES_DIMS)


# --- metric queries ---------------------------------------------------------------
def sales_for(e: Estate, kpi: Kpi) -> DataFrame:
    """Prepared sales lines for a contract's declared transforms."""
    sales = e.sales(dedupe="dedupe_order_id" in kpi.transforms,
                    clock="tz_normalise" in kpi.transforms,
                    products="category" in kpi.dims)
    return lineage.exclude_test_accounts(sales) if "exclude_test_accounts" in kpi.transforms \
        else sales


def conversion_of(e: Estate, kpi: Kpi, industry: str) -> DataFrame:
    orders = lineage.apply_chain(e.purchases(industry), kpi.transforms)
    return metrics.conversion(e.sessions(industry), orders, kpi.channels,
                              kpi.numerator, kpi.denominator)


def metric(e: Estate, kpi: Kpi, industry: str) -> DataFrame:
    """Any contract's own query, by its shape."""
    if kpi.shape == "net":
        return metrics.net_value(sales_for(e, kpi), kpi.dims)
    if kpi.shape == "orders":
        return metrics.order_count(sales_for(e, kpi), kpi.dims)
    if kpi.shape == "order_value":
        return metrics.order_value(sales_for(e, kpi), kpi.dims, kpi.numerator, kpi.denominator)
    if kpi.shape == "conversion":
        return conversion_of(e, kpi, industry)
    return metrics.on_time(e.shipments(), kpi.dims, DELIVERY_AS_OF, kpi.numerator, kpi.denominator)


def _register_metrics() -> None:
    named = {"net_revenue": "kpi_net_revenue", "orders": "kpi_orders", "aov": "kpi_aov",
             "checkout_conversion": "kpi_conversion", "on_time_delivery": "kpi_on_time"}
    for industry, kpis in (("retail", RETAIL), ("petroleum", PETROLEUM), ("power", POWER)):
        for kpi in kpis.values():
            def build(e: Estate, kpi=kpi, industry=industry) -> DataFrame:
                out = metric(e, kpi, industry)
                doubles = [c for c, t in out.dtypes if t == "double"]
                return stamped(rounded(out, 6, *doubles), "ts")
            job(named.get(kpi.kpi_id, f"kpi_{kpi.kpi_id}"))(build)


_register_metrics()


@job("kpi_uk_net_revenue")
def kpi_uk_net_revenue(e: Estate) -> DataFrame:
    out = metrics.net_value(e.sales(dedupe=False, clock=False, products=False), UK_RETAIL.dims)
    return stamped(rounded(out, 6, "value"), "ts")


# --- roll-ups ---------------------------------------------------------------------
@job("rollup_sum")
def rollup_sum(e: Estate) -> DataFrame:
    sliced = metrics.net_value(e.sales(), config.SALES_DIMS)
    return stamped(rounded(metrics.roll_up(sliced, RETAIL["net_revenue"]), MONEY, "value"), "ts")


@job("rollup_mean")
def rollup_mean(e: Estate) -> DataFrame:
    kpi = Kpi("mean_line", "net", "INR", "day", ("region",), "owner", (), aggregation="mean")
    sliced = metrics.net_value(e.sales(products=False), ("region", "channel"))
    return stamped(rounded(metrics.roll_up(sliced, kpi), 8, "value"), "ts")


@job("rollup_ratio")
def rollup_ratio(e: Estate) -> DataFrame:
    kpi = RETAIL["on_time_delivery"]
    sliced = metrics.on_time(e.shipments(), kpi.dims, DELIVERY_AS_OF, kpi.numerator, kpi.denominator)
    return stamped(rounded(metrics.roll_up(sliced, kpi), 6, "value"), "ts")


@job("slice_series")
def slice_series(e: Estate) -> DataFrame:
    sliced = metrics.net_value(e.sales(), config.SALES_DIMS)
    wanted = lineage.narrowed(sliced, {"region": "ASIA", "category": "PROMO"})
    return stamped(rounded(metrics.roll_up(wanted, RETAIL["net_revenue"]), MONEY, "value"), "ts")


@job("bridge_facts")
def bridge_facts(e: Estate) -> DataFrame:
    facts = metrics.bridge_facts(e.sales(), "sku", config.SALES_DIMS, "1996-01-01", "1997-12-31")
    return rounded(facts.withColumn("d", day_text("d")), 4, "units", "revenue")


@job("per_day")
def per_day(e: Estate) -> DataFrame:
    """Each year's revenue per calendar day, empty days counted."""
    year = F.date_trunc("year", "order_ts").cast("date")
    facts = e.order_totals().groupBy("region", year.alias("y")).agg(
        F.sum("net").cast("double").alias("net"))
    length = F.datediff(F.add_months("y", 12), F.col("y"))
    return facts.select("region", day_text("y").alias("year_start"), length.alias("days"),
                        F.round(F.col("net") / length, 4).alias("per_day"))


@job("money_impact")
def money_impact(e: Estate) -> DataFrame:
    """Each metric's largest one-day move, in money."""
    series = regional(e)
    before = F.lag("value").over(Window.partitionBy("kpi_id", "region").orderBy("ts"))
    moves = series.withColumn("move", F.abs(F.col("value") - before))
    worth = detection.contracts_table(e.spark, list(RETAIL.values()))
    return (
        moves.groupBy("kpi_id", "region").agg(F.max("move").alias("move"))
        .join(worth, "kpi_id")
        .select("kpi_id", "region", F.round("move", 4).alias("move"),
                F.round(F.col("move") * F.col("value_per_unit"), 2).alias("impact"))
    )


# --- drivers ------------------------------------------------------------------------
@job("plan_asof")
def plan_asof(e: Estate) -> DataFrame:
    path = driver_path(e)
    return rounded(path.select("region", day_text("d").alias("d"), "marketing_spend",
                               "planned_stock", "competitor_price_index"),
                   4, "marketing_spend", "planned_stock", "competitor_price_index")


@job("driver_series")
def driver_series(e: Estate) -> DataFrame:
    path = driver_path(e).withColumn("d", day_text("d"))
    return rounded(rounded(path, 9, "realised_price"), 4, "marketing_spend", "planned_stock",
                   "competitor_price_index")


def driver_path(e: Estate) -> DataFrame:
    totals = e.order_totals().select(
        "region", F.to_date("order_ts").alias("d"), F.col("net").alias("revenue"), "units")
    facts = totals.groupBy("region", "d").agg(
        F.sum("revenue").cast("double").alias("revenue"), F.sum("units").cast("double").alias("units"))
    return metrics.price_path(facts, e.plan(), ("marketing_spend", "planned_stock"),
                              "competitor_price_index")


# --- detection ----------------------------------------------------------------------
def regional(e: Estate) -> DataFrame:
    """Net, orders and order value per region and day."""
    return metrics.region_series(e.order_totals())


def peaks(e: Estate) -> DataFrame:
    return e.spark.createDataFrame(list(config.FESTIVALS), "peak string, weight double") \
        .withColumn("peak", F.to_date("peak"))


def with_calendar(e: Estate, series: DataFrame) -> DataFrame:
    days = series.withColumn("day", F.to_date("ts"))
    return detection.festival_factor(days, peaks(e)).drop("day")


def day_series(e: Estate) -> DataFrame:
    """Every daily regional series of the retail contracts, with its calendar."""
    kpi = RETAIL["on_time_delivery"]
    on_time = metrics.on_time(e.shipments(), kpi.dims, DELIVERY_AS_OF, kpi.numerator, kpi.denominator)
    late = metrics.roll_up(on_time, kpi, ("region", "ts")).select(
        F.lit(kpi.kpi_id).alias("kpi_id"), "region", "ts", "value", "n")
    return with_calendar(e, regional(e).unionByName(late)) \
        .withColumn("proportion", F.col("kpi_id") == kpi.kpi_id) \
        .withColumn("counting", F.lit(False))


def hour_series(e: Estate) -> DataFrame:
    """The hourly conversion series of each region, with its calendar."""
    kpi = RETAIL["checkout_conversion"]
    hourly = metrics.roll_up(conversion_of(e, kpi, "retail"), kpi, ("region", "ts"))
    return with_calendar(e, hourly.withColumn("kpi_id", F.lit(kpi.kpi_id))) \
        .withColumn("proportion", F.lit(True)).withColumn("counting", F.lit(False)) \
        .filter("value is not null")


def scored(e: Estate) -> DataFrame:
    """Every retail series scored at its own grain, kept as a stage."""
    return e.stage("scored", lambda: score_all(e))


def score_all(e: Estate) -> DataFrame:
    wanted = ("kpi_id", "region", "ts", "value", "n", "festival", "beta", "level", "log_trend",
              "log_season", "residual", "centre", "mad", "expected", "noise", "scale", "z",
              "band_low", "band_high")
    return reduce(DataFrame.unionByName, (
        detection.baseline(day_series(e), "day").select(*wanted),
        detection.baseline(hour_series(e), "hour").select(*wanted),
    ))


def contracts(e: Estate) -> DataFrame:
    return detection.contracts_table(e.spark, list(RETAIL.values()))


def flagged(e: Estate) -> DataFrame:
    return detection.anomalies(scored(e), contracts(e))


def findings(e: Estate) -> DataFrame:
    return detection.episodes(flagged(e).filter("material"))


@job("festival_factor")
def festival_factor(e: Estate) -> DataFrame:
    days = e.table("orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    out = detection.festival_factor(days, peaks(e))
    return rounded(out.withColumn("day", day_text("day")), 8, "festival")


@job("festival_beta")
def festival_beta(e: Estate) -> DataFrame:
    logged = detection.log_series(day_series(e))
    return rounded(detection.calendar_response(logged), 8, "beta")


@job("half_count")
def half_count(e: Estate) -> DataFrame:
    logged = detection.log_series(hour_series(e))
    return stamped(rounded(logged.select("region", "ts", "fitted", "raw_log"), 8,
                           "fitted", "raw_log"), "ts")


@job("seasonal_baseline")
def seasonal_baseline(e: Estate) -> DataFrame:
    out = scored(e).select("kpi_id", "region", "ts", "log_trend", "log_season", "residual")
    return stamped(rounded(out, 6, "log_trend", "log_season", "residual"), "ts")


@job("robust_z")
def robust_z(e: Estate) -> DataFrame:
    out = scored(e).select("kpi_id", "region", "ts", "centre", "mad", "z")
    return stamped(rounded(out, 5, "centre", "mad", "z"), "ts")


def fitted_lines(e: Estate) -> DataFrame:
    """Every series decomposed by local regression at its own grain, kept as a stage."""
    wanted = ("kpi_id", "region", "ts", "log_trend", "log_season", "season_short", "season_long", "expected", "z")

    def at(series: DataFrame, grain: str) -> DataFrame:
        short, long = (f"season_{p}" for p in seasons.SEASONS[grain])
        return detection.loess_baseline(series, grain).withColumns(
            {"season_short": F.col(short), "season_long": F.col(long)}).select(*wanted)

    return e.stage("fitted_lines", lambda: at(day_series(e), "day").unionByName(at(hour_series(e), "hour")))


@job("loess_baseline")
def loess_baseline(e: Estate) -> DataFrame:
    """The local regression of every daily and hourly series, with both of its seasons."""
    numbers = ("log_trend", "log_season", "season_short", "season_long", "log_expected", "z")
    out = fitted_lines(e).withColumn("log_expected", F.log("expected")).drop("expected")
    return stamped(rounded(out, 5, *numbers), "ts")


@job("noise_profile")
def noise_profile(e: Estate) -> DataFrame:
    out = scored(e).filter("n is not null").select("kpi_id", "region", "ts", "noise", "scale")
    return stamped(rounded(out, 6, "noise", "scale"), "ts")


@job("expected_band")
def expected_band(e: Estate) -> DataFrame:
    out = scored(e).select("kpi_id", "region", "ts", "expected", "band_low", "band_high")
    return stamped(rounded(out, 4, "expected", "band_low", "band_high"), "ts")


@job("anomalies")
def anomalies(e: Estate) -> DataFrame:
    out = flagged(e).select("kpi_id", "region", "ts", "direction", "delta", "z")
    return stamped(rounded(out, 4, "delta", "z"), "ts")


@job("material")
def material(e: Estate) -> DataFrame:
    out = flagged(e).filter("material").select("kpi_id", "region", "ts", "direction", "impact")
    return stamped(rounded(out, 2, "impact"), "ts")


@job("sparse_series")
def sparse_series(e: Estate) -> DataFrame:
    """History check per region, route and device, many of them short."""
    series = metrics.net_value(e.sales(products=False), ("region", "channel", "device")).select(
        F.concat_ws("/", "channel", "device").alias("kpi_id"), "region", "ts", "value")
    weekly = series.groupBy("kpi_id", "region", F.date_trunc("week", "ts").alias("ts")).agg(
        F.sum(F.expr("cast(value as decimal(18,6))")).cast("double").alias("value"))
    return rounded(detection.sparse(weekly, "week"), 6, "first", "last", "change_pct")


@job("episodes")
def episodes(e: Estate) -> DataFrame:
    out = findings(e).drop("episode")
    for column in ("start", "end", "worst_day"):
        out = out.withColumn(column, day_text(column))
    return rounded(out, 4, "delta", "pct", "z", "impact")


@job("triage_topk")
def triage_topk(e: Estate) -> DataFrame:
    """The flagship: what to look at first, over every metric and region."""
    out = detection.queue(findings(e), 12, "both").select(
        "kpi_id", "region", "direction", day_text("start").alias("start"),
        day_text("end").alias("end"), "days", "impact")
    return rounded(out, 2, "impact")


@job("triage_recent")
def triage_recent(e: Estate) -> DataFrame:
    latest = lineage.latest_day((regional(e), "ts"))
    out = detection.queue(findings(e), 12, "drop", 730, latest).select(
        "kpi_id", "region", day_text("start").alias("start"), day_text("end").alias("end"), "impact")
    return rounded(out, 2, "impact")


def edges(e: Estate) -> DataFrame:
    rows = [(k.kpi_id, p) for k in RETAIL.values() for p in k.parents]
    return e.spark.createDataFrame(rows, "child string, parent string")


@job("kpi_closure")
def kpi_closure(e: Estate) -> DataFrame:
    """How many findings of each metric could fold into each of its ancestors."""
    counts = findings(e).groupBy("kpi_id").agg(F.count(F.lit(1)).alias("findings"))
    return detection.ancestors(edges(e)).join(counts, "kpi_id", "left").select(
        "kpi_id", "ancestor", F.coalesce("findings", F.lit(0)).alias("findings"))


@job("folded_findings")
def folded_findings(e: Estate) -> DataFrame:
    out = folding.fold(findings(e), detection.ancestors(edges(e)))
    return rounded(out.select(
        "region", "kpi_id", "direction", day_text("start").alias("start"),
        day_text("end").alias("end"), "impact",
        F.array_join("also_moved", ",").alias("also_moved")), 2, "impact")


@job("expected_direction")
def expected_direction(e: Estate) -> DataFrame:
    windows = findings(e).select(
        F.concat_ws("|", "kpi_id", "region", "direction", day_text("start")).alias("finding_id"),
        "kpi_id", "region", "start", "end")
    return rounded(detection.expected_direction(scored(e), windows), 3, "gap")


@job("overview")
def overview(e: Estate) -> DataFrame:
    out = detection.overview(scored(e), flagged(e), 365)
    return rounded(out, 4, "latest", "expected", "period_change", "worst_pct")


# --- dated events either side of a window -----------------------------------------------
@job("signal_days")
def signal_days(e: Estate) -> DataFrame:
    rank = severity_rank("severity", ("green", "yellow", "amber", "orange", "red"))
    folded = e.signals().groupBy(day_text("valid_from").alias("day"), "signal_type").agg(
        F.count(F.lit(1)).alias("warnings"),
        F.max("lead_time_hours").alias("lead_time_hours"),
        F.max_by("severity", rank).alias("severity"),
        F.array_join(F.array_sort(F.collect_set("city")), ",").alias("cities"),
        F.array_join(F.array_sort(F.collect_set("region")), ",").alias("regions"))
    return folded


@job("promo_weeks")
def promo_weeks(e: Estate) -> DataFrame:
    return rounded(
        e.plan().filter("promo_active").groupBy(day_text("week").alias("week"), "promo_id").agg(
            F.sum("marketing_spend").alias("spend"),
            F.array_join(F.array_sort(F.collect_set("region")), ",").alias("regions"),
            F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories")),
        4, "spend")


@job("calendar_band")
def calendar_band(e: Estate) -> DataFrame:
    """What was dated around a window: warnings only behind it, never ahead."""
    lo, end, horizon = (F.lit(d).cast("date") for d in ("1998-07-01", "1998-09-30", "1999-01-28"))
    warned = (
        e.signals().withColumn("day", F.to_date("valid_from"))
        .filter((F.col("day") <= end) & (F.to_date("valid_to") >= lo))
        .groupBy("day").agg(F.count(F.lit(1)).cast("double").alias("size"))
        .select(F.lit("signal").alias("kind"), "day", "size"))
    promos = (
        e.plan().filter("promo_active").filter((F.col("week") >= lo) & (F.col("week") <= horizon))
        .groupBy(F.col("week").alias("day")).agg(F.sum("marketing_spend").alias("size"))
        .select(F.lit("promotion").alias("kind"), "day", "size"))
    dated = detection.festival_factor(
        peaks(e).select(F.col("peak").alias("day")).filter(
            (F.col("day") >= lo) & (F.col("day") <= horizon)), peaks(e)) \
        .select(F.lit("calendar").alias("kind"), "day", (F.col("festival") - 1).alias("size"))
    return rounded(
        warned.unionByName(promos).unionByName(dated).select(
            "kind", day_text("day").alias("day"),
            F.when(F.col("day") <= end, "behind").otherwise("ahead").alias("side"), "size"),
        4, "size")
