"""The tables a run reads: the raw scans and the business views over them.

Each view asks only for the joins its caller's columns need, so a metric that
never mentions a product never joins the product table. Join strategies are
left to Catalyst, which broadcasts a side only when its measured size is under
the session's threshold, and to adaptive execution for skewed keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwise.config import ROUTES
from driftwise.functions.columns import money, pick
from driftwise.operators.lineage import materialise, read_table, snapshot
from driftwise.operators.metrics import bridge_facts
from driftwise.session import joined_as_dealt, prepare, shared_folder
from driftwise.sources import prepared

def _code_digest() -> str:
    """A digest of this package's own source, so new code never reads old stages."""
    digest = hashlib.sha256()
    for path in sorted(Path(__file__).parents[1].rglob("*.py")):
        digest.update(path.read_bytes())
    return digest.hexdigest()[:12]


STAGE_VERSION = _code_digest()
_SNAPSHOTS: dict[tuple[str, str], str] = {}
_PREPARED: dict[tuple[str, str], prepared.Manifest] = {}
#: Columns of lines that only some jobs read, and those of products.
LINE_EXTRAS = ("l_tax",)
PRODUCT = ("category", "sku", "p_retailprice")

READABLE = frozenset((
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
))

# The region whose till clocks run on local time, and by how much.
LATE_CLOCK_REGION = "ASIA"
CLOCK_OFFSET = "interval 5 hours 30 minutes"

TRAFFIC_REGIONS = ("North", "South", "East", "West")
TRAFFIC_DEVICES = ("mobile", "desktop", "tablet")
SALES_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
SIGNAL_TYPES = ("severe_weather", "carrier_disruption", "competitor_action", "supply_disruption")
FIRST_NOTE_DAY = "1996-01-01"
NOTE_SPAN_DAYS = 1800

# Wording of the operational notes, one per line; {k} is a version or ticket
# number, {c} a product family and {s} a product code.
NOTE_WORDING = (
    "release 4.{k}: checkout flow rewritten, card entry moved on android",
    "INC-{k}: courier backlog after flooding near the regional depot",
    "rolled back release 4.{k} after the card form stopped loading",
    "stock-{k}: {c} out of stock at the distribution centre, supplier shortfall",
    "promo desk {k}: competitor cut {c} prices across the region",
    "release 2.{k}: desktop site navigation and search ranking",
    "campaign {k}: media spend paused for mobile app installs",
    "price-{k}: list price of {s} went up, shoppers say cheaper elsewhere",
    "hotfix 4.{k} shipped for the payment page on ios",
    "ticket {k}: parcel arrived late, no update for three days",
    "ticket {k}: cannot complete checkout on the website, card declined",
    "ticket {k}: item was damaged, packaging was torn",
    "ticket {k}: store was shut because of storm warnings",
    "ticket {k}: sold out again, no stock of {c} in the shop",
    "ticket {k}: nice staff, quick answer, thank you",
    "storm-{k}: severe weather closed the coastal warehouse",
)


class Estate:
    """Read-only access to one set of tables."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = prepare(spark)
        self.root = root.rstrip("/")

    def stage(self, name: str, build: Callable[[], DataFrame], options: dict[str, str] | None = None) -> DataFrame:
        """A result many jobs share, written once per snapshot of the sources, with options for its files.

        A session sees one snapshot: the sources are listed on first use.
        """
        held = (self.spark.sparkContext.applicationId, self.root)
        if held not in _SNAPSHOTS:
            _SNAPSHOTS[held] = snapshot(self.spark, self.root)
        return materialise(self.spark, build, name, (_SNAPSHOTS[held], STAGE_VERSION), options)

    # --- raw scans --------------------------------------------------------
    def table(self, name: str, limit: int | None = None) -> DataFrame:
        """One source table; a name outside the list is refused, not guessed."""
        if name not in READABLE:
            raise ValueError(f"{name!r} is not a readable table; expected one of {sorted(READABLE)}")
        frame = read_table(self.spark, f"{self.root}/{name}.parquet")
        return frame if limit is None else frame.limit(limit)

    def wide(self, name: str) -> DataFrame:
        """A table for heavy work per row, spread where its scan is too narrow.

        A small table is often one task however many cores there are. A scan
        with at least as many splits as cores is left alone: nothing is shuffled.
        """
        frame = self.table(name)
        cores = self.spark.sparkContext.defaultParallelism
        return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame

    # --- sales ------------------------------------------------------------
    def lines(self, dedupe: bool = True, extra: tuple[str, ...] = (), only: Column | None = None) -> DataFrame:
        """Order lines under their business names, repeated postings removed.

        The first row per (order, line) is kept under a total order, so the
        choice does not depend on partitioning. Spark keeps at most one row per
        key on the map side before shuffling (row_number() = 1), so a line
        posted millions of times never reaches one task whole.
        """
        raw = self.wide("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
            "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", *extra,
        )
        if only is not None:
            raw = raw.filter(only)
        if dedupe:
            first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(
                "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
                "l_quantity", "l_discount", "l_returnflag",
            )
            raw = raw.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
        return raw.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_partkey").alias("part_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_shipdate").alias("delivered_date"),
            F.col("l_quantity").alias("qty"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
            (F.col("l_extendedprice") * F.col("l_discount")).alias("discount"),
            F.when(F.col("l_returnflag") == "R", "cancelled").otherwise("completed").alias("status"),
            *extra,
        )

    def order_heads(self) -> DataFrame:
        """One row per order with its time, place, route and account flag."""
        places = (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("c_custkey"), F.col("r_name").alias("region"),
                    F.col("c_mktsegment").alias("channel"))
        )
        return (
            self.table("orders")
            .join(places, F.col("o_custkey") == F.col("c_custkey"))
            .select(
                F.col("o_orderkey").alias("order_id"),
                F.col("o_orderdate").alias("order_ts"),
                "region", "channel",
                F.col("o_orderpriority").alias("device"),
                F.expr("o_custkey % 250 = 0").alias("is_test"),
                "o_totalprice", "o_orderstatus",
            )
        )

    def sales(self, dedupe: bool = True, products: bool = True, clock: bool = True,
              extra: tuple[str, ...] = ()) -> DataFrame:
        """Order lines with every dimension a sales metric can be cut by.

        Lines without repeated postings are read from the prepared table.
        """
        if dedupe and set(extra) <= set(LINE_EXTRAS):
            frame = self.prepared_sales().drop(*(set(LINE_EXTRAS) - set(extra)))
            frame = frame.filter("sold").drop("sold") if products else frame.drop("sold", *PRODUCT)
        else:
            heads = self.order_heads().drop("o_totalprice", "o_orderstatus")
            frame = self.lines(dedupe, extra).join(heads, "order_id")
            if products:
                frame = frame.join(self.products(), "part_id")
        return frame.withColumn("order_ts", local_clock()) if clock else frame

    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("part_id"), F.col("p_type").alias("category"),
            F.col("p_brand").alias("sku"), "p_retailprice")

    def prepared_sales(self) -> DataFrame:
        """Order lines, repeated postings removed, with all dimensions; ``sold`` says that the product is known.

        The table is kept in slices of order ids, in which all postings of a line lie, and
        only slices whose lines or orders changed are built again. Customers, places and
        products are shared by all slices, so a change there builds all of them.
        """
        held = (self.spark.sparkContext.applicationId, self.root)
        if held not in _PREPARED:
            _PREPARED[held] = self.refresh_sales()
        schema = self.built_sales(None, prepared.LEAST_WIDTH).drop("slice").schema
        return prepared.read(self.spark, _PREPARED[held], schema)

    def built_sales(self, chosen: Column | None, width: int) -> DataFrame:
        """Prepared lines with their slice, laid out by it.

        Lines meet their product while they are narrow; then lines and orders are dealt by
        slice, once, which serves their join and the writing, so no place or route is shuffled with a line.
        """
        products = self.products().withColumn("sold", F.lit(True))
        lines = self.lines(extra=LINE_EXTRAS, only=chosen).join(products, "part_id", "left") \
            .withColumn("sold", F.coalesce("sold", F.lit(False)))
        heads = self.order_heads().drop("o_totalprice", "o_orderstatus")

        def dealt(frame: DataFrame) -> DataFrame:
            return frame.withColumn("slice", prepared.slice_of(F.col("order_id"), width)).repartition("slice")

        told = dealt(lines).join(dealt(heads), ["slice", "order_id"])
        return told.select("part_id", "order_id", *[c for c in lines.columns if c not in ("part_id", "order_id", *PRODUCT, "sold")],
                           *[c for c in heads.columns if c != "order_id"], *PRODUCT, "sold", "slice")

    def refresh_sales(self) -> prepared.Manifest:
        root = hashlib.sha256(self.root.encode()).hexdigest()[:12]
        folder = f"{shared_folder(self.spark).rstrip('/')}/sales-{root}-{STAGE_VERSION}"
        lines, orders = self.table("lineitem"), self.table("orders")

        def told(width: int) -> DataFrame:
            shared = prepared.whole_digest([self.table(t) for t in ("customer", "nation", "region", "part")])
            parts = prepared.digests(lines, "l_orderkey", width, shared).unionByName(
                prepared.digests(orders, "o_orderkey", width, "orders"))
            return parts.filter("slice is not null").groupBy("slice").agg(
                F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ","), 256).alias("digest"))

        def build(width: int, slices: list[int]) -> DataFrame:
            chosen = prepared.slice_of(F.col("l_orderkey"), width).isin(slices)
            return self.built_sales(chosen, width)

        with joined_as_dealt(self.spark):
            return prepared.refresh(self.spark, folder, snapshot(self.spark, self.root),
                                    lambda: lines.agg(F.max("l_orderkey")).first()[0], told, build)

    def order_totals(self) -> DataFrame:
        """Net value per order, kept as a stage."""
        return self.stage("order_totals", lambda: self.fold_orders(
            self.prepared_sales().select("order_id", "status", "qty", "unit_price", "discount")))

    def daily_facts(self) -> DataFrame:
        """Exact units and revenue per day, product and slice, kept as a stage."""
        return self.stage("daily_facts", lambda: bridge_facts(
            self.sales(), "sku", ("region", "channel", "category", "device")))

    def fold_orders(self, lines: DataFrame | None = None) -> DataFrame:
        """Net value per order, summed before any dimension is joined; from the raw lines if none are given.

        Lines are folded to orders first, on the key they are next joined on, so
        the wide join carries one row per order instead of one per line.
        """
        net = (
            (self.lines() if lines is None else lines).filter("status <> 'cancelled'")
            .groupBy("order_id")
            .agg(F.sum(money("qty * unit_price - discount")).alias("net"),
                 F.sum(F.expr("cast(qty as decimal(18,6))")).alias("units"))
        )
        heads = self.order_heads().withColumn("order_ts", local_clock())
        return net.join(heads, "order_id")

    # --- traffic, deliveries, plan, ledger ---------------------------------
    def sessions(self, industry: str = "retail") -> DataFrame:
        return (
            self.table("events").filter("event_type in ('view', 'click')")
            .select(F.col("ts").alias("session_ts"), *self._traffic_dims(industry),
                    F.lit(1).cast("bigint").alias("sessions"))
        )

    def purchases(self, industry: str = "retail") -> DataFrame:
        return (
            self.table("events").filter("event_type = 'purchase'")
            .select(F.col("event_id").alias("order_id"), F.col("ts").alias("order_ts"),
                    *self._traffic_dims(industry),
                    F.when(F.col("value") < 5, "cancelled").otherwise("completed").alias("status"),
                    F.expr("user_id % 25 = 0").alias("is_test"))
        )

    @staticmethod
    def _traffic_dims(industry: str) -> list[Column]:
        k = F.get_json_object("props", "$.k").cast("int")
        return [
            pick(TRAFFIC_REGIONS, F.col("user_id")).alias("region"),
            pick(ROUTES[industry], k).alias("channel"),
            pick(TRAFFIC_DEVICES, F.col("user_id")).alias("device"),
        ]

    def shipments(self) -> DataFrame:
        """Deliveries with the promise they were made against."""
        return (
            self.sales(dedupe=True, clock=False)
            .select(
                F.concat_ws("-", "order_id", "line_no").alias("shipment_id"),
                (F.col("order_ts") + F.expr("interval 60 days")).alias("promised_date"),
                F.when(F.expr("order_id % 50 <> 0"), F.col("delivered_date")).alias("delivered_date"),
                "region", "category",
                F.concat(F.lit("carrier-"), F.expr("supplier_id % 5")).alias("carrier"),
            )
        )

    def plan(self) -> DataFrame:
        """The weekly plan by region and category, kept as a stage."""
        return self.stage("plan", self.weekly_plan)

    def weekly_plan(self) -> DataFrame:
        """Spend, stock and a price index per week, promotions included."""
        sales = self.sales(extra=("l_tax",), clock=False)
        week = F.date_trunc("week", F.col("order_ts")).cast("date")
        promo = F.expr("(weekofyear(week) + length(category)) % 5 = 0")
        return (
            sales.groupBy(week.alias("week"), "region", "category")
            .agg(
                F.sum(F.expr("cast(qty * unit_price * l_tax as decimal(18,6))")).cast("double")
                .alias("marketing_spend"),
                F.sum(F.expr("cast(qty as decimal(18,6))")).cast("double").alias("planned_stock"),
                F.avg(F.expr("unit_price / p_retailprice")).alias("competitor_price_index"),
            )
            .withColumn("promo_active", promo)
            .withColumn("promo_id", F.when(F.col("promo_active"), F.concat_ws(
                "-", F.lit("promo"), F.lower("category"), F.expr("cast(year(week) as string)"),
                F.expr("cast(quarter(week) as string)"))))
        )

    def ledger(self) -> DataFrame:
        """Finance's own posting: net per region-day less late netted returns."""
        daily = (
            self.order_totals()
            .groupBy("region", F.to_date("order_ts").alias("business_date"))
            .agg(F.sum("net").cast("double").alias("net"))
        )
        behind = F.lag("net", 3).over(Window.partitionBy("region").orderBy("business_date"))
        return daily.select(
            "region", "business_date",
            F.round(F.col("net") - 0.021 * F.coalesce(behind, F.lit(0.0)), 2)
            .alias("net_revenue_posted"),
        )

    # --- text ---------------------------------------------------------------
    def documents(self) -> DataFrame:
        """The document estate: long texts with a time, a kind and a region."""
        return self.wide("documents").select(
            "doc_id",
            pick(("support_ticket", "release_log", "ops_note"),
                 F.regexp_extract("source", "([0-9]+)", 1).cast("int")).alias("doc_type"),
            F.expr("timestamp_ntz'1996-01-01 00:00:00' + make_dt_interval("
                   "cast(doc_id * 37 % 1800 as int), cast(doc_id % 24 as int))").alias("ts"),
            F.when(F.expr("doc_id % 11 = 0"), "All")
            .otherwise(pick(SALES_REGIONS, F.col("doc_id"))).alias("region"),
            "text", "lang", "n_chars",
        )

    def notes(self) -> DataFrame:
        """Operational notes and tickets, worded from failed events."""
        wording = pick(NOTE_WORDING, F.col("event_id"))
        number = F.expr("cast(10 + event_id % 90 as string)")
        category = F.lower(pick(("ECONOMY", "SMALL", "PROMO", "LARGE", "STANDARD", "MEDIUM"),
                                F.col("user_id")))
        sku = F.concat(F.lit("brand-"), F.expr("1 + user_id % 25"))
        text = F.replace(F.replace(F.replace(wording, F.lit("{k}"), number),
                                   F.lit("{c}"), category), F.lit("{s}"), sku)
        slot = F.expr("event_id % 16")
        return (
            self.table("events").filter("event_type = 'error'")
            .select(
                F.concat(F.lit("note-"), F.col("event_id")).alias("doc_id"),
                F.when(slot.between(9, 14), "support_ticket")
                .when(slot.isin(0, 2, 5, 8), "release_log").otherwise("ops_note").alias("doc_type"),
                self._shifted("event_id * 7").alias("ts"),
                F.when(F.expr("event_id % 13 = 0"), "All")
                .otherwise(pick(SALES_REGIONS, F.col("user_id"))).alias("region"),
                text.alias("text"),
            )
        )

    @staticmethod
    def _shifted(step: str) -> Column:
        """An event's clock time, moved onto the sales calendar."""
        return F.expr(
            f"timestamp_ntz'{FIRST_NOTE_DAY} 00:00:00'"
            f" + make_dt_interval(cast(({step}) % {NOTE_SPAN_DAYS} as int), hour(ts), minute(ts))"
        )

    # --- outside warnings -----------------------------------------------------
    def signals(self) -> DataFrame:
        """Published warnings, each valid for a day."""
        lead = F.get_json_object("props", "$.k").cast("double")
        frame = self.table("events").filter("event_type = 'error'").select(
            F.concat(F.lit("sig-"), F.col("event_id")).alias("signal_id"),
            pick(SIGNAL_TYPES, F.col("event_id")).alias("signal_type"),
            F.concat(F.lit("city-"), F.expr("user_id % 20")).alias("city"),
            pick(SALES_REGIONS, F.col("user_id")).alias("region"),
            F.when(F.col("value") >= 100, "red").when(F.col("value") >= 50, "amber")
            .when(F.col("value") >= 20, "yellow").otherwise("green").alias("severity"),
            self._shifted("event_id * 13").alias("valid_from"),
            lead.alias("lead_time_hours"),
            F.expr("event_id % 5 <> 0").alias("is_public"),
            F.concat(F.lit("publisher-"), F.expr("event_id % 7")).alias("publisher"),
        )
        return (
            frame
            .withColumn("valid_to", F.col("valid_from") + F.expr("interval 24 hours"))
            .withColumn("issued_at", F.expr(
                "valid_from - make_dt_interval(0, cast(lead_time_hours as int))"))
        )

    def freshness(self) -> DataFrame:
        """When each feed last carried a row, against one fixed reading time."""
        def reading(name: str, source: str, column: str) -> DataFrame:
            return self.table(source).agg(F.max(column).alias("as_of")).select(
                F.lit(name).alias("source_id"), "as_of")

        readings = reading("pos_txn", "orders", "o_orderdate").unionByName(
            reading("ext_signals", "events", "ts")).unionByName(
            reading("shipments", "lineitem", "l_shipdate"))
        return readings.withColumn("observed_at", F.expr(
            "case when source_id = 'ext_signals' then timestamp_ntz'2024-02-01 00:00:00'"
            " else timestamp_ntz'2001-12-01 00:00:00' end"))

    # --- judgements, outcomes, log ----------------------------------------------
    def feedback(self) -> DataFrame:
        """Readers' judgements of past findings."""
        judgements = ("confirmed", "wrong_cause", "missed_cause", "not_material",
                      "wrong_owner", "noise_source", "comment")
        return self.table("events").filter("event_type = 'purchase'").select(
            F.concat(F.lit("fb-"), F.col("event_id")).alias("feedback_id"),
            F.concat(F.lit("run-"), F.expr("event_id % 97")).alias("run_id"),
            pick(("net_revenue", "orders", "aov"), F.col("user_id")).alias("kpi_id"),
            pick(judgements, F.expr("event_id % 11")).alias("judgement"),
            F.concat(F.lit("user-"), F.col("user_id")).alias("submitted_by"),
            F.col("ts").alias("submitted_at"),
            F.when(F.expr("event_id % 3 <> 0"),
                   F.concat(F.lit("cand-"), F.expr("event_id % 40"))).alias("candidate_id"),
            F.when(F.expr("event_id % 4 = 0"), F.lit("supplier shortfall")).alias("correction"),
            (F.col("value") * 100).alias("movement_inr"),
            F.col("event_id").alias("seq"),
        )

    def outcomes(self) -> DataFrame:
        """Scored benchmark cases, one per labelled document."""
        expected = ("cause_verified", "no_anomaly", "abstain", "cannot_verify", "cause_verified")
        verdicts = ("explained", "unknown", "explained", "no_movement")
        docs = self.table("documents").select("doc_id", "n_chars")
        return self.table("labels").join(docs, "doc_id").select(
            F.concat(F.lit("case-"), F.col("doc_id")).alias("case_id"),
            pick(expected, F.col("doc_id")).alias("expected"),
            pick(verdicts, F.expr("doc_id div 3")).alias("verdict"),
            F.expr("(doc_id * 7919 % 1000) / 1000.0D").alias("confidence"),
            F.when(F.expr("doc_id % 10 < 8"), F.expr("quality = 1")).alias("top1"),
            F.when(F.expr("doc_id % 10 < 8"), F.expr("quality = 1 or doc_id % 3 = 0")).alias("topk"),
            F.expr("doc_id % 4 <> 0").alias("detected"),
            F.expr("doc_id % 4 in (1, 2)").alias("material_detected"),
            F.when(F.expr("doc_id % 2 = 0"), F.expr("toxic = 0")).alias("decoy_rejected"),
            F.when(F.expr("doc_id % 3 = 0"), "train").otherwise("test").alias("split"),
            (F.col("n_chars") / 1000.0).alias("seconds"),
        )

    def audit_log(self) -> DataFrame:
        """An append-only log whose rows each name the row before them.

        Two rows are damaged on purpose so that verification has work to do.
        """
        entry = self.table("events").select(
            (F.col("event_id") + 1).alias("seq"),
            F.concat_ws("|", F.col("event_id").cast("string"), F.col("event_type"),
                        F.col("user_id").cast("string"), F.col("props")).alias("body"),
        )
        own = F.sha2("body", 256)
        signed = entry.select(
            "seq", "body",
            F.when(F.expr("seq % 4999 = 0"), F.sha2(F.concat("body", F.lit("!")), 256))
            .otherwise(own).alias("hash"),
            own.alias("_true"),
        )
        before = signed.select((F.col("seq") + 1).alias("seq"), F.col("_true").alias("prev"))
        return signed.join(before, "seq", "left").select(
            "seq", "body", "hash", F.coalesce("prev", F.lit("0" * 64)).alias("prev"))


def local_clock() -> Column:
    """Order time with the late-clock region moved back to the common clock."""
    return F.when(F.col("region") == LATE_CLOCK_REGION, F.col("order_ts") - F.expr(CLOCK_OFFSET)) \
        .otherwise(F.col("order_ts"))
