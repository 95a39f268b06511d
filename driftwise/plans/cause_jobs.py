"""Jobs that place a movement and test its candidate causes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.functions import text as words
from driftwise.functions.columns import day_text
from driftwise.operators import candidates as cands
from driftwise.operators import causal
from driftwise.operators import decomposition as parts
from driftwise.operators.actions import driver_of
from driftwise.plans.registry import job
from driftwise.plans.series_jobs import driver_path, findings, rounded
from driftwise.sources.estate import Estate

DIMS = ("channel", "category", "device", "sku")

# What the note wording means on these tables.
SALES_SCOPE = {
    "channel": {"app": "HOUSEHOLD", "mobile app": "HOUSEHOLD", "android": "HOUSEHOLD",
                "ios": "HOUSEHOLD", "website": "MACHINERY", "web": "MACHINERY",
                "browser": "MACHINERY", "desktop site": "MACHINERY", "store": "BUILDING",
                "outlet": "BUILDING", "shop": "BUILDING", "footfall": "BUILDING"},
    "device": {"android": "1-URGENT", "iphone": "1-URGENT", "mobile": "1-URGENT",
               "desktop": "2-HIGH", "laptop": "2-HIGH", "tablet": "3-MEDIUM"},
    "category": {"economy": "ECONOMY", "small": "SMALL", "promo": "PROMO", "large": "LARGE",
                 "standard": "STANDARD", "medium": "MEDIUM"},
}


def cases(e: Estate) -> DataFrame:
    """The findings the diagnosis jobs explain, kept as a stage."""
    return e.stage("cases", lambda: open_cases(e))


def open_cases(e: Estate) -> DataFrame:
    """Every detected revenue finding, rises and drops alike."""
    return findings(e).filter("kpi_id = 'net_revenue'").select(
        F.concat_ws("|", "region", "direction", day_text("start")).alias("finding_id"),
        "region", "start", "end")


def facts(e: Estate) -> DataFrame:
    return e.daily_facts()


def net_by_day(e: Estate) -> DataFrame:
    return e.order_totals().groupBy("region", F.to_date("order_ts").alias("d")).agg(
        F.sum("net").cast("double").alias("primary"))


def posted(e: Estate) -> DataFrame:
    return e.ledger().select("region", F.col("business_date").alias("d"),
                             F.col("net_revenue_posted").alias("secondary"))


def booked(e: Estate) -> DataFrame:
    """Order headers' own totals: a second system that does not agree."""
    heads = e.order_heads()
    return heads.groupBy("region", F.to_date("order_ts").alias("d")).agg(
        F.sum(F.expr("cast(o_totalprice as decimal(18,6))")).cast("double").alias("secondary"))


@job("reconcile_days")
def reconcile_days(e: Estate) -> DataFrame:
    out = parts.reconcile_days(cases(e), net_by_day(e), posted(e))
    return rounded(out.withColumn("d", day_text("d")), 4, "primary", "secondary", "residual")


@job("reconcile_state")
def reconcile_state(e: Estate) -> DataFrame:
    found = cases(e)
    out = None
    for source, ledger in (("finance_ledger", posted(e)), ("order_headers", booked(e))):
        days = parts.reconcile_days(found, net_by_day(e), ledger)
        state = parts.reconcile_state(found, days).withColumn("source", F.lit(source))
        out = state if out is None else out.unionByName(state)
    return rounded(out, 6, "worst")


@job("pvm_bridge")
def pvm_bridge(e: Estate) -> DataFrame:
    out = parts.price_volume_mix(parts.two_periods(cases(e), facts(e), ("sku",)))
    return rounded(out.select("finding_id", "base_revenue", "current_revenue", "volume", "mix",
                              "price", "products", "status"),
                   2, "base_revenue", "current_revenue", "volume", "mix", "price")


def slices(e: Estate) -> DataFrame:
    return parts.contributions(cases(e), facts(e), DIMS)


@job("contribution")
def contribution(e: Estate) -> DataFrame:
    out = slices(e).select("finding_id", "dimension", "slice", "base", "current", "delta", "share",
                           "pct_change")
    return rounded(rounded(out, 5, "base", "current", "delta"), 6, "share", "pct_change")


@job("concentration")
def concentration(e: Estate) -> DataFrame:
    return rounded(parts.concentration(slices(e), 2), 6, "top_share")


@job("rank_exact")
def rank_exact(e: Estate) -> DataFrame:
    return rounded(parts.rank_exact(slices(e), 8), 5, "value", "share")


DRIVERS = ("realised_price", "marketing_spend", "planned_stock", "competitor_price_index")


def driver_moments(e: Estate) -> DataFrame:
    path = driver_path(e).join(net_by_day(e), ["region", "d"])
    return parts.driver_moments(path, "region", "primary", DRIVERS)


@job("driver_corr")
def driver_corr(e: Estate) -> DataFrame:
    out = driver_moments(e).select(
        "region", "n", *[F.col(f"r_y_{i}").alias(f"r_{d}") for i, d in enumerate(DRIVERS)])
    return rounded(out, 6, *[f"r_{d}" for d in DRIVERS])


@job("rank_drivers")
def rank_drivers(e: Estate) -> DataFrame:
    """Drivers by their weight in each region's fit, without those that causal tests rejected there."""
    fitted = parts.ridge(driver_moments(e), "region", DRIVERS, rejected=rejected_drivers(e))
    return rounded(parts.rank_drivers(fitted), 6, "coefficient")


def rejected_drivers(e: Estate) -> DataFrame:
    """(region, driver): some cause of the driver was rejected in the region and none verified."""
    told = tested(e).withColumn("driver", driver_of(F.col("kind"), F.col("description"))).join(
        cases(e).select("finding_id", F.col("region").alias("held")), "finding_id")
    judged = told.filter("driver is not null").groupBy(F.col("held").alias("region"), "driver").agg(
        F.count_if(F.col("state") == "rejected").alias("out"), F.count_if(F.col("state") == "verified").alias("held"))
    return judged.filter("out > 0 and held = 0").select("region", "driver")


# --- candidates -----------------------------------------------------------------------
def skus(e: Estate) -> DataFrame:
    return e.table("part").select(F.col("p_brand").alias("sku")).distinct()


def parsed(e: Estate) -> DataFrame:
    return cands.read_notes(e.notes(), skus(e), SALES_SCOPE)


def from_notes(e: Estate, found: DataFrame) -> DataFrame:
    return cands.note_candidates(found, parsed(e))


def shown(frame: DataFrame) -> DataFrame:
    return frame.withColumn("start", day_text("start")).withColumn("end", day_text("end")) \
        .withColumn("exposed", F.array_join("exposed", ","))


@job("note_candidates")
def note_candidates(e: Estate) -> DataFrame:
    return shown(from_notes(e, cases(e))).select(
        "finding_id", "doc_id", "candidate_id", "kind", "start", "end", "exposed", "channel",
        "device", "category", "sku")


@job("scope_terms")
def scope_terms(e: Estate) -> DataFrame:
    text = F.col("text")
    return e.notes().select("doc_id", *[
        words.longest_term(text, terms).alias(dim) for dim, terms in SALES_SCOPE.items()])


@job("sku_mentions")
def sku_mentions(e: Estate) -> DataFrame:
    return cands.sku_mentions(e.notes(), skus(e))


@job("identifiers")
def identifiers(e: Estate) -> DataFrame:
    return e.notes().select("doc_id", words.identifier(F.col("text"), F.col("doc_id")).alias("identifier"))


@job("remediations")
def remediations(e: Estate) -> DataFrame:
    out = cands.remediations(parsed(e), e.notes())
    return out.select("doc_id", "candidate_id", day_text("start").alias("start"),
                      day_text("undone_on").alias("undone_on"), "undone_by", "notes")


@job("plan_candidates")
def plan_candidates(e: Estate) -> DataFrame:
    return shown(cands.plan_candidates(cases(e), e.plan())).select(
        "finding_id", "candidate_id", "kind", "start", "end", "exposed", "category")


def all_candidates(e: Estate) -> DataFrame:
    """Candidates from notes and plan for every finding, kept as a stage."""
    return e.stage("candidates", lambda: gather(e, cases(e)))


def gather(e: Estate, found: DataFrame) -> DataFrame:
    return from_notes(e, found).unionByName(
        cands.plan_candidates(found, e.plan()), allowMissingColumns=True)


@job("relevance")
def relevance(e: Estate) -> DataFrame:
    out = cands.relevance(all_candidates(e), {"category": "PROMO"})
    return out.select("finding_id", "doc_id", "relevant", "set_aside")


@job("fishbone")
def fishbone(e: Estate) -> DataFrame:
    return e.notes().select("doc_id", "doc_type", words.bone(
        F.col("doc_type"), F.col("text")).alias("bone"))


# --- causal tests ---------------------------------------------------------------------
def movements(e: Estate, found: DataFrame | None = None) -> DataFrame:
    """Each finding's level before and during, per day, and which way it went."""
    found = cases(e) if found is None else found
    periods = parts.two_periods(found, net_by_day(e).select(
        "region", "d", F.col("primary").alias("revenue"), F.lit(0.0).alias("units")), ())
    return periods.select(
        "finding_id", F.col("revenue_0").alias("base_revenue"),
        F.col("revenue_1").alias("current_revenue"),
        (F.col("revenue_1") - F.col("revenue_0")).alias("total_change"))


def tested(e: Estate) -> DataFrame:
    """Every relevant candidate with its outcomes and verdict, kept as a stage."""
    moved = lambda: movements(e).select(
        "finding_id", F.signum("total_change").alias("movement"))
    return e.stage("tested", lambda: test_all(e, all_candidates(e), moved()))


def test_all(e: Estate, found: DataFrame, moved: DataFrame) -> DataFrame:
    """Test the relevant ones; ``moved`` gives each finding's direction."""
    kept = cands.relevance(found).filter("relevant").drop("relevant", "set_aside")
    return causal.verify(kept.join(moved, "finding_id", "left"), facts(e))


@job("scope_panel")
def scope_panel(e: Estate) -> DataFrame:
    laid = causal.scoped_panel(facts(e)).groupBy("layout", "region").agg(
        F.count(F.lit(1)).alias("cells"), F.sum(F.expr("cast(revenue as decimal(18,4))"))
        .cast("double").alias("revenue"))
    return rounded(laid, 4, "revenue")


@job("causal_effects")
def causal_effects(e: Estate) -> DataFrame:
    out = tested(e).select("finding_id", "doc_id", "effect", "control_change", "did", "pre_trend",
                           "usable_regions", "responding")
    return rounded(out, 6, "effect", "control_change", "did", "pre_trend")


@job("placebo")
def placebo(e: Estate) -> DataFrame:
    return rounded(tested(e).select("finding_id", "doc_id", "placebo_count", "placebo_max"),
                   6, "placebo_max")


@job("causal_tests")
def causal_tests(e: Estate) -> DataFrame:
    return tested(e).select("finding_id", "doc_id", *causal.TESTS)


@job("verdicts")
def verdicts(e: Estate) -> DataFrame:
    return tested(e).select("finding_id", "doc_id", "candidate_id", "state", "reason")
