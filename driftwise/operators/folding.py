"""One event, one row: findings of kin metrics that move together fold into one.

Findings are ordered by weight: the larger impact first. Each one joins the event of the
heaviest founder among those in which a heavier finding of a kin metric overlaps it and no
heavier finding has its own metric; without such an event it founds one.

What a finding does follows from heavier findings alone. So all of them choose at once,
given what the others chose last; when a round changes nothing, every choice fits the
choices of the heavier findings, and by induction from the heaviest on there is only one
such state. A round is a few equality joins on findings and events, and the number of
rounds is the longest chain of choices that depend on one another, never a region's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.session import written

#: Days of the cells in which findings meet; any value gives the same links.
CELL_DAYS = 7
#: What orders findings, heaviest first; it tells any two of them apart.
WEIGHT = ("lightness", "kpi_id", "start", "end", "direction", "region")


def kin_pairs(ancestors: DataFrame) -> DataFrame:
    """(kpi_id, kin) both ways for every (kpi_id, ancestor)."""
    up = ancestors.select("kpi_id", F.col("ancestor").alias("kin"))
    return up.unionByName(up.select(F.col("kin").alias("kpi_id"), F.col("kpi_id").alias("kin"))).distinct()


def weighed(findings: DataFrame) -> DataFrame:
    """Findings with their weight as one comparable value; the smallest is the heaviest."""
    return findings.withColumn("lightness", -F.col("impact")).withColumn("weight", F.struct(*WEIGHT)).drop("lightness")


def heavier_kin(found: DataFrame, kin: DataFrame) -> DataFrame:
    """(me, other): the heavier findings of kin metrics in the region that overlap each finding.

    Findings are laid out over the cells they touch and meet by region, cell and metric;
    of the cells that two share, only the first makes the pair.
    """
    cell = F.expr(f"explode(sequence(datediff(start, date'1970-01-01') div {CELL_DAYS},"
                  f" datediff(end, date'1970-01-01') div {CELL_DAYS}))")
    laid = found.select("region", "kpi_id", "start", "end", "weight", cell.alias("cell"))
    mine = laid.join(kin, "kpi_id").select(
        "region", "cell", F.col("kin").alias("kpi_id"), F.col("start").alias("my_start"), F.col("end").alias("my_end"),
        F.col("weight").alias("me"))
    first = F.expr(f"datediff(greatest(start, my_start), date'1970-01-01') div {CELL_DAYS}")
    return mine.join(laid, ["region", "cell", "kpi_id"]).filter(
        (F.col("weight") < F.col("me")) & (F.col("start") <= F.col("my_end")) & (F.col("my_start") <= F.col("end"))
        & (F.col("cell") == first)).select("me", F.col("weight").alias("other"))


def chosen(links: DataFrame, home: DataFrame) -> DataFrame:
    """(me, home) of the next round from the (me, home) of the last one."""
    first = home.groupBy("home", F.col("me.kpi_id").alias("kpi_id")).agg(F.min("me").alias("first"))
    open_to = links.join(home.toDF("other", "home"), "other").select("me", "home", F.col("me.kpi_id").alias("kpi_id")).distinct()
    free = open_to.join(first, ["home", "kpi_id"], "left").filter(F.col("first").isNull() | (F.col("first") >= F.col("me")))
    best = free.groupBy("me").agg(F.min("home").alias("best"))
    return home.join(best, "me", "left").select("me", F.coalesce("best", "me").alias("home"), F.col("home").alias("last"))


def events(found: DataFrame, kin: DataFrame) -> DataFrame:
    """(me, home) of every finding: its weight and that of its event's founder."""
    links = written(heavier_kin(found, kin), "links")
    linked = links.select("me").union(links.select("other")).distinct()
    home, moved = linked.select("me", F.col("me").alias("home")), True
    while moved:
        nxt = written(chosen(links, home), "homes")
        home, moved = nxt.select("me", "home"), nxt.filter("home <> last").limit(1).count() > 0
    return found.select(F.col("weight").alias("me")).join(home, "me", "left").select("me", F.coalesce("home", "me").alias("home"))


def fold(findings: DataFrame, ancestors: DataFrame) -> DataFrame:
    """One row per event: its finding nearest the top of the metric graph, and the other metrics that moved.

    findings: region, kpi_id, direction, start, end, impact; ancestors: every (kpi_id, ancestor).
    An event has at most one finding of a metric, so its list is bounded by the metric graph.
    """
    found = weighed(findings)
    height = ancestors.groupBy("kpi_id").agg(F.count_distinct("ancestor").alias("above"))
    placed = events(found, kin_pairs(ancestors)).withColumn("kpi_id", F.col("me.kpi_id")).join(height, "kpi_id", "left")
    folded = placed.groupBy("home").agg(
        F.min(F.struct(F.coalesce("above", F.lit(0)).alias("above"), F.col("me"))).alias("head"), F.collect_set("kpi_id").alias("moved"))
    head = F.col("head.me")
    return folded.select(
        head["region"].alias("region"), head["kpi_id"].alias("kpi_id"), head["direction"].alias("direction"),
        head["start"].alias("start"), head["end"].alias("end"), (-head["lightness"]).alias("impact"),
        F.array_sort(F.array_remove("moved", head["kpi_id"])).alias("also_moved"))
