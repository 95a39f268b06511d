"""Candidate causes from the record, and whether each could matter to a finding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwise.config import (
    LAG_TOLERANCE_DAYS,
    LEAD_TOLERANCE_DAYS,
    NOTE_WINDOW_DAYS,
    PLAN_WINDOW_DAYS,
)
from driftwise.functions import text as words

NOTE_KINDS = ("release_log", "ops_note")
SCOPE = ("channel", "device", "category", "sku")


def is_remediation(text: Column) -> Column:
    return text.rlike(words.REMEDIATION)


def read_notes(notes: DataFrame, skus: DataFrame,
               scope_terms: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Each operational note once: identifier, exposure and scope.

    Notes are read before they are matched to findings, so a note near many
    findings is parsed one time only. Product codes are matched by equality on
    their letters and digits, not by trying every code on every note.
    """
    own = notes.filter(F.col("doc_type").isin(*NOTE_KINDS) & ~is_remediation(F.col("text")))
    region = F.when((F.col("region") == "All") | F.col("region").isNull(),
                    F.array().cast("array<string>")).otherwise(F.array("region"))
    parsed = own.select(
        "doc_id", F.col("doc_type").alias("kind"), F.to_date("ts").alias("start"),
        words.identifier(F.col("text"), F.col("doc_id")).alias("candidate_id"),
        region.alias("exposed"), F.col("text").alias("description"),
        *[words.longest_term(F.col("text"), terms).alias(dim) for dim, terms in scope_terms.items()],
    )
    return parsed.join(sku_mentions(own, skus), "doc_id", "left")


def sku_mentions(notes: DataFrame, skus: DataFrame) -> DataFrame:
    """The longest known product code each note names."""
    joined_up = F.regexp_replace("text", r"(?<=[A-Za-z])[-_ ](?=\d)", "")
    fused = F.regexp_replace(joined_up, r"(?<=\d)[-_ ](?=[A-Za-z])", "")
    tokens = F.array_distinct(F.concat(
        F.regexp_extract_all(joined_up, F.lit(r"[A-Za-z0-9]+"), F.lit(0)),
        F.regexp_extract_all(fused, F.lit(r"[A-Za-z0-9]+"), F.lit(0))))
    spoken = (
        notes.select("doc_id", F.explode(tokens).alias("token")).filter(F.col("token").rlike(r"\d"))
        .select("doc_id", F.lower(F.regexp_extract("token", r"^(.*\d)[A-Za-z]*$", 1)).alias("code"))
    )
    known = skus.select(
        "sku", F.lower(F.regexp_replace("sku", r"[^A-Za-z0-9]", "")).alias("code")).distinct()
    return spoken.join(known, "code").groupBy("doc_id").agg(
        F.max_by("sku", F.struct(F.length("sku"), F.col("sku"))).alias("sku"))


def note_candidates(findings: DataFrame, parsed: DataFrame) -> DataFrame:
    """Notes dated from ten days before each finding to its end.

    Findings are spread to days and matched to notes on the day.
    """
    days = findings.select(
        "finding_id", F.col("region").alias("finding_region"), F.col("start").alias("finding_start"),
        F.col("end").alias("finding_end"),
        F.explode(F.sequence(F.date_sub("start", NOTE_WINDOW_DAYS), F.col("end"))).alias("start"))
    return days.join(parsed, "start").withColumn("end", F.col("finding_end"))


def plan_candidates(findings: DataFrame, plan: DataFrame, kind: str = "promotion",
                    id_column: str = "promo_id", active: str = "promo_active") -> DataFrame:
    """Plan entries active from two weeks before each finding to its end."""
    running = plan.filter(F.coalesce(F.col(active), F.lit(False))).select(
        "week", F.col(id_column).alias("candidate_id"), F.col("region").alias("_region"),
        F.col("category").alias("_category")).distinct()
    days = findings.select(
        "finding_id", F.col("region").alias("finding_region"), F.col("start").alias("finding_start"),
        F.col("end").alias("finding_end"),
        F.explode(F.sequence(F.date_sub("start", PLAN_WINDOW_DAYS), F.col("end"))).alias("week"))
    grouped = days.join(running, "week").groupBy(
        "finding_id", "finding_region", "finding_start", "finding_end", "candidate_id").agg(
        F.min("week").alias("first_week"),
        F.array_sort(F.collect_set("_region")).alias("exposed"),
        F.collect_set("_category").alias("_categories"))
    nothing = F.lit(None).cast("string")
    return grouped.select(
        "finding_id", "finding_region", "finding_start", "finding_end",
        F.col("candidate_id").alias("doc_id"), F.lit(kind).alias("kind"),
        F.greatest("first_week", F.date_sub("finding_start", PLAN_WINDOW_DAYS)).alias("start"),
        F.col("finding_end").alias("end"), "candidate_id", "exposed",
        F.concat(F.lit("Promotion "), F.col("candidate_id"), F.lit(" active in "),
                 F.array_join("exposed", ", ")).alias("description"),
        nothing.alias("channel"), nothing.alias("device"),
        F.when(F.size("_categories") == 1, F.element_at("_categories", 1)).alias("category"),
        nothing.alias("sku"))


def relevance(candidates: DataFrame, slice_: Mapping[str, str] | None = None) -> DataFrame:
    """Keep or set aside each candidate; the first failing gate is the reason."""
    early = F.date_sub("finding_start", LEAD_TOLERANCE_DAYS)
    late = F.date_add("finding_end", LAG_TOLERANCE_DAYS)
    reason = (
        F.when(F.col("end") < early, "ended before the movement began")
        .when(F.col("start") > late, "began after the movement ended")
        .when(F.col("finding_region").isNotNull() & (F.size("exposed") > 0)
              & ~F.array_contains("exposed", F.col("finding_region")),
              F.concat(F.lit("was confined to "), F.array_join("exposed", ", ")))
    )
    for dim, value in (slice_ or {}).items():
        reason = reason.when(F.col(dim).isNotNull() & (F.col(dim) != value),
                             F.concat(F.lit(f"was confined to {dim} "), F.col(dim)))
    return candidates.withColumn("set_aside", reason) \
        .withColumn("relevant", F.col("set_aside").isNull())


def remediations(parsed: DataFrame, notes: DataFrame) -> DataFrame:
    """The first undoing note on or after each candidate's start, and how many.

    Undoing notes are folded to one row per version and day before the join, so
    a version mentioned in a great many notes does not pair them all.
    """
    numbers = F.regexp_extract_all("text", F.lit(r"(\d+(?:\.\d+)*)"), F.lit(1))
    undone = (
        notes.filter(F.col("doc_type").isin(*NOTE_KINDS) & is_remediation(F.col("text")))
        .select("doc_id", F.to_date("ts").alias("on"), F.explode(F.array_distinct(numbers)).alias("number"))
        .select("doc_id", "on", F.explode(F.array_distinct(F.array(
            F.col("number"), F.expr("left(number, length(number) - 1)")))).alias("version"))
        .groupBy("version", "on")
        .agg(F.min("doc_id").alias("undone_by"), F.count_distinct("doc_id").alias("notes"))
    )
    wanted = parsed.select("doc_id", "candidate_id", "start",
                           words.version_of(F.col("candidate_id")).alias("version"))
    return (
        wanted.join(undone, "version").filter(F.col("on") >= F.col("start"))
        .groupBy("doc_id", "candidate_id", "start")
        .agg(F.min("on").alias("undone_on"), F.min_by("undone_by", F.struct("on", "undone_by"))
             .alias("undone_by"), F.sum("notes").alias("notes"))
    )


def alike(frame: DataFrame, keys: Sequence[str], asked: Sequence[str]) -> DataFrame:
    """The frame with ``_test``, ``_kind`` and ``_nth``: keys of one kind ask the same, and get the same answer.

    A row's test names what it asks, the columns ``asked``. A key's kind names the tests of all
    its rows, mostly one; ``_nth`` numbers them. So the distinct rows of (kind, test, nth) hold
    every kind once, however many keys are of it. A null key is of no kind.
    """
    own = Window.partitionBy(*keys)
    told = frame.withColumn("_test", F.md5(F.to_json(F.struct(*asked))))
    sums = [F.sum(F.xxhash64(F.lit(salt), "_test").cast("decimal(38,0)")).over(own) for salt in (1, 2)]
    rows = F.count(F.lit(1)).over(own)
    known = F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull()
    return told.withColumns({
        "_kind": F.when(known & (rows == 1), F.col("_test")).when(known, F.concat_ws("|", rows, *sums)),
        "_nth": F.row_number().over(own.orderBy("_test"))})
