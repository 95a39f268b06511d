"""Jobs over documents, notes, conversations and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.functions import text as words
from driftwise.functions.columns import pick
from driftwise.operators import corroboration as search
from driftwise.operators import latent
from driftwise.operators.candidates import alike
from driftwise.plans.cause_jobs import SALES_SCOPE, tested
from driftwise.plans.registry import job
from driftwise.plans.series_jobs import ENTITLED, rounded
from driftwise.session import written
from driftwise.sources.estate import Estate

# Words too common to tell texts apart, for the four languages of the estate.
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "for", "that", "with", "on", "as", "at", "by",
              "it", "an", "are", "this", "from", "be", "or", "le", "la", "de", "les", "des", "et",
              "un", "une", "der", "die", "das", "und", "el", "los", "las", "en", "que", "por")
FLAG_ROWS = ("pii", "location")
TOP = 12
FLOOR = 0.15
# For stages with a row per word of a text.
COMPACT = {"compression": "zstd"}


@job("sentences")
def sentences(e: Estate) -> DataFrame:
    rows = search.sentence_rows(e.documents())
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sentences"), F.max("end").alias("last_end"),
        F.sum(F.expr("start * (pos + 1)")).alias("start_sum"),
        F.sum(F.expr("end * (pos + 1)")).alias("end_sum"))


def passages(e: Estate) -> DataFrame:
    """Benchmark passages as searches, each over its own year and a half."""
    lo = F.expr("timestamp_ntz'1996-01-01 00:00:00' + make_dt_interval(cast(item_id * 30 % 1200 as int))")
    return e.table("benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), lo.alias("lo")) \
        .withColumn("hi", F.col("lo") + F.expr("interval 540 days"))


def word_counts(e: Estate) -> DataFrame:
    """Word counts of every document, kept as a stage: split once, searched often."""
    return e.stage("word_counts", lambda: search.batched_counts(e.documents(), "text", STOP_WORDS), COMPACT)


def word_weights(e: Estate) -> DataFrame:
    return e.stage("word_weights", lambda: search.inverse_frequency(word_counts(e), e.documents()), COMPACT)


def postings(e: Estate) -> DataFrame:
    """Every document's weighted words, kept as a stage."""
    return e.stage("postings", lambda: search.postings(word_counts(e), word_weights(e)), COMPACT)


def passage_matches(e: Estate) -> DataFrame:
    return search.ranked_matches(passages(e), e.documents(), STOP_WORDS, 5, FLOOR, word_counts(e), word_weights(e), postings(e))


@job("tfidf_topk")
def tfidf_topk(e: Estate) -> DataFrame:
    out = passage_matches(e)
    return rounded(out, 6, "score")


@job("best_sentence")
def best_sentence(e: Estate) -> DataFrame:
    matches = e.stage("passage_matches", lambda: passage_matches(e))
    out = search.best_sentences(matches, passages(e), e.documents(), STOP_WORDS, word_counts(e), word_weights(e))
    return out.select("query_id", "doc_id", "start", "end", F.sha2("quote", 256).alias("quote"))


@job("vector_topk")
def vector_topk(e: Estate) -> DataFrame:
    """Nearest vectors to the middle of each label."""
    rows = e.table("embeddings")
    middle = (
        rows.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
        .groupBy("label", "pos").agg(F.avg("x").alias("x"))
        .groupBy(F.col("label").alias("query_id"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
             .alias("vector"))
    )
    out = search.nearest(middle, rows.select("vec_id", F.col("embedding").alias("vector")), 10)
    return rounded(out, 6, "score")


DIRECTIONS = 8


def desk_rows(e: Estate) -> DataFrame:
    """The words of each kind of document in each region, as rows of length 1."""
    return latent.unit_rows(desk_words(e), ["desk"])


def desk_words(e: Estate) -> DataFrame:
    """Word counts of each kind of document in each region, kept as a stage: every use would join all documents again."""
    def build() -> DataFrame:
        desks = e.documents().select("doc_id", F.concat_ws("/", "region", "doc_type").alias("desk"))
        return word_counts(e).join(desks, "doc_id").groupBy("desk", "token").agg(F.sum("tf").alias("tf"))

    return e.stage("desk_words", build)


@job("latent_values")
def latent_values(e: Estate) -> DataFrame:
    """The strongest directions of what the regions' desks write."""
    values, _, _ = latent.latent(desk_rows(e), "desk", DIRECTIONS)
    return e.spark.createDataFrame([(i + 1, round(v, 6)) for i, v in enumerate(values)], "direction int, strength double")


@job("latent_neighbours")
def latent_neighbours(e: Estate) -> DataFrame:
    """The desks that write most alike, by latent vectors."""
    _, rows, _ = latent.latent(desk_rows(e), "desk", DIRECTIONS)
    return rounded(latent.nearest(rows, "desk", 4), 6, "score")


@job("complaint_query")
def complaint_query(e: Estate) -> DataFrame:
    return e.notes().select("doc_id", words.complaint_query(F.col("text")).alias("query"))


@job("rule_extract")
def rule_extract(e: Estate) -> DataFrame:
    return search.readings(e.notes(), SALES_SCOPE)


@job("issue_counts")
def issue_counts(e: Estate) -> DataFrame:
    return search.readings(tickets(e), {}).groupBy("issue").agg(F.count(F.lit(1)).alias("tickets"))


def verified(e: Estate) -> DataFrame:
    return tested(e).filter("state = 'verified'")


def supported(e: Estate) -> DataFrame:
    """Every verified candidate with what the tickets say about it, as a stage."""
    return e.stage("supported", lambda: support_all(e, verified(e)))


def tickets(e: Estate) -> DataFrame:
    return e.notes().filter("doc_type = 'support_ticket'")


def ticket_words(e: Estate) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts, weights and postings of the tickets' words, kept as stages: each is read several times."""
    counts = e.stage("ticket_counts", lambda: search.term_counts(tickets(e), ("doc_id", "ts"), "text", STOP_WORDS))
    idf = e.stage("ticket_weights", lambda: search.inverse_frequency(counts, tickets(e)))
    return counts, idf, e.stage("ticket_postings", lambda: search.postings(counts, idf))


def support_all(e: Estate, causes: DataFrame) -> DataFrame:
    """What the tickets say about each cause; causes that search for the same words in the same days do so once.

    All tickets are searched; only those that a search found are then read for what they report.
    """
    ids = F.concat_ws("|", "finding_id", "doc_id")
    asked = causes.select(
        "finding_id", "doc_id", ids.alias("query_id"), words.complaint_query(F.col("description")).alias("query"),
        F.col("start").cast("timestamp_ntz").alias("lo"),
        (F.col("end").cast("timestamp_ntz") + F.expr("interval '23:59:59.999999' hour to second"))
        .alias("hi"),
        search.expected_issues(words.issue_of(F.col("description"))).alias("expected"))
    named = alike(asked, ("query_id",), ("query", "lo", "hi", "expected"))
    kinds = named.select(F.col("_kind").alias("query_id"), "_nth", "query", "lo", "hi", "expected").distinct()
    matches = written(search.ranked_matches(
        kinds.drop("_nth", "expected"), tickets(e), STOP_WORDS, TOP, FLOOR, *ticket_words(e)), "ticket-matches")
    found = tickets(e).join(matches.select("doc_id").distinct(), "doc_id", "left_semi")
    safe = found.withColumn("flags", words.injection_flags(F.col("text"))).withColumn(
        "text", words.quarantined(F.col("text"), FLAG_ROWS))
    read = search.readings(safe, {}).select("doc_id", "issue").join(safe.select("doc_id", "flags"), "doc_id")
    counts = search.support(matches, kinds.select("query_id", "expected"), read).withColumnRenamed("query_id", "_kind")
    return named.select("_kind", "finding_id", "doc_id").join(counts, "_kind").drop("_kind")


@job("support_counts")
def support_counts(e: Estate) -> DataFrame:
    return supported(e)


def turns(e: Estate) -> DataFrame:
    return e.table("conversations").select(
        "conv_id", "turn", F.concat_ws(": ", "role", "text").alias("text"))


@job("injection_flags")
def injection_flags(e: Estate) -> DataFrame:
    return turns(e).select("conv_id", "turn", F.array_join(
        words.injection_flags(F.col("text")), ",").alias("flags"))


@job("redact")
def redact(e: Estate) -> DataFrame:
    out = words.redacted(e.documents(), ("pii",))
    return out.select("doc_id", F.sha2("text", 256).alias("text"),
                      F.array_join("masked", ",").alias("masked"))


@job("quarantine")
def quarantine(e: Estate) -> DataFrame:
    safe = e.documents().withColumn("flags", words.injection_flags(F.col("text"))) \
        .withColumn("safe", words.quarantined(F.col("text"), ("pii",)))
    return safe.select(
        "doc_id", F.array_join("flags", ",").alias("flags"), F.length("safe").alias("length"),
        F.sha2("safe", 256).alias("text"))


@job("citation_spans")
def citation_spans(e: Estate) -> DataFrame:
    quotes = e.table("benchmark").select("item_id", F.col("text").alias("quote"))
    return search.citations(quotes, e.documents())


# What each wording of the notes ought to be read as, by its place in the list.
EXPECTED = {0: ("checkout_failure",), 1: ("delivery_delay",), 3: ("stockout",), 4: ("pricing",),
            7: ("pricing",), 8: ("checkout_failure",), 9: ("delivery_delay",),
            10: ("checkout_failure", "payment_failure"), 11: ("quality",), 12: ("delivery_delay",),
            13: ("stockout",), 15: ("delivery_delay",)}


@job("extract_score")
def extract_score(e: Estate) -> DataFrame:
    labels = [",".join(EXPECTED.get(i, ())) for i in range(16)]
    number = F.regexp_extract("doc_id", r"(\d+)", 1).cast("bigint")
    items = e.notes().join(search.readings(e.notes(), {}).select("doc_id", "issue"), "doc_id").select(
        F.col("doc_type").alias("set"),
        F.filter(F.split(pick(labels, number), ","), lambda x: x != "").alias("expect"),
        F.when(F.col("issue") == "other", F.array().cast("array<string>"))
        .otherwise(F.array("issue")).alias("read"))
    return search.extraction_score(items)


@job("doc_view")
def doc_view(e: Estate) -> DataFrame:
    """Documents a reader of two regions may open: masked text, original flags."""
    seen = e.documents().filter(F.col("region").isin(*ENTITLED, "All")) \
        .withColumn("flags", words.injection_flags(F.col("text")))
    return words.redacted(seen, ("pii",)).select(
        "doc_id", "doc_type", "region", F.length("text").alias("length"),
        F.array_join("flags", ",").alias("flags"), F.sha2("text", 256).alias("text"))
