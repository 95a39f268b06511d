"""Queries and documents meet in groups of a cell of time, and only each group's best move on."""

import datetime as dt
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftwise.functions import text as words
from driftwise.operators import corroboration as search
from driftwise.plans import text_jobs
from driftwise.sources.estate import Estate

DAY0 = dt.datetime(2021, 5, 1)
DOCS, ASKED = "doc_id string, ts timestamp_ntz, text string", "query_id string, query string, lo timestamp_ntz, hi timestamp_ntz"


def unit(spark, queries, docs):
    """Query words of length 1 and postings."""
    counts = search.term_counts(docs, ("doc_id", "ts"), "text", ["the"])
    idf = search.inverse_frequency(counts, docs)
    said = search.weighted(search.term_counts(queries, ("query_id", "lo", "hi"), "query", ["the"]), idf)
    size = said.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return said.join(size, "query_id").withColumn("w", F.col("w") / F.col("size")), search.postings(counts, idf)


def test_each_group_hands_on_its_k_best(spark):
    """Two hundred equal texts match every query, but no group hands on more than three of them for it."""
    docs = spark.createDataFrame([(f"d{i:03d}", DAY0, "card declined at checkout") for i in range(200)]
                                 + [("far", DAY0, "parcel late again")], DOCS)
    queries = spark.createDataFrame([(f"q{i}", "card checkout", DAY0, DAY0) for i in range(6)], ASKED)
    asked, listed = unit(spark, queries, docs)
    met = search.meet(asked, listed, 0.15, 3, F.lit(4), F.lit(2))
    assert met.count() <= 6 * 4 * 3
    told = search.ranked_matches(queries, docs, ["the"], 3, 0.15).collect()
    assert sorted((r.query_id, r.rank, r.doc_id) for r in told) == [
        (f"q{q}", n + 1, f"d{n:03d}") for q in range(6) for n in range(3)]


def test_groups_do_not_change_the_matches(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", DAY0 + dt.timedelta(days=i * 7), f"w{i % 5} w{i % 7} all") for i in range(120)], DOCS)
    queries = spark.createDataFrame(
        [(f"q{i}", f"w{i % 7} w{i % 3} all", DAY0 + dt.timedelta(days=i * 20), DAY0 + dt.timedelta(days=i * 20 + 300)) for i in range(20)]
        + [("back", "w1 w2", DAY0 + dt.timedelta(days=300), DAY0), ("open", "w1", DAY0, None), (None, "w1", DAY0, DAY0)], ASKED)

    def rows():
        return {(r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in search.ranked_matches(queries, docs, ["the"], 4, 0.15).collect()}

    whole = rows()
    monkeypatch.setattr(search, "SHARD_DOCUMENTS", 9)
    monkeypatch.setattr(search, "SHARD_QUERIES", 4)
    assert rows() == whole and len(whole) > 40 and {q for q, *_ in whole} == {f"q{i}" for i in range(20)}


def test_a_document_filed_twice_is_one_match(spark):
    """All words of a document count, whichever of its times lies in the window."""
    docs = spark.createDataFrame([("a", DAY0, "card"), ("a", DAY0 + dt.timedelta(hours=2), "parcel"),
                                  ("a", DAY0 + dt.timedelta(days=400), "storm"), ("b", DAY0, "card parcel other")], DOCS)
    queries = spark.createDataFrame([("q", "card parcel storm", DAY0, DAY0 + dt.timedelta(days=1)),
                                     ("q", "card parcel storm", DAY0 + dt.timedelta(days=399), DAY0 + dt.timedelta(days=401))], ASKED)
    told = {r.doc_id: (r.rank, r.score) for r in search.ranked_matches(queries, docs, ["the"], 5, 0.15).collect()}
    assert set(told) == {"a", "b"} and told["a"][0] == 1 and told["a"][1] > told["b"][1]


def test_support_is_the_same_where_only_found_tickets_are_read(spark, tmp_path):
    events = [(i, DAY0 + dt.timedelta(minutes=i), i % 40, "error" if i % 9 else "view", float(i % 60), "{}") for i in range(600)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
        .write.parquet(f"{tmp_path}/events.parquet")
    e = Estate(spark, str(tmp_path))
    start = dt.date(1996, 1, 1)
    causes = spark.createDataFrame(
        [("f1", "n1", "INC-5: courier backlog after flooding, parcel arrived late", start, start + dt.timedelta(days=1800)),
         ("f2", "n2", "release 4.1: checkout flow rewritten, card declined on the website", start, start + dt.timedelta(days=900)),
         ("f3", "n3", "quite unheard of", start, start)],
        "finding_id string, doc_id string, description string, start date, end date")
    got = {r.finding_id: (r.searched, r.supporting, r.unrelated, r.flagged) for r in text_jobs.support_all(e, causes).collect()}

    tickets = text_jobs.tickets(e)
    safe = tickets.withColumn("flags", words.injection_flags(F.col("text"))).withColumn(
        "text", words.quarantined(F.col("text"), text_jobs.FLAG_ROWS))
    read = search.readings(safe, {}).select("doc_id", "issue").join(safe.select("doc_id", "flags"), "doc_id")
    subjects = causes.select(
        F.col("finding_id").alias("query_id"), words.complaint_query(F.col("description")).alias("query"),
        F.col("start").cast("timestamp_ntz").alias("lo"), (F.col("end").cast("timestamp_ntz") + F.expr("interval '23:59:59' hour to second")).alias("hi"),
        search.expected_issues(words.issue_of(F.col("description"))).alias("expected"))
    found = search.ranked_matches(subjects, tickets, text_jobs.STOP_WORDS, text_jobs.TOP, text_jobs.FLOOR)
    want = {r.query_id: (r.searched, r.supporting, r.unrelated, r.flagged) for r in search.support(found, subjects, read).collect()}
    assert got == want and got["f1"][0] == text_jobs.TOP
    counts, _, listed = text_jobs.ticket_words(e)
    assert listed.count() == counts.count() and "ticket_postings" in listed.inputFiles()[0]


TEXTS = [("a", DAY0, "card Card lost, the parcel"), ("b", DAY0, ""), ("c", DAY0, None), ("d", DAY0, "Größe größe the 42 x"),
         ("e", None, "undated card"), (None, DAY0, "nameless card"), ("f", DAY0, "card parcel"), ("f", DAY0, "card storm"),
         ("f", DAY0 + dt.timedelta(days=400), "flood"), (None, DAY0, "nameless again"), ("g", DAY0, "the")]


def moves(frame):
    """What the plan deals rows out by."""
    return re.findall(r"hashpartitioning\(([^)]*)\)", frame._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("texts", [TEXTS, TEXTS[:6]])
def test_words_counted_where_they_lie_are_the_same(spark, monkeypatch, texts):
    monkeypatch.setattr(search, "BATCH_LETTERS", 30)
    docs = spark.createDataFrame(texts, DOCS).repartition(2)
    got = search.written(search.batched_counts(docs, "text", ["the"]), "counts").collect()
    want = search.term_counts(docs, ("doc_id", "ts"), "text", ["the"]).collect()
    key = lambda r: (r.doc_id or "", str(r.ts), r.token, r.tf)
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) > 8
    of = {}
    for r in got:
        assert of.setdefault(r.doc_id, r.batch) == r.batch
    assert len(set(of.values())) > 1


def test_words_of_documents_do_not_move_to_be_counted(spark, tmp_path):
    """A document with one row is counted where it lies: no word is dealt out, neither then nor to be weighed."""
    spark.createDataFrame([(i, f"w{i} w{i % 7} all", "en", f"s{i}", 9) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars int") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "w1 w2")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    e = Estate(spark, str(tmp_path))
    assert not moves(search.batched_counts(e.documents(), "text", ["the"]))
    assert moves(search.term_counts(e.documents(), ("doc_id", "ts"), "text", ["the"])), "else the plan is misread"
    counts, idf = text_jobs.word_counts(e), text_jobs.word_weights(e)
    assert not any("doc_id" in by for by in moves(search.postings(counts, idf)))
    assert text_jobs.postings(e).count() == counts.count()
    assert {r.doc_id for r in text_jobs.tfidf_topk(e).collect()} <= set(range(60))


def test_only_searched_words_are_dealt_to_groups(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", DAY0, f"card own{i}") for i in range(30)], DOCS)
    queries = spark.createDataFrame([("q", "card page", DAY0, DAY0)], ASKED)
    asked, listed = unit(spark, queries, docs)
    plan = lambda: search.meet(asked, listed, 0.15, 3)._jdf.queryExecution().analyzed().toString()
    rows = lambda: sorted((r.doc_id, round(r.score, 9)) for r in search.meet(asked, listed, 0.0, 40).collect())
    assert "LeftSemi" in plan()
    few = rows()
    monkeypatch.setattr(search, "WORDS_HELD", 0)
    assert "LeftSemi" not in plan() and rows() == few and len(few) == 30


def test_postings_are_the_same_in_any_batches(spark):
    docs = spark.createDataFrame([t for t in TEXTS if t[0]] + [(f"x{i}", DAY0, f"card w{i % 3} w{i}") for i in range(50)], DOCS)
    counts = search.term_counts(docs, ("doc_id", "ts"), "text", ["the"])
    idf = search.inverse_frequency(counts, docs)

    def rows(frame):
        listed = search.postings(frame, idf).withColumn("w", search.unit_weight())
        return sorted((r.doc_id, str(r.ts), str(r.span), r.token, round(r.w, 12), str(sorted(r.times or [r.ts], key=str))) for r in listed.collect())

    one = rows(counts.withColumn("batch", F.lit(7)))
    assert one == rows(counts) == rows(counts.withColumn("batch", F.ascii("doc_id"))) and len(one) == counts.count()
    plain = search.weighted(counts, idf)
    size = {r.doc_id: r.n for r in plain.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n")).collect()}
    assert {(d, ts, t): w for d, ts, _, t, w, _ in one} == {
        (r.doc_id, str(r.ts), r.token): pytest.approx(r.w / size[r.doc_id], abs=1e-11) for r in plain.collect()}
    assert len({n for d, *_, n in one if d == "f"}) == 1


def test_bags_keep_every_row(monkeypatch):
    """Batches that lie in one place are packed whole; mixed ones in pieces, with no row lost."""
    def rows(batch):
        return pa.RecordBatch.from_pydict({"doc_id": [f"d{b}" for b in batch], "token": [f"w{i % 3}" for i in range(len(batch))],
                                           "batch": pa.array(batch, pa.int64())})

    monkeypatch.setattr(search, "BATCH_ROWS", 6)
    for laid, most in (([[1, 1, 1], [1, 1], [2, 2], [2, 2, 2], [3]], 1), ([[1, 2, 3], [3, 2, 1], [1, 2, 3], [2, 2, 2]], 2)):
        got = [(b, search._opened(bag)) for out in search._bags(map(rows, laid)) for b, bag in zip(out["batch"].to_pylist(), out["bag"])]
        assert sorted(b for b, t in got for _ in range(t.num_rows)) == sorted(sum(laid, []))
        assert all(set(t["doc_id"].to_pylist()) == {f"d{b}"} for b, t in got)
        assert max([b for b, _ in got].count(b) for b in (1, 2, 3)) <= most
