"""Pruned retrieval gives what comparing everything gives, and reads little."""

import datetime as dt
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from driftwise.operators import corroboration as search

DAY0 = dt.datetime(2021, 5, 1)
DOCS, ASKED = "doc_id long, ts timestamp_ntz, text string", "query_id long, query string, lo timestamp_ntz, hi timestamp_ntz"


def estate(seed, documents=150):
    """Texts with a word in all of them, words in many and in few; queries over windows of all lengths."""
    r = random.Random(seed)
    words = ["w%03d" % i for i in range(120)]
    draw = lambda n: " ".join(["hot"] * r.randint(0, 3) + [words[min(119, int(r.expovariate(0.05)))] for _ in range(n)])
    docs = [(i, DAY0 + dt.timedelta(hours=r.randrange(24 * 700)), draw(r.randint(1, 25))) for i in range(documents)]
    docs += [(1000, DAY0, ""), (1001, DAY0, None), (1002, docs[0][1], docs[0][2])]
    asked = []
    for q in range(25):
        lo = DAY0 + dt.timedelta(days=r.randrange(500))
        asked.append((q, draw(r.randint(1, 6)) if q % 3 else r.choice(docs[:100])[2], lo, lo + dt.timedelta(days=r.choice([0, 5, 100, 400]))))
    return docs, asked + [(99, "nothing known", DAY0, DAY0), (98, None, DAY0, DAY0)]


def weights(docs, asked):
    bags = {i: Counter((t or "").split()) for i, _, t in docs}
    df = Counter(w for b in bags.values() for w in b)
    idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items()}

    def unit(bag):
        raw = {w: (1 + math.log(n)) * idf[w] for w, n in bag.items() if w in idf}
        size = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / size for w, x in raw.items()}

    return {i: unit(b) for i, b in bags.items()}, {q: unit(Counter((t or "").split())) for q, t, *_ in asked}


@pytest.mark.parametrize(("seed", "floor"), [(1, 0.15), (2, 0.4), (3, 0.0)])
def test_same_rows_as_scoring_every_pair(spark, seed, floor):
    docs, asked = estate(seed)
    of, want = weights(docs, asked), {}
    for q, _, lo, hi in asked:
        score = {i: sum(x * of[0][i].get(w, 0) for w, x in of[1][q].items()) for i, ts, _ in docs if lo <= ts <= hi and set(of[0][i]) & set(of[1][q])}
        best = sorted((round(-s, 9), i) for i, s in score.items() if s >= floor)[:5]
        want |= {(q, n + 1, i): pytest.approx(-s, abs=1e-8) for n, (s, i) in enumerate(best)}
    got = search.ranked_matches(spark.createDataFrame(asked, ASKED), spark.createDataFrame(docs, DOCS), ["the"], 5, floor)
    assert {(r.query_id, r.rank, r.doc_id): r.score for r in got.collect()} == want and len(want) > 10


def test_words_of_all_documents_make_no_pairs(spark):
    """Each query has the common word and one of its own: pairs stay with the own word's documents."""
    docs = [(i, DAY0, "common " + " ".join(f"rare{i % 40} other{i}" for _ in range(2))) for i in range(400)]
    asked = [(q, f"common common rare{q}", DAY0, DAY0) for q in range(40)]
    frame = spark.createDataFrame(docs, DOCS)
    counts = search.term_counts(frame, ("doc_id", "ts"), "text", ["the"])
    idf = search.inverse_frequency(counts, frame)
    said = search.weighted(search.term_counts(spark.createDataFrame(asked, ASKED), ("query_id", "lo", "hi"), "query", ["the"]), idf)
    size = said.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    unit = said.join(size, "query_id").withColumn("w", F.col("w") / F.col("size"))
    pairs = search.candidates(unit, search.postings(counts, idf), 0.15).collect()
    assert len(pairs) == 400, "ten documents for each query, not four hundred"
    by = defaultdict(set)
    for p in pairs:
        by[p.query_id].add(p.doc_id % 40)
    assert all(kinds == {q} for q, kinds in by.items())


def test_vectors_meet_in_heaps(spark, monkeypatch):
    r = random.Random(6)
    vectors = [(i, [r.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(300)] + [(900, None)]
    vectors = [(i, v if v and any(v) else None) for i, v in vectors]
    queries = [("q%d" % i, [r.random() - 0.3 for _ in range(3)]) for i in range(7)]
    table = spark.createDataFrame(vectors, "vec_id int, vector array<double>").repartition(5)
    asked = spark.createDataFrame(queries, "query_id string, vector array<double>")

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    want = set()
    for q, a in queries:
        best = sorted((-round(cosine(a, v), 9), i) for i, v in vectors if v and cosine(a, v) >= 0.0)[:4]
        want |= {(q, n + 1, i) for n, (_, i) in enumerate(best)}
    got = search.nearest(asked, table, 4)
    assert {(r.query_id, r.rank, r.vec_id) for r in got.collect()} == want
    units = asked.select("query_id", search.unit(F.col("vector")).alias("v")).collect()
    assert search.heaps(units, table, 4, 0.0, StringType()).count() <= 5 * 7 * 4
    monkeypatch.setattr(search, "HELD", 3)
    beyond = search.nearest(asked, table.filter("vector is not null"), 4, blocks=2)
    assert {(r.query_id, r.rank, r.vec_id) for r in beyond.collect()} == want
    monkeypatch.undo()
    assert search.nearest(asked.limit(0), table, 4).count() == 0 and search.nearest(asked, table.limit(0), 4).count() == 0
