"""Latent vectors against numpy's decomposition of the whole matrix."""

import numpy as np
import pytest

from driftwise.operators import latent
from driftwise.plans import text_jobs
from driftwise.sources.estate import Estate

ENTRY = "doc_id long, token string, w double"


def table(spark, matrix):
    rows = [(int(i), f"t{j}", float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix))]
    return spark.createDataFrame(rows, ENTRY).repartition(3)


def strong(rows, words, seed):
    """A sparse matrix with a few strong directions above noise."""
    r = np.random.default_rng(seed)
    parts = r.random((rows, 4)) @ (r.random((4, words)) * np.array([[9.0], [5.0], [3.0], [2.0]]))
    return (parts + r.random((rows, words)) * 0.05) * (r.random((rows, words)) < 0.8)


@pytest.mark.parametrize(("shape", "more", "rounds", "close"), [((15, 60), 12, 1, 1e-9), ((60, 90), 8, 6, 1e-4)])
def test_values_and_projections(spark, shape, more, rounds, close):
    matrix = strong(*shape, 3)
    values, rows, tokens = latent.latent(table(spark, matrix), "doc_id", 4, more, rounds)
    u, s, vt = np.linalg.svd(matrix, full_matrices=False)
    assert values == pytest.approx(s[:4], rel=close)
    mine = np.zeros((shape[0], 4))
    for r in rows.collect():
        mine[r.doc_id] = r.v
    theirs = u[:, :4] * s[:4]
    assert np.allclose(mine @ mine.T, theirs @ theirs.T, atol=close * s[0] ** 2)
    place = np.zeros((shape[1], 4))
    for r in tokens.collect():
        place[int(r.token[1:])] = r.v
    assert np.allclose(place.T @ place, np.eye(4), atol=1e-8)
    assert np.allclose(matrix @ place, mine, atol=1e-8)


def test_fewer_directions_than_wanted_and_none(spark):
    values, rows, _ = latent.latent(table(spark, np.outer([1.0, 2.0, 0.0], [1.0, 0.0, 2.0])), "doc_id", 4)
    assert values == pytest.approx([5.0]) and {r.doc_id: len(r.v) for r in rows.collect()} == {0: 1, 1: 1}
    values, rows, tokens = latent.latent(spark.createDataFrame([], ENTRY), "doc_id", 4)
    assert values == [] and rows.count() == 0 and tokens.count() == 0


def test_rows_have_length_one_and_nearest_is_itself(spark):
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 2), (2, "b", 1), (3, "c", 4), (3, "b", 1)], "doc_id long, token string, tf long")
    entries = latent.unit_rows(counts, ["doc_id"])
    size = {r.doc_id: r.s for r in entries.groupBy("doc_id").agg({"w": "count"}).withColumnRenamed("count(w)", "s").collect()}
    assert size == {1: 2, 2: 2, 3: 2}
    _, rows, _ = latent.latent(entries, "doc_id", 2)
    best = {(r.query_id, r.rank): (r.vec_id, r.score) for r in latent.nearest(rows, "doc_id", 2).collect()}
    assert best[1, 1] == (1, pytest.approx(1.0)) and best[1, 2] == (2, pytest.approx(1.0)) and best[3, 1][0] == 3


def test_desks_words_are_counted_once(spark, tmp_path):
    """Every use of the rows reads the kept counts, none the documents or their words again."""
    docs = [(i, f"source {i % 3}", text, "en", 20) for i, text in enumerate(("river stone river", "stone house", None, "", "water house house"))]
    spark.createDataFrame([*docs, docs[0]], "doc_id long, source string, text string, lang string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    e = Estate(spark, str(tmp_path))
    rows = text_jobs.desk_rows(e)
    assert all("desk_words" in f for f in rows.inputFiles())
    # A repeated document counts with both of its rows, each time.
    assert {(x.token, x.tf) for x in text_jobs.desk_words(e).collect()} == {("river", 8), ("stone", 4), ("stone", 1), ("house", 1), ("house", 2), ("water", 1)}
