"""Packing into optimal length buckets.

Texts are cut into pieces of at most ``longest`` words (nothing is dropped). Dynamic
programming over the global histogram of piece lengths, which has at most ``longest``
bars whatever the corpus, chooses the bucket bounds that minimise padding. Inside each
bucket, pieces in order of (doc_id, piece) fill batches of a fixed budget of padded
words.

Cases: null and blank texts have no words and give one empty piece in the smallest
bucket; repeated rows are packed each, in any order among themselves; a null id sorts
first; an empty table gives no batches; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwise.llm.common import ID, id_cuts, keyed, saved, slice_of, tasks, text_column

LONGEST = 2048
BUCKETS = 16
BUDGET = 65_536


def bucket_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The upper bounds, at most so many, under which padding to the bound is least.

    lengths ascend. Ties go to the earlier cut. The last bound is the largest length.
    """
    if not lengths:
        return []
    size, weight = np.array(lengths, np.int64), np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
    n = len(size)
    best = size * weight[1:]
    cuts = []
    for _ in range(min(buckets, n) - 1):
        total, from_cut = best.copy(), np.full(n, -1)
        for end in range(1, n):
            costs = best[:end] + size[end] * (weight[end + 1] - weight[1:end + 1])
            at = int(np.argmin(costs))
            if costs[at] < total[end]:
                total[end], from_cut[end] = costs[at], at
        best = total
        cuts.append(from_cut)
    bounds, end = [int(size[-1])], n - 1
    for from_cut in reversed(cuts):
        if from_cut[end] >= 0:
            end = int(from_cut[end])
            bounds.append(int(size[end]))
    return bounds[::-1]


def word_count(text: Column) -> Column:
    """Words are runs of anything but space and the controls tab to carriage return."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def pieces(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(id, doc_id, piece, first_word, n_tokens) covering every word of every document."""
    counted = keyed(docs).select(ID, "doc_id", word_count(text_column(docs)).alias("n"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / longest).cast("int") - 1)
    return counted.select(ID, "doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        ID, "doc_id", F.col("piece").cast("long").alias("piece"),
        (F.col("piece").cast("long") * longest).alias("first_word"),
        F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).cast("long").alias("n_tokens"))


def pack(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Every piece with its bucket bound, batch number inside the bucket, slot and padding."""
    cut = saved(pieces(docs, longest), "pieces")
    bars = cut.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").collect()
    bounds = bucket_bounds([r.n_tokens for r in bars], [r.n for r in bars], buckets) or [0]
    bound = F.coalesce(*[F.when(F.col("n_tokens") <= b, F.lit(b)) for b in bounds]).cast("long")
    sliced = cut.withColumns({"bucket": bound, "slice": slice_of(F.col(ID), id_cuts(cut, ID, tasks(cut.sparkSession)))})
    counts = sliced.groupBy("bucket", "slice").agg(F.count("*").alias("n"))
    before = W.partitionBy("bucket").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("bucket", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = sliced.withColumn("rank", F.row_number().over(
        W.partitionBy("bucket", "slice").orderBy(ID, "piece")))
    place = F.col("offset") + F.col("rank") - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket", F.lit(1)))).cast("long")
    return ranked.join(offsets, ["bucket", "slice"]).select(
        "doc_id", "piece", "first_word", "n_tokens", "bucket",
        F.floor(place / room).cast("long").alias("batch"), (place % room).cast("long").alias("slot"),
        (F.col("bucket") - F.col("n_tokens")).alias("padding"))
