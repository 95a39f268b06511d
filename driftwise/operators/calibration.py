"""Scores turned into probabilities by isotonic regression, fitted in pooled ranges.

Outcomes are folded per score and sorted into ranges. Each range pools neighbouring scores
whose rates fall (the convex minorant of its running sums); the pools of all ranges, far
fewer than the outcomes, are pooled once more in order. Pooling may be done in any order, so
this is the fit of all outcomes. With n outcomes of two kinds there are at most about
n ** (2/3) different rising rates, which bounds the last step.

Too few outcomes, a single class, or a curve that does not lower the squared error leave
every probability null. Nothing is fitted or looked at while the plan is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.operators.confidence import MIN_OUTCOMES

#: Equal cells of [0, 1] in which scores and pieces of the curve meet.
CELLS = 1024
POOL = "lo double, hi double, n double, hits double"
PIECE = "lo double, hi double, value double, next_lo double, next_value double, n double, hits double"


def _pooled(rows: Iterator[tuple]) -> list[list[float]]:
    """Neighbours joined until the rates rise."""
    pools: list[list[float]] = []
    for lo, hi, n, hits in rows:
        pools.append([lo, hi, n, hits])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            _, hi, n, hits = pools.pop()
            last = pools[-1]
            last[1], last[2], last[3] = hi, last[2] + n, last[3] + hits
    return pools


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pools = _pooled(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in (zip(*pools) if pools else [[]] * 4)], ["lo", "hi", "n", "hits"])


def _curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pools = _pooled(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    rows = [(lo, hi, hits / n, *((after[0], after[3] / after[2]) if after else (None, None)), n, hits)
            for (lo, hi, n, hits), after in zip(pools, [*pools[1:], None], strict=True)] if pools else []
    names = [c.split()[0] for c in PIECE.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in (zip(*rows) if rows else [[]] * 7)], names)


def curve(outcomes: DataFrame, parts: int | None = None) -> DataFrame:
    """The rising steps (lo, hi, value) of (confidence, correct), each with the step after it."""
    parts = parts or int(outcomes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folded = outcomes.groupBy(F.col("confidence").cast("double").alias("lo")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.count_if("correct").cast("double").alias("hits"))
    ranged = folded.select("lo", F.col("lo").alias("hi"), "n", "hits").repartitionByRange(parts, "lo").sortWithinPartitions("lo")
    return ranged.mapInArrow(_ranges, POOL).repartition(1).sortWithinPartitions("lo").mapInArrow(_curve, PIECE)


def usable(outcomes: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row: whether the curve may be used, and the squared error without and with it."""
    label = F.when(F.col("correct"), 1.0).otherwise(0.0)
    told = outcomes.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("correct").alias("classes"),
                        F.avg(F.pow(F.col("confidence") - label, 2)).alias("before"))
    # Over a step, the sum of (label - value)^2 for labels of 0 and 1.
    left = F.sum(F.col("hits") - 2 * F.col("value") * F.col("hits") + F.col("n") * F.col("value") * F.col("value"))
    after = pieces.agg((left / F.sum("n")).alias("after"))
    return told.crossJoin(after).select(
        "before", "after", ((F.col("n") >= MIN_OUTCOMES) & (F.col("classes") == 2) & (F.col("after") <= F.col("before"))).alias("usable"))


def calibrated(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """cases with a probability beside their confidence, read off the curve of the outcomes.

    Between two steps the curve is a straight line, and beyond its ends it stays level. Cases and steps
    meet in cells of the scores; a step has a row per cell up to the next step's beginning.
    """
    pieces = curve(outcomes)
    cell = lambda x: F.least(F.greatest(F.floor(x * CELLS), F.lit(0)), F.lit(CELLS)).cast("int")
    first = F.min("lo").alias("lo"), F.min_by("value", "lo").alias("value")
    laid = pieces.withColumn("cell", F.explode(F.sequence(
        cell(F.col("lo")), F.when(F.col("next_lo").isNull(), F.lit(CELLS)).otherwise(cell(F.col("next_lo")))))).select("lo", "hi", "value", "next_lo", "next_value", "cell")
    start = pieces.agg(*first).select(F.col("lo").alias("start"), F.col("value").alias("start_value"))
    x = F.col("confidence").cast("double")
    placed = cases.withColumns({"__x": x, "__cell": cell(x)})
    within = (F.col("__cell") == F.col("cell")) & (F.col("__x") >= F.col("lo")) & (F.col("next_lo").isNull() | (F.col("__x") < F.col("next_lo")))
    slope = (F.col("next_value") - F.col("value")) / (F.col("next_lo") - F.col("hi"))
    read = F.when((F.col("__x") <= F.col("hi")) | F.col("next_lo").isNull(), F.col("value")).otherwise(
        F.col("value") + slope * (F.col("__x") - F.col("hi")))
    told = placed.join(laid, within, "left").crossJoin(F.broadcast(start)).crossJoin(F.broadcast(usable(outcomes, pieces).select("usable")))
    value = F.when(F.col("__x") < F.col("start"), F.col("start_value")).otherwise(read)
    return told.select(*[F.col(f"`{c}`") for c in cases.columns], F.when(F.col("usable"), value).alias("probability"))
