"""Latent vectors of texts: the strongest directions of their tf-idf rows.

The matrix of rows (texts) and words stays a table of its entries. A sketch of a few more
columns than wanted, made from hashes of the words, is multiplied by it and by its transpose
in turn: a multiplication is a join of the entries with one side's vectors and a sum per key
of the other side. Between two of them the columns are made orthogonal through their Gram
matrix, of which each task adds up its own part; only matrices of a side's width, never a
side itself, come to the driver. Where the sketch is as wide as the matrix has rows the
result is exact; else each round shrinks what lies beyond the sketch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.operators import corroboration
from driftwise.session import written

#: Columns of the sketch beyond those wanted, and multiplications by matrix and transpose.
MORE, ROUNDS = 12, 4
#: Directions whose square is smaller than this part of the largest are nothing but rounding.
LEAST = 1e-20


def unit_rows(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, token, w): sublinear tf times idf over the rows that the keys name, each row of length 1."""
    idf = corroboration.inverse_frequency(counts, counts.select(*keys).distinct())
    rows = corroboration.weighted(counts, idf)
    size = rows.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return rows.join(size, list(keys)).select(*keys, "token", (F.col("w") / F.col("size")).alias("w"))


def _times(entries: DataFrame, side: DataFrame, on: str, to: str, width: int) -> DataFrame:
    """(to, v): the entries times one side's vectors."""
    met = entries.join(side, on)
    return met.groupBy(to).agg(F.array(*[F.sum(F.col("w") * F.get("v", F.lit(j))) for j in range(width)]).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def gram(side: DataFrame, width: int) -> np.ndarray:
    """The width x width products of a side's columns, added up per task first."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column(0), width)
            total += m.T @ m
        yield pa.RecordBatch.from_pydict({"cell": pa.array(range(width * width), pa.int32()), "x": pa.array(total.ravel())})

    cells = side.select("v").mapInArrow(part, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(width * width)
    for row in cells:
        out[row.cell] = row.x
    return (out.reshape(width, width) + out.reshape(width, width).T) / 2


def turned(side: DataFrame, key: str, by: np.ndarray) -> DataFrame:
    """Every vector of a side times a small matrix."""
    width, kept = by.shape

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1), width) @ by
            offsets = pa.array(np.arange(len(m) + 1) * kept, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(m.ravel()))], [key, "v"])

    kind = side.schema[key].dataType.simpleString()
    return side.select(key, "v").mapInArrow(turn, f"{key} {kind}, v array<double>")


def _directions(products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares of lengths, largest first, and directions; those of no length left out."""
    squares, ways = np.linalg.eigh(products)
    squares, ways = squares[::-1], ways[:, ::-1]
    kept = squares > LEAST * max(squares[0], 1e-300) if len(squares) else np.zeros(0, bool)
    return squares[kept], ways[:, kept]


def _straight(side: DataFrame, key: str, width: int) -> tuple[DataFrame, int]:
    """A side whose columns are orthogonal and of length 1, written, and how many are left."""
    squares, ways = _directions(gram(side, width))
    return written(turned(side, key, ways / np.sqrt(squares)), "latent"), len(squares)


def latent(entries: DataFrame, row: str, count: int, more: int = MORE, rounds: int = ROUNDS) -> tuple[list[float], DataFrame, DataFrame]:
    """Singular values, and (row, v) and (token, v) of entries (row, token, w).

    A row's v is its projection onto the strongest ``count`` directions, a token's v its place in them;
    an unseen text's entries times the tokens' v give its place among the rows.
    """
    entries, width = written(entries, "entries"), count + more
    sketch = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.xxhash64("token", j).cast("double") / F.lit(2.0**63))
    rows = written(entries.select(row, "token", "w", sketch.alias("v")).groupBy(row).agg(
        F.array(*[F.sum(F.col("w") * F.get("v", F.lit(j))) for j in range(width)]).alias("v")), "latent")
    tokens = entries.select("token", F.array().cast("array<double>").alias("v")).limit(0)
    for _ in range(rounds):
        rows, width = _straight(rows, row, width)
        if not width:
            return [], rows, tokens
        tokens, width = _straight(written(_times(entries, rows, row, "token", width), "latent"), "token", width)
        rows = written(_times(entries, tokens, "token", row, width), "latent")
    squares, ways = _directions(gram(rows, width))
    ways = ways[:, :count]
    return np.sqrt(squares[:count]).tolist(), turned(rows, row, ways), turned(tokens, "token", ways)


def nearest(rows: DataFrame, row: str, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the rows nearest to each row by the cosine of their latent vectors."""
    return corroboration.nearest(rows.select(F.col(row).alias("query_id"), F.col("v").alias("vector")),
                                 rows.select(F.col(row).alias("vec_id"), F.col("v").alias("vector")), k, min_score=-1.0)
