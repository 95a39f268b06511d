"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick(options: Sequence[str], number: Column) -> Column:
    """The option at ``number`` modulo the list's length."""
    return F.element_at(F.array(*[F.lit(o) for o in options]),
                        (F.pmod(number, F.lit(len(options))) + 1).cast("int"))


def money(expression: str) -> Column:
    """A value as an exact decimal, so sums do not depend on row order."""
    return F.expr(f"cast({expression} as decimal(18,6))")


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives null for a zero or null bottom."""
    return top / F.nullif(bottom, F.lit(0.0))


def day_text(column: str | Column) -> Column:
    return F.date_format(F.col(column) if isinstance(column, str) else column, "yyyy-MM-dd")


def severity_rank(column: str | Column, order: Sequence[str]) -> Column:
    """Position in the severity ladder; an unknown label sorts lowest."""
    value = F.col(column) if isinstance(column, str) else column
    return F.array_position(F.array(*[F.lit(s) for s in order]), F.lower(value)) - 1


def any_phrase(text: Column, phrases: Sequence[str]) -> Column:
    """Whether any phrase occurs in the text, as one short-circuit expression."""
    test = F.lit(False)
    for phrase in phrases:
        test = test | F.contains(text, F.lit(phrase))
    return test


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Shuffle on the keys into the session's full count of partitions.

    Adaptive execution merges partitions by their bytes. Where few bytes stand
    for much work (rows about to be multiplied, long windows) that would leave
    one task; a fixed count keeps the work spread, and every later step on the
    same keys reuses this shuffle.
    """
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
