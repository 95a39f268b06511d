"""Line dedup: windows of three consecutive lines, kept where they first occur.

The order of occurrence is (doc_id, position). A window that occurred before is
removed; overlapping removed windows merge, so a line goes if any removed window
covers it. Windows are judged on the input, not on what is left.

Cases: a null text is an empty one; an empty text is one empty line; a text of fewer
than three lines has no window and stays; windows of blank lines only are no windows;
rows with equal id and text are one document and are treated alike; a null id sorts
first; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import HASH, ID, keyed, text_column

WINDOW = 3
#: Lead the second hash, which makes it independent of the first.
SALT = 7


def _lines(docs: DataFrame):
    return F.split(text_column(docs), "\n", -1)


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per window: document key, first line, and a 128-bit hash of its lines."""
    lined = keyed(docs).select(ID, HASH, _lines(docs).alias("lines"))
    starts = F.when(F.size("lines") >= size, F.sequence(F.lit(0), F.size("lines") - size))
    part = [F.get("lines", F.col("at") + i) for i in range(size)]
    return lined.select(ID, HASH, "lines", F.explode(starts).alias("at")).filter(
        F.trim(F.concat(*part)) != "").select(
        ID, HASH, "at", F.xxhash64(*part).alias("h1"), F.xxhash64(F.lit(SALT), *part).alias("h2"))


def repeated(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(key, __dw_starts): the first lines of each document's windows that occurred before."""
    found = windows(docs, size)
    firsts = found.groupBy("h1", "h2").agg(
        F.min(F.struct(ID, HASH, "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = found.join(firsts, ["h1", "h2"]).filter(F.struct(ID, HASH, "at") > F.col("first"))
    return later.groupBy(ID, HASH).agg(F.collect_set("at").alias("__dw_starts"))


def _deduped(docs: DataFrame, size: int) -> DataFrame:
    """docs with the repeated lines taken out of text, and __dw_lines, __dw_removed, __dw_spans beside it."""
    marked = keyed(docs).join(repeated(docs, size), [ID, HASH], "left")
    lined = marked.withColumn("__dw_each", F.split(text_column(marked), "\n", -1)).withColumn(
        "__dw_gone", F.array_distinct(F.flatten(F.transform(
            F.coalesce("__dw_starts", F.array().cast("array<int>")),
            lambda s: F.sequence(s, s + (size - 1))))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__dw_each") - 1), F.col("__dw_gone"))
    ends = F.transform("__dw_gone", lambda i: i + 1)
    text = F.when(F.size("__dw_gone") == 0, F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("__dw_each", i)), "\n"))
    return lined.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.size("__dw_each").cast("long").alias("__dw_lines"),
        F.size("__dw_gone").cast("long").alias("__dw_removed"),
        F.size(F.array_except(F.col("__dw_gone"), ends)).cast("long").alias("__dw_spans"))


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs with the repeated lines taken out of text, and n_lines, n_removed, n_spans beside it.

    Columns of docs that have these three names give way to them.
    """
    counts = ("n_lines", "n_removed", "n_spans")
    return _deduped(docs, size).select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in counts],
        *[F.col(f"__dw_{c.removeprefix('n_')}").alias(c) for c in counts])


def dedup_documents(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs, columns unchanged, with the repeated lines taken out of text and n_chars to match."""
    kept = _deduped(docs, size)
    if "n_chars" in docs.columns:
        counted = F.when(F.col("__dw_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        kept = kept.withColumn("n_chars", F.coalesce(counted, F.col("n_chars")))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
