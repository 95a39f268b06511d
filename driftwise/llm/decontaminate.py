"""Benchmark decontamination with DataFrame functions only.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, with A-Z
lowered. A window is ten consecutive words of a benchmark item, or the whole item if
it has fewer. Every document position is hashed and looked up among the windows'
hashes; a hit is then compared word by word.

Cases: null text has no words; an item without words has no window; repeated items
and rows change nothing, rows of equal id and text get the same result; an item
without an id still marks words but is no listed item; empty tables give no hits;
other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import HASH, ID, keyed, saved, text_column

#: Words with letters in either case; they are lowered one by one.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Windows are broadcast up to this many rows and characters, and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 32_000_000


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _lowered(words: Column) -> Column:
    """Words with A-Z lowered and every other character as it is."""
    return F.transform(words, lambda w: F.translate(w, string.ascii_uppercase, string.ascii_lowercase))


def _hash(words: Column, at: Column, size: int) -> Column:
    """One hash of some lowered words in a row; full lowering only adds hits, which are verified."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(size)])


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, window, n): the distinct windows of every item."""
    items = benchmark.select(
        benchmark["item_id"].cast("string").alias("item"), _lowered(_words(text_column(benchmark))).alias("words"))
    many = F.transform(F.sequence(F.lit(1), F.size("words") - (size - 1)), lambda i: F.slice("words", i, size))
    cut = F.when(F.size("words") >= size, many).when(F.size("words") > 0, F.array("words"))
    return items.select("item", F.explode(cut).alias("window")).distinct().withColumn("n", F.size("window"))


def _hits(worded: DataFrame, sought: DataFrame, size: int, broadcast: bool) -> DataFrame:
    """(key, at, n, item) of every place where a window of the given size occurs."""
    low = F.transform("words", lambda w: F.lower(w))
    sought = sought.filter(F.col("n") == size).withColumn(
        "h", _hash(F.transform("window", lambda w: F.lower(w)), F.lit(0), size))
    starts = F.when(F.size("words") >= size, F.sequence(F.lit(0), F.size("words") - size))
    placed = worded.withColumn("low", low).select(
        ID, HASH, "words", "low", F.explode(starts).alias("at")).withColumn("h", _hash(F.col("low"), F.col("at"), size))
    if broadcast:
        found = placed.select(ID, HASH, "words", "at", "h").join(F.broadcast(sought), "h")
    else:
        met = placed.select(ID, HASH, "at", "h").join(sought.select("h").distinct(), "h", "left_semi")
        found = met.distinct().join(worded.dropDuplicates([ID, HASH]), [ID, HASH]).join(sought, "h")
    # Only functions that Spark compiles: a lambda here would keep the join out of the
    # compiled stage and copy a text's words for each of its positions. Equality is put
    # as two inequalities, since an equality would be computed as a key at each position.
    here = F.translate(F.array_join(F.slice("words", F.col("at") + 1, size), " "), string.ascii_uppercase, string.ascii_lowercase)
    there = F.array_join("window", " ")
    same = here.startswith(there) & (F.length(here) <= F.length(there))
    return found.filter(same).select(ID, HASH, "at", "n", "item")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs with __dw_words (their number), __dw_hit (words inside windows) and __dw_items (sorted strings) beside them."""
    sought = saved(windows(benchmark, size), "windows")
    facts = sought.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.length(F.array_join("window", " "))), F.lit(0)).alias("chars"),
        F.collect_set("n").alias("sizes")).first()
    broadcast = facts.rows <= BROADCAST_ROWS and facts.chars <= BROADCAST_CHARS
    worded = keyed(docs).select(ID, HASH, _words(text_column(docs)).alias("words"))
    hits = None
    for n in sorted(facts.sizes):
        part = _hits(worded, sought, n, broadcast)
        hits = part if hits is None else hits.unionByName(part)
    every = keyed(docs).withColumn("__dw_words", F.size(_words(text_column(docs))).cast("long"))
    none = F.array().cast("array<string>")
    if hits is None:
        return every.withColumns({"__dw_hit": F.lit(0).cast("long"), "__dw_items": none})
    before = f"max(at + n) over (partition by {ID}, {HASH} order by at, n, item rows between unbounded preceding and 1 preceding)"
    per = hits.distinct().withColumn("reached", F.coalesce(F.expr(before), F.lit(0))).groupBy(ID, HASH).agg(
        F.sum(F.greatest(F.lit(0), F.col("at") + F.col("n") - F.greatest("at", "reached"))).alias("__dw_hit"),
        F.sort_array(F.collect_set("item")).alias("__dw_items"))
    return every.join(per, [ID, HASH], "left").withColumns({
        "__dw_hit": F.coalesce("__dw_hit", F.lit(0)).cast("long"), "__dw_items": F.coalesce("__dw_items", none)})


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    return contamination(docs.select("doc_id", "text"), benchmark, size).select(
        "doc_id", F.col("__dw_words").alias("n_words"), F.col("__dw_hit").alias("n_hit"),
        F.size("__dw_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__dw_items", ","), 256).alias("items_sha256"), (F.col("__dw_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns."""
    return contamination(docs, benchmark, size).filter("__dw_hit = 0").select(*[F.col(f"`{c}`") for c in docs.columns])
