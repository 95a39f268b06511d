"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model is over the bytes of UTF-8, none of them folded: grams of ``ORDER`` bytes are
counted in all trusted texts and stay a Spark table of 32-bit codes, sharded by gram, as do
the continuation counts of every shorter order and the totals of every context. Nothing of
the model goes to the driver but the discounts, three numbers an order.

Texts are taken in blocks of ``BLOCK`` bytes. A block asks once for each of its distinct
grams; the grams asked for by anyone meet the counts of each order in joins by gram, by
context and by the gram's end, which give every gram its bits; and these go back to the
blocks that asked, where texts and answers meet in a cogroup. So what is moved is a block's
distinct grams, not every text's, and each text once, compressed. A text's perplexity is
held against a quantile of the trusted texts of its language.

Trusted texts are those labelled of quality 1 and not toxic; all of them are used.

Cases: null and empty texts have nothing to score and are rejected; a language without
trusted texts is held against all languages together, and so is a null language; without
any trusted text nothing can be judged and every other text is kept; rows repeated in
documents are scored each; labels repeated count once; other columns pass through. The
documents are read more than once and must come in the same order each time, as files do
(``settled``); other frames are saved first. A block that got other texts than it asked for
is an error, not a wrong score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftwise.llm.common import saved, text_column

ORDER = 4
#: Bytes of text in a block, and in a piece of it that is counted at once.
BLOCK, PIECE = 1 << 25, 1 << 20
#: The quantile of trusted texts, per language, that is the threshold.
QUANTILE = 0.99
#: Short texts vary more: this many bits over the root of the bytes are allowed on top.
ALLOWANCE = 5.0
#: Languages whose thresholds are broadcast; more (there are under 8,000) are left to the planner.
LANGUAGES = 10_000
#: Trusted ids (8 bytes each) that are broadcast.
IDS = 1_000_000
#: Bits per byte are compared at this many decimals.
DECIMALS = 3
#: White space stands before a text.
PAD = b"\n"
#: Symbols of the dense table below, which checks the joins on small alphabets.
SYMBOLS = 41


def grams(texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """The codes of the grams that end at each byte of each text, one text after the other."""
    pad = PAD * (order - 1)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(pad + pad.join(texts), np.uint8) if texts else np.zeros(0, np.uint8)
    # A text's grams end after its own pad, which begins where the texts and pads before it end.
    inside = np.ones(len(raw), bool)
    begins = np.cumsum(lengths + order - 1) - lengths - order + 1
    for i in range(order - 1):
        inside[begins + i] = False
    ends = np.flatnonzero(inside)
    codes = np.zeros(len(ends), np.int64)
    for i in range(order):
        codes = (codes << 8) | raw[ends - (order - 1 - i)]
    return codes


def _pieces(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a column as bytes, nulls as empty ones, about PIECE bytes at a time."""
    held, size = [], 0
    for text in column:
        raw = (text.as_py() or "").encode("utf-8")
        held.append(raw)
        size += len(raw)
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def gram_counts(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n) over all trusted texts, summed by gram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _pieces(batch.column(0)):
                seen, times = np.unique(grams(texts, order), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(times.astype(np.int64))], names=["gram", "n"])

    parts = trusted.select(text_column(trusted).alias("text")).mapInArrow(count, "gram long, n long")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"))


def _end(gram: Column, order: int) -> Column:
    """The last symbols of a gram."""
    return gram.bitwiseAND(F.lit((1 << 8 * order) - 1))


def continuation_counts(longer: DataFrame, order: int) -> DataFrame:
    """(gram, n) of an order: how many different symbols stand before the gram in the next longer order."""
    return longer.groupBy(_end(F.col("gram"), order).alias("gram")).agg(F.count(F.lit(1)).alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """The modified discounts for counts 0, 1, 2, 3 and more of one order."""
    row = counts.agg(*[F.count_if(F.col("n") == k) for k in range(1, 5)]).first()
    return _cuts([float(x) for x in row])


def gram_bits(counts: DataFrame, asked: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, bits) of every gram asked for, a frame of distinct grams: bits of its last symbol after the others.

    Each order joins its grams with their counts, with the totals of their contexts, and
    with the probabilities of their ends under the next shorter order.
    """
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = saved(continuation_counts(levels[k + 1], k), f"grams{k}")
    shorter = None
    for k in range(1, order + 1):
        cuts = discounts(levels[k])
        cut = F.when(F.col("n") >= 3, F.lit(cuts[3])).when(F.col("n") == 2, F.lit(cuts[2])).otherwise(F.lit(cuts[1]))
        contexts = levels[k].groupBy(F.shiftright("gram", 8).alias("context")).agg(
            F.sum("n").cast("double").alias("whole"),
            # The sum of discounts by counts, which does not depend on the order of rows.
            (F.count_if(F.col("n") == 1) * cuts[1] + F.count_if(F.col("n") == 2) * cuts[2]
             + F.count_if(F.col("n") >= 3) * cuts[3]).alias("spare"))
        known = levels[k].select("gram", (F.col("n") - cut).alias("own"))
        wanted = asked if k == order else asked.select(_end(F.col("gram"), k).alias("gram")).distinct()
        wanted = wanted.withColumns({"context": F.shiftright("gram", 8), "end": _end(F.col("gram"), k - 1)})
        met = wanted.join(known, "gram", "left").join(contexts, "context", "left")
        met = met.withColumn("lower", F.lit(1 / 256)) if shorter is None else met.join(
            shorter.select(F.col("gram").alias("end"), F.col("p").alias("lower")), "end")
        shorter = met.select("gram", F.when(F.col("whole").isNull(), F.col("lower")).otherwise(
            F.coalesce("own", F.lit(0.0)) / F.col("whole") + F.col("spare") / F.col("whole") * F.col("lower")).alias("p"))
    return shorter.select("gram", (-F.log2(F.greatest("p", F.lit(float(np.finfo(np.float32).tiny))))).cast("float").alias("bits"))


def _cuts(seen: list[float]) -> list[float]:
    """The modified discounts for counts 0, 1, 2, 3 and more, from how many grams have the counts 1 to 4."""
    if min(seen[0], seen[1]) == 0:
        return [0.0, 0.5, 0.5, 0.5]
    y = seen[0] / (seen[0] + 2 * seen[1])
    return [0.0] + [
        min(max(k - (k + 1) * y * seen[k] / seen[k - 1], 0.0), float(k)) if seen[k - 1] else 0.5 * k for k in (1, 2, 3)]


def log_table(codes: np.ndarray, counts: np.ndarray, order: int = 4) -> np.ndarray:
    """The same model as one dense table, by which the joins are checked on small alphabets.

    It holds log2 of the probability of every gram's last symbol after the others, as 32-bit floats.
    """
    top = np.zeros(SYMBOLS ** order, np.int64)
    top[codes] = counts
    levels = [top]
    for k in range(order - 1, 0, -1):
        levels.append((levels[-1].reshape(SYMBOLS, SYMBOLS ** k) > 0).sum(0))
    chance = np.full(1, 1 / SYMBOLS)
    for k, level in enumerate(reversed(levels), 1):
        table = level.reshape(SYMBOLS ** (k - 1), SYMBOLS)
        cut = np.array(_cuts([float((level == k).sum()) for k in range(1, 5)]))[np.minimum(table, 3)]
        whole = table.sum(1, keepdims=True)
        shorter = np.tile(chance.reshape(-1, SYMBOLS) if k > 1 else chance, (SYMBOLS if k > 1 else 1, 1))
        with np.errstate(invalid="ignore", divide="ignore"):
            mixed = (table - cut) / whole + cut.sum(1, keepdims=True) / whole * shorter
        chance = np.where(whole > 0, mixed, shorter).reshape(-1)
    return np.log2(np.maximum(chance, np.finfo(np.float32).tiny)).astype(np.float32)


def _blocks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[int, pa.Table]]:
    """The rows of a task in blocks of about BLOCK bytes of text, numbered apart from those of other tasks."""
    number = TaskContext.get().partitionId() << 32
    held, size = [], 0
    for batch in batches:
        start = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(text).cast(pa.string())), 0).to_pylist()
        for i, length in enumerate(lengths):
            if size and size + length > BLOCK:
                yield number, pa.Table.from_batches([*held, batch.slice(start, i - start)])
                number, held, size, start = number + 1, [], 0, i
            size += length
        held.append(batch.slice(start))
    if held:
        yield number, pa.Table.from_batches(held)


def _texts(rows: pa.Table, text: int) -> Iterator[list[bytes]]:
    for part in rows.column(text).chunks:
        yield from _pieces(part.cast(pa.string()))


def asked_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(block, gram): the distinct grams of every block of texts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _blocks(batches, 0):
            seen = [np.unique(grams(t, order)) for t in _texts(rows, 0)]
            seen = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), block, np.int64)), pa.array(seen)], names=["block", "gram"])

    return docs.select("text").mapInArrow(ask, "block long, gram long")


def scored(docs: DataFrame, asked: DataFrame, bits: DataFrame, order: int = ORDER) -> DataFrame:
    """docs beside __dw_bits, the mean bits of a text's bytes, null without text; asked are their grams, bits has all of these."""
    text = docs.columns.index("text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))
        for block, rows in _blocks(batches, text):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=packed) as out:
                out.write_table(rows.combine_chunks())
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "data"])

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        known, worth = answers.column("gram").to_numpy(), answers.column("bits").to_numpy().astype(np.float64)
        by_gram = np.argsort(known)
        known, worth = known[by_gram], worth[by_gram]
        rows = pa.concat_tables([pa.ipc.open_stream(d.as_py()).read_all() for d in block.column("data")])
        means = []
        for texts in _texts(rows, text):
            codes = grams(texts, order)
            at = np.searchsorted(known, codes)
            if len(codes) and (len(known) == 0 or (known[np.minimum(at, len(known) - 1)] != codes).any()):
                raise RuntimeError("the documents came in another order when read again; save them first")
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            full = lengths > 0
            sums = np.add.reduceat(worth[at], (np.cumsum(lengths) - lengths)[full]) if full.any() else np.zeros(0)
            mean = np.full(len(texts), np.nan)
            mean[full] = np.round(sums / lengths[full], DECIMALS)
            means.append(mean)
        mean = np.concatenate(means) if means else np.zeros(0)
        return rows.append_column("__dw_bits", pa.array(mean, pa.float64(), mask=np.isnan(mean)))

    answers = asked.join(bits, "gram").select("block", "gram", "bits")
    blocks = docs.mapInArrow(pack, "block long, data binary")
    schema = StructType([*docs.schema.fields]).add("__dw_bits", "double")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)


def _exact_quantiles(scores: DataFrame, *keys: str) -> DataFrame:
    """The quantile of rounded scores, from their histogram."""
    bars = scores.groupBy(*keys, "bits").agg(F.count("*").alias("n"))
    running = W.partitionBy(*keys).orderBy("bits").rowsBetween(W.unboundedPreceding, 0)
    shares = bars.withColumns({
        "share": F.sum("n").over(running) / F.sum("n").over(W.partitionBy(*keys))})
    return shares.groupBy(*keys).agg(
        F.min(F.when(F.col("share") >= QUANTILE, F.col("bits"))).alias("upper"))


def judged(docs: DataFrame, labels: DataFrame, settled: bool = False) -> DataFrame:
    """docs beside bits (per byte, null without text), threshold and accepted.

    settled says that docs are plain files, which come in the same order whenever they are read.
    """
    docs = docs if settled else saved(docs, "docs")
    good = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select(
        F.col("doc_id").cast("long").alias("__dw_good")).distinct()
    own = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), text_column(docs).alias("text"),
        F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("lang"))
    good = saved(good, "trusted")
    # Trusted ids go to the texts while they are few; else the texts are shuffled once to meet them, and kept in that order.
    few = good.count() <= IDS
    trusted = own.join(F.broadcast(good) if few else good, own["doc_id"] == good["__dw_good"], "left_semi").select("text", "lang")
    trusted = trusted if few else saved(trusted, "texts")
    counts = saved(gram_counts(trusted), "grams")
    asked = saved(asked_grams(docs), "asked")
    bits = saved(gram_bits(counts, saved(asked.select("gram").distinct(), "distinct")), "bits")
    scores = saved(scored(trusted, asked_grams(trusted), bits).select("lang", F.col("__dw_bits").alias("bits")), "scores").filter("bits is not null")
    each = saved(_exact_quantiles(scores, "lang").select(
        F.col("lang").alias("__dw_lang"), F.col("upper").alias("__dw_limit")), "limits")
    everywhere = _exact_quantiles(scores.withColumn("all", F.lit(1)), "all").select(F.col("upper").alias("q")).first()
    known_langs = F.broadcast(each) if each.count() <= LANGUAGES else each
    found = scored(docs, asked, bits)
    told = found.join(known_langs, F.coalesce(found["lang"].cast("string"), F.lit("")) == F.col("__dw_lang"), "left")
    threshold = F.round(
        F.coalesce("__dw_limit", F.lit(everywhere.q if everywhere else None).cast("double"))
        + ALLOWANCE / F.sqrt(F.nullif(F.octet_length(text_column(found)), F.lit(0))), DECIMALS)
    return told.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col("__dw_bits"), threshold.alias("__dw_threshold"),
        F.coalesce(F.col("__dw_bits") <= threshold, F.col("__dw_bits").isNotNull()).alias("__dw_accepted"))


def accepted(docs: DataFrame, labels: DataFrame, settled: bool = False) -> DataFrame:
    """The documents that are kept, with their columns."""
    return judged(docs, labels, settled).filter("__dw_accepted").select(*[F.col(f"`{c}`") for c in docs.columns])
