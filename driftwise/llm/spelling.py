"""Spelling variants: words at one edit from each other, found by bit-sliced position indexes.

The vocabulary is dealt into bounded shards. A shard's index has, for each position and
letter, one bit per word: whether the word has that letter there. Queries run letter by
letter over all words of the shard at once, 64 to a machine word. With Z the words equal
so far, and S, I and D those reached with one letter replaced, one more or one less, a
letter x at place i gives

    S' = (S & at[i][x]) | Z      D' = (D & at[i-1][x]) | Z
    Z' = Z & at[i][x]            I' = (I & at[i+1][x]) | Z'

so the sets of zero and of one error advance together. Words stand in the index by
falling n and rising spelling, so the lowest bit of an answer is the best near word.

Two words of lengths L, or L and L + 1, at one edit share their first L // 2 letters or
their last L - L // 2. So a word goes to the shards of those two parts, for L its length
and for L one less, and meets all its near words there. A pair that shares both parts is
counted at the first only: there, Z after L // 2 letters must hold, at the last it must
not. A part that many words share has its index cut into blocks, and its words as a
stated query set go to every block; no pair is ever a row.

Cases: a null text has no runs; a null id is written as nothing before the colon; runs of
repeated rows count each time; an empty table gives an empty result; no other column is read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import saved, texts

#: One in so many (document, run) has a letter taken out.
DAMAGED = 97
LEAST_LETTERS, LEAST_TIMES = 5, 3
#: A form has at least so many times its variant's occurrences.
RATIO = 2
#: Distinct words that a task counts before it hands the counts on.
HELD = 1 << 18
#: Letters of the words of a usual shard, and of one block of a part that many words share.
SHARD_LETTERS, BLOCK_LETTERS = 1 << 15, 1 << 17
#: Machine words that one array of a batch of queries has at most.
BATCH = 1 << 17


def _counted(least: int, damaged: int):
    run = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def words(doc_id, text: str) -> Iterator[tuple[str, int]]:
        # bytes.lower() lowers A-Z only.
        each = Counter(run.findall(text.encode().lower().decode()))
        start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
        for word, times in each.items():
            h = zlib.crc32(word.encode(), start)
            if not h % damaged:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
                if len(word) < least:
                    continue
            yield word, times

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for word, times in words(doc_id, text.as_py()):
                    held[word] = held.get(word, 0) + times
                if len(held) > HELD:
                    yield out()
                    held = {}
        if held:
            yield out()

    return count


def vocabulary(docs: DataFrame, least: int = LEAST_LETTERS, times: int = LEAST_TIMES, damaged: int = DAMAGED) -> DataFrame:
    """(word, n): the words of all texts, counted per task before they are shuffled."""
    parts = texts(docs).mapInArrow(_counted(least, damaged), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


class PositionIndex:
    """Bitsets by position and letter over some words, given by falling rank, of one length or two."""

    def __init__(self, words: list[str], longest: int):
        self.size, self.slots = len(words), -(-len(words) // 64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        self.alphabet = np.unique(letters)
        width, self.places = len(self.alphabet), longest + 2
        of = np.repeat(np.arange(len(words)), lengths)
        at = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        cell = at * (width + 1) + np.searchsorted(self.alphabet, letters)
        used, row = np.unique(cell, return_inverse=True)
        bits = np.zeros((len(used) + 1, self.slots * 64), bool)
        bits[row + 1, of] = True
        self.bits = np.packbits(bits, axis=1, bitorder="little").view("<u8")
        #: Row of the bitset of (position, letter); row 0 is empty and stands for letters no word has there.
        self.rows = np.zeros(self.places * (width + 1), np.int64)
        self.rows[used] = np.arange(1, len(used) + 1)
        self.rows = self.rows.reshape(self.places, width + 1)
        self.of_length = {int(n): self._mask(lengths == n) for n in np.unique(lengths)}

    def _mask(self, chosen: np.ndarray) -> np.ndarray:
        whole = np.zeros(self.slots * 64, bool)
        whole[:self.size] = chosen
        return np.packbits(whole, bitorder="little").view("<u8")

    def near(self, queries: np.ndarray, shared: int, first: bool, up: bool) -> np.ndarray:
        """Bitsets of the words at one edit from each query (a row of letters).

        up: words of the query's length or one letter more; else of one letter less.
        Of a pair that agrees in its first ``shared`` letters, only where first, and only such a pair.
        """
        length = queries.shape[1]
        places = np.minimum(np.searchsorted(self.alphabet, queries), len(self.alphabet) - 1)
        column = np.where(self.alphabet[places] == queries, places, len(self.alphabet))
        every = self._mask(np.ones(self.size, bool))
        zero = np.broadcast_to(every, (len(queries), self.slots)).copy()
        agree, one = zero, np.zeros_like(zero)
        longer = zero.copy()
        for i in range(length):
            here = self.bits[self.rows[i, column[:, i]]]
            if up:
                one &= here
                one |= zero
                longer &= self.bits[self.rows[i + 1, column[:, i]]]
                zero = zero & here
                longer |= zero
            else:
                if i:
                    one &= self.bits[self.rows[i - 1, column[:, i]]]
                one |= zero
                zero = zero & here
            if i + 1 == shared:
                agree = zero
        none = np.zeros(self.slots, "<u8")
        if up:
            found = (one & ~zero & self.of_length.get(length, none)) | (longer & self.of_length.get(length + 1, none))
        else:
            found = one & self.of_length.get(length - 1, none)
        return found & agree if first else found & ~agree


def _answers(shard: pa.Table) -> pa.Table:
    """(word, n_near, best_n, best) of every query of one shard that has a near word there."""
    length, first = shard.column("length")[0].as_py(), shard.column("first")[0].as_py()
    words, times = shard.column("word").to_pylist(), shard.column("n").to_pylist()
    indexed = shard.column("indexed").to_pylist()
    ranked = sorted((-n, w) for w, n, i in zip(words, times, indexed, strict=True) if i)
    out = {"word": [], "n_near": [], "best_n": [], "best": []}
    if ranked:
        index = PositionIndex([w for _, w in ranked], length + 1)
        step = max(1, BATCH // index.slots)
        for size in (length, length + 1):
            asked = [w for w in words if len(w) == size]
            for at in range(0, len(asked), step):
                part = asked[at:at + step]
                letters = np.frombuffer("".join(part).encode("utf-32-le"), "<u4").reshape(len(part), size)
                found = index.near(letters, length // 2, first, size == length)
                count = np.bitwise_count(found).sum(axis=1, dtype=np.int64)
                hit = np.flatnonzero(count)
                slot = (found[hit] != 0).argmax(axis=1)
                value = found[hit, slot]
                lowest = slot * 64 + np.bitwise_count((value & (~value + np.uint64(1))) - np.uint64(1))
                out["word"] += [part[i] for i in hit]
                out["n_near"] += count[hit].tolist()
                out["best_n"] += [-ranked[i][0] for i in lowest]
                out["best"] += [ranked[i][1] for i in lowest]
    return pa.table({"word": pa.array(out["word"], pa.string()), "n_near": pa.array(out["n_near"], pa.int64()),
                     "best_n": pa.array(out["best_n"], pa.int64()), "best": pa.array(out["best"], pa.string())})


def near_words(words: DataFrame, least: int = LEAST_LETTERS, shard_letters: int = SHARD_LETTERS,
               block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have a near word."""
    letters, length = F.length("word"), F.col("length")
    sized = words.select("word", "n", F.explode(F.array(letters - 1, letters)).alias("length")).filter(length >= least)
    parts = sized.select("word", "n", "length", F.explode(F.array(
        F.struct(F.lit(True).alias("first"), F.expr("left(word, length div 2)").alias("part")),
        F.struct(F.lit(False).alias("first"), F.expr("right(word, length - length div 2)").alias("part")))).alias("p")).select(
        "word", "n", "length", "p.first", "p.part")
    crowded = parts.groupBy("length", "first", "part").agg(F.count("*").alias("members")).filter(
        F.col("members") * length > block_letters).select(
        "length", "first", "part", F.ceil(F.col("members") * length / block_letters).cast("int").alias("blocks"))
    usual = sized.groupBy("length").agg(F.ceil(F.count("*") * length / shard_letters).cast("int").alias("shards"))
    placed = parts.join(crowded, ["length", "first", "part"], "left").join(usual, "length")
    own = F.expr("pmod(xxhash64(word), blocks)").cast("int")
    dealt = placed.select(
        "word", "n", "length", "first", "blocks", own.alias("own"),
        F.xxhash64("part").alias("part"), F.expr("pmod(xxhash64(part), shards)").alias("shard"),
        F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
            F.sequence(F.lit(0), F.col("blocks") - 1))).alias("block"))
    rows = dealt.select(
        "word", "n", "length", "first",
        F.when(F.col("blocks").isNull(), F.col("shard")).otherwise(F.xxhash64("part", "block")).alias("shard"),
        F.col("blocks").isNotNull().alias("cut"),
        (F.col("blocks").isNull() | (F.col("block") == F.col("own"))).alias("indexed"))
    found = rows.groupBy("length", "first", "shard", "cut").applyInArrow(
        _answers, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top")).select(
        "word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words (word, form) that have a form: every pointer is doubled until all stand on words without one.

    Each form has at least twice the occurrences of its word, so paths are no longer than
    the logarithm of the largest count and the rounds no more than the logarithm of that.
    """
    state = saved(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while state.filter("moved").limit(1).count():
        ahead = state.select(F.col("word").alias("at"), F.col("root").alias("further"))
        state = saved(state.join(ahead, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
    return state.select("word", "root")


def variants(docs: DataFrame, ratio: int = RATIO, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    words = saved(vocabulary(docs), "vocabulary")
    found = words.join(near_words(words, **options), "word", "left")
    formed = F.col("best_n") >= F.lit(ratio) * F.col("n")
    told = saved(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "variants")
    followed = roots(told.filter("form is not null").select("word", "form"))
    return told.join(followed, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
