"""Windows of a fixed length that occur more than once, found without moving the texts.

A unit is a byte or a word. In every window of ``window`` units the leftmost gram with
the least hash is the window's anchor; windows of equal content have equal anchors, at
equal places. Neighbouring windows with the same anchor form a context, so every window
lies in exactly one context, and only contexts whose anchor gram is the same can share
a window. Per context there is one short packed record (anchor hash, content hash,
place); those are shuffled by anchor, after equal contexts of a batch were merged.

Contexts of equal content are settled by 64 bits of the whole context beside the 48 of
its anchor; what is known of single stretches only says which contexts to fetch. Where one anchor has different
contexts, a shared window must hold either a fixed stretch before the anchor or one
after it, so only contexts that agree on one of the two can share a window. Their text
is fetched and an index, given by the operator, decides for every window. An anchor with very many different contexts is split: there each window is
grouped by its own hash.

Two questions can be asked: does the window start in a document with a smaller id
(``earlier``), or does it start anywhere else (otherwise)?
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import HASH, ID, keyed, saved, tasks, text_column

#: An odd multiplier and its inverse modulo 2^64, for hashes of any stretch from prefix sums.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Units hashed at once; longer texts are cut, with the windows shared out exactly.
CHUNK = 1 << 20
PLACE_BITS = 24
#: Different contexts of one anchor beyond which each window is grouped by its own hash.
CROWD = 2000
#: Characters of text whose records a task holds at once.
BATCH = 1 << 23
#: Units held by one index.
INDEXED = 1 << 19
SALT = 7


@dataclass(frozen=True)
class Rule:
    """What a unit is and which windows count; ``window - gram`` stays under 255."""

    window: int
    gram: int
    earlier: bool
    #: From a text to its units as unsigned 64-bit values.
    units: Callable[[str], np.ndarray]
    #: From text, first unit and number of units to a stretch of it, as a Spark value.
    stretch: Callable[[Column, Column, Column], Column]
    #: From a stretch and a place to the window that starts there, as a Spark value.
    at: Callable[[Column, Column], Column]
    #: From stretches and their owners to (earliest owner, occurrences) per window.
    decide: Callable[[list, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]

    @property
    def half(self) -> int:
        """Windows that begin so many units before their anchor, or more, share a stretch before it."""
        return (self.window - self.gram + 1) // 2


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the multiplier and its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            def run(base: int) -> np.ndarray:
                factors = np.full(n + 1, base, np.uint64)
                factors[0] = 1
                return np.multiply.accumulate(factors)

            self.up, self.down = run(BASE), run(INVERSE)


def contexts(units: np.ndarray, lengths: np.ndarray, rule: Rule, powers: Powers):
    """(piece, first window, windows, anchor's place, anchor hash, content hash, stretches) of joined pieces, as arrays.

    The content hash has 64 bits of the whole context. The stretches are 16 bits each of
    the stretch that windows beginning well before the anchor share, and of the one that
    the others share; a stretch is zero if the context has no such window.
    """
    window, gram = rule.window, rule.gram
    n = len(units)
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(3))
    if n < window:
        return none
    powers.reach(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(units * powers.up[:n], out=sums[1:])
    hashes = mix((sums[gram:] - sums[:-gram]) * powers.down[:n - gram + 1])
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    span, want = 1, window - gram + 1
    while span < want:
        step = min(span, want - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    anchor = (least & low).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    piece = np.repeat(np.arange(len(lengths)), np.maximum(lengths - window + 1, 0))
    if not len(piece):
        return none
    counts = np.maximum(lengths - window + 1, 0)
    start = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[:-1][piece]
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(start)))
    begin, anchor, piece = start[first], anchor[first], piece[first]
    end = begin + many + window - 1
    content = mix((sums[end] - sums[begin]) * powers.down[begin] + (anchor - begin).astype(np.uint64))
    half = rule.half
    before, after = (anchor - begin >= half) & (half > 0), anchor - begin - many + 1 < half

    def stretch(there: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        low, high = np.where(there, low, 0), np.where(there, high, 0)
        part = mix((sums[high] - sums[low]) * powers.down[low]) >> np.uint64(48)
        return np.where(there, np.maximum(part, np.uint64(1)), np.uint64(0))

    left = stretch(before, anchor - half, anchor + gram)
    right = stretch(after, anchor, anchor + window - half + 1)
    return piece, begin - begins[piece], many, anchor - begin, hashes[anchor], content, left << np.uint64(16) | right


def pieces_of(units: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches of at most CHUNK units that share out the windows of a text."""
    if len(units) <= CHUNK:
        yield 0, units
        return
    for at in range(0, len(units) - window + 1, CHUNK - window + 1):
        yield at, units[at:at + CHUNK]


def _joined(batch: pa.RecordBatch, rule: Rule, powers: Powers):
    """Contexts of a batch: (row, first window, windows, anchor's place, anchor, content, stretches)."""
    found, held, sizes, where, total = [], [], [], [], 0

    def flush():
        nonlocal held, sizes, where, total
        if held:
            piece, at, many, off, h, c, s = contexts(np.concatenate(held), np.array(sizes), rule, powers)
            rows, skips = np.array([w[0] for w in where]), np.array([w[1] for w in where])
            found.append((rows[piece], at + skips[piece], many, off, h, c, s))
        held, sizes, where, total = [], [], [], 0

    for row, text in enumerate(batch.column("text")):
        units = rule.units(text.as_py())
        if len(units) < rule.window:
            continue
        for skip, part in pieces_of(units, rule.window):
            if total + len(part) > CHUNK:
                flush()
            held.append(part)
            sizes.append(len(part))
            where.append((row, skip))
            total += len(part)
    flush()
    if not found:
        return None
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change: the first place of every group."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


RECORD = "bucket int, kind int, id binary, hash binary, at binary, many binary, off binary, h binary, c binary, s binary, copies binary"
NAMES = ("id", "hash", "at", "many", "off", "h", "c", "s", "copies")
KINDS = ("<i8", "<i8", "<u4", "u1", "u1", "V6", "<u8", "<u4", "u1")


def _packed(bucket: int, kind: int, columns: list[np.ndarray]) -> dict:
    press = zstandard.ZstdCompressor(level=1).compress
    return {"bucket": bucket, "kind": kind} | {
        n: press(np.ascontiguousarray(x.astype(k) if k != "V6" else x.astype("<u8").view("u1").reshape(-1, 8)[:, :6]).tobytes())
        for n, k, x in zip(NAMES, KINDS, columns, strict=True)}


def _unpacked(row: dict) -> list[np.ndarray]:
    out = []
    for n, k in zip(NAMES, KINDS, strict=True):
        raw = zstandard.ZstdDecompressor().decompress(row[n])
        if k == "V6":
            wide = np.zeros((len(raw) // 6, 8), "u1")
            wide[:, :6] = np.frombuffer(raw, "u1").reshape(-1, 6)
            out.append(wide.reshape(-1).view("<u8"))
        else:
            out.append(np.frombuffer(raw, k).astype(k if k == "<u8" else np.int64))
    return out


SETTLED, OPEN = 0, 1


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most BATCH bytes of text, or of one text."""
    for batch in batches:
        sizes = pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // BATCH
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if high > low:
                yield batch.slice(low, high - low)


def _records(rule: Rule, buckets: int):
    """Map side: equal contexts of a batch are merged; what that settles is kept aside."""
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *[(n, pa.binary()) for n in NAMES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in _small(batches):
            made = _joined(batch, rule, powers)
            if made is None:
                continue
            row, at, many, off, h, c, s = made
            ids = batch.column(ID).to_numpy(zero_copy_only=False)
            hashes = batch.column(HASH).to_numpy(zero_copy_only=False)
            order = np.lexsort((ids[row], c, h))
            row, at, many, off, h, c, s = (x[order] for x in made)
            first = _groups(h, c)
            sizes = np.diff(np.append(first, len(h)))
            if rule.earlier:
                settled = ids[row] > np.repeat(ids[row[first]], sizes)
                sent, copies = ~settled, np.ones(len(h), np.int64)
            else:
                settled = np.repeat(sizes > 1, sizes)
                sent = np.zeros(len(h), bool)
                sent[first] = True
                copies = np.repeat(np.minimum(sizes, 2), sizes)
            bucket = (mix(h) >> np.uint64(32)).astype(np.int64) % buckets
            rows = []
            for kind, mask, to in ((OPEN, sent, bucket), (SETTLED, settled, np.full(len(h), batch.num_rows % buckets))):
                chosen = np.flatnonzero(mask)
                chosen = chosen[np.lexsort((at[chosen], row[chosen], to[chosen]))]
                for part in np.split(chosen, np.flatnonzero(np.diff(to[chosen])) + 1):
                    if len(part):
                        rows.append(_packed(int(to[part[0]]), kind, [
                            ids[row[part]], hashes[row[part]], at[part], many[part], off[part], h[part], c[part], s[part], copies[part]]))
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _meeting(h: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which of the different contexts agree with another one of their anchor on a stretch."""
    meets = np.zeros(len(h), bool)
    for shift in (0, 16):
        side = (s >> shift) & 0xFFFF
        order = np.lexsort((side, h))
        group = _groups(h[order], side[order])
        sizes = np.diff(np.append(group, len(h)))
        meets[order] |= np.repeat(sizes > 1, sizes) & (side[order] > 0)
    return meets


SPANS = "kind int, id long, hash long, at long, many long, off long, h long"


def _settle(rule: Rule):
    """Reduce side: one bucket holds every record of its anchors."""
    schema = pa.schema([("kind", pa.int32()), *[(n, pa.int64()) for n in ("id", "hash", "at", "many", "off", "h")]])

    def table(kind: int, *columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(columns[0]), kind, np.int32)), *[pa.array(x.astype(np.int64)) for x in columns]],
            schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for row in batch.to_pylist():
                columns = _unpacked(row)
                if row["kind"] == SETTLED:
                    yield table(SETTLED, *columns[:6])
                else:
                    held.append(columns)
        if not held:
            return
        columns = None
        ids, hashes, at, many, off, h, c, s, copies = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, ids, c, h))
        ids, hashes, at, many, off, h, c, s, copies = (x[order] for x in (ids, hashes, at, many, off, h, c, s, copies))
        first = _groups(h, c)
        sizes = np.diff(np.append(first, len(h)))
        if rule.earlier:
            settled = ids > np.repeat(ids[first], sizes)
            asked = ~settled
        else:
            several = np.repeat(np.add.reduceat(copies, first) > 1, sizes)
            settled = several & (copies == 1)
            asked = ~several
            asked[first] = True
        yield table(SETTLED, *(x[settled] for x in (ids, hashes, at, many, off, h)))
        asked &= np.repeat(_meeting(h[first], s[first]), sizes)
        yield table(OPEN, *(x[asked] for x in (ids, hashes, at, many, off, h)))

    return run


class Parts:
    """Contexts of whole anchors, parted at the stretches that their windows must share.

    Equal parts are merged; a part alone at its stretch can only match itself, and the
    others go to the index.
    """

    def __init__(self, rule: Rule):
        self.rule, self.held, self.rows = rule, 0, []
        self.stretches: dict = {}

    def add(self, h: int, owner: int, mark: int, at: int, off: int, units) -> None:
        rule = self.rule
        many = len(units) - rule.window + 1
        cut = min(max(off - rule.half + 1, 0), many)
        for side, begin, end, low, high in (
                (0, 0, cut, off - rule.half, off + rule.gram),
                (1, cut, many, off, off + rule.window - rule.half + 1)):
            if begin == end:
                continue
            contents = self.stretches.setdefault((h, side, units[low:high]), {})
            part = units[begin:end + rule.window - 1]
            fact = contents.setdefault(part, [owner, 0])
            fact[0], fact[1] = min(fact[0], owner), fact[1] + 1
            self.held += len(part) if fact[1] == 1 else 0
            self.rows.append((contents, part, owner, mark, at + begin))

    def spans(self) -> Iterator[tuple[int, int, int, int]]:
        """(owner, mark, at, windows) of what is found earlier, or elsewhere."""
        rule = self.rule
        asked = [(contents, part) for contents in self.stretches.values() if len(contents) > 1 for part in contents]
        found = rule.decide([p for _, p in asked], np.array([c[p][0] for c, p in asked], np.int64)) if asked else []
        for (contents, part), told in zip(asked, found, strict=True):
            contents[part].append(told)
        for contents, part, owner, mark, at in self.rows:
            first, copies, *told = contents[part]
            if first < owner if rule.earlier else copies > 1:
                yield owner, mark, at, len(part) - rule.window + 1
            elif told:
                hit = np.flatnonzero(told[0][0] < owner if rule.earlier else told[0][1] > 1)
                for one in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1) if len(hit) else ():
                    yield owner, mark, at + int(one[0]), len(one)


def _decided(rule: Rule):
    """Windows of the contexts of one shard that the index finds earlier or elsewhere; rows come sorted by anchor."""

    def told(parts: Parts) -> pa.RecordBatch:
        out = list(parts.spans())
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["id", "hash", "at", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, last = Parts(rule), None
        for batch in batches:
            for h, *row, units in zip(*[batch.column(n).to_pylist() for n in ("h", "id", "hash", "at", "off", "part")], strict=True):
                if parts.held > INDEXED and h != last:
                    yield told(parts)
                    parts = Parts(rule)
                last = h
                parts.add(h, *row, tuple(units) if isinstance(units, list) else units)
        yield told(parts)

    return run


def repeated_windows(docs: DataFrame, rule: Rule) -> DataFrame:
    """(id, hash, spans): per document key the repeated windows, as runs (at, many) of window starts."""
    spark = docs.sparkSession
    buckets = tasks(spark)
    keys = keyed(docs).select(ID, HASH, text_column(docs).alias("text"))
    records = keys.mapInArrow(_records(rule, buckets), RECORD).repartitionById(buckets, F.col("bucket"))
    found = saved(records.mapInArrow(_settle(rule), SPANS), "spans")

    asked = found.filter(F.col("kind") == OPEN).drop("kind")
    crowds = asked.groupBy("h").agg(F.count("*").alias("n")).withColumn("crowded", F.col("n") > CROWD)
    parts = saved(
        asked.join(crowds.select("h", "crowded"), "h")
        .join(keys, (F.col("id") == F.col(ID)) & (F.col("hash") == F.col(HASH)))
        .select("crowded", "h", "id", "hash", "at", "many", "off",
                rule.stretch(F.col("text"), F.col("at"), F.col("many") + (rule.window - 1)).alias("part"))
        .distinct(), "parts")
    indexed = parts.filter("not crowded").repartition(buckets, "h").sortWithinPartitions("h").select(
        "h", "id", "hash", "at", "off", "part").mapInArrow(_decided(rule), "id long, hash long, at long, many long")
    single = parts.filter("crowded").select(
        "id", "hash", "at", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("j")).select(
        "id", "hash", (F.col("at") + F.col("j")).alias("at"), rule.at(F.col("part"), F.col("j")).alias("w")).select(
        "id", "hash", "at", F.xxhash64("w").alias("w1"), F.xxhash64(F.lit(SALT), "w").alias("w2"))
    facts = single.groupBy("w1", "w2").agg(F.min("id").alias("earliest"), F.count("*").alias("times"))
    told = F.col("id") > F.col("earliest") if rule.earlier else F.col("times") > 1
    split = single.join(facts, ["w1", "w2"]).filter(told).select("id", "hash", "at", F.lit(1).cast("long").alias("many"))
    settled = found.filter(F.col("kind") == SETTLED).select("id", "hash", "at", "many")
    return settled.unionByName(indexed).unionByName(split).groupBy("id", "hash").agg(
        F.collect_list(F.struct("at", "many")).alias("spans"))


def marked(docs: DataFrame, rule: Rule) -> DataFrame:
    """docs with ``__dw_spans``; null where nothing is repeated."""
    spans = repeated_windows(docs, rule).select(F.col("id").alias(ID), F.col("hash").alias(HASH), F.col("spans").alias("__dw_spans"))
    return keyed(docs).join(spans, [ID, HASH], "left").drop(ID, HASH)


def covered(spans, window: int, n: int) -> np.ndarray:
    """Which of n units lie in a repeated window."""
    if spans is None or not len(spans):
        return np.zeros(n, bool)
    at = np.fromiter((s["at"] for s in spans), np.int64, len(spans))
    many = np.fromiter((s["many"] for s in spans), np.int64, len(spans))
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + many + window - 1, -1)
    return np.cumsum(steps[:-1]) > 0
