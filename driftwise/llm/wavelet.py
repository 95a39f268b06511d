"""Token ids in wavelet-matrix files.

Documents in ascending id order are encoded, each ended by id 0, and cut into shards.
A shard is one self-contained zstd file: a header, the documents' ids and lengths, and
one bit-plane per bit of the largest token id. Rank directories are rebuilt on opening.
Spark writes each shard as the one row of one Parquet part, since its writers are the
only ones that commit atomically on every store.

Cases: a null text is an empty one and gives the end id alone; rows of equal id are
ordered by text; a null id sorts first; an empty table gives no shard; other columns
are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwise.llm.common import id_cuts, saved, slice_of, tasks, texts

MAGIC = b"DWM1"
END = 0
#: A shard is closed when it holds this many tokens.
SHARD_TOKENS = 1 << 20
#: Bytes of text that are encoded at once, and distinct pieces that are handed to the library as one string.
TEXT_BYTES, JOINED = 1 << 23, 512


class WaveletMatrix:
    """Bit-planes from the highest bit down, each stably parted by the plane above."""

    def __init__(self, length: int, planes: list[np.ndarray], zeros: list[int]):
        self.length, self.planes, self.zeros = length, planes, zeros
        self.directory = [np.concatenate([[0], np.cumsum(np.bitwise_count(p), dtype=np.int64)]) for p in planes]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max(initial=0)).bit_length())
        order, planes, zeros = ids.astype(np.uint16 if bits <= 16 else np.uint32), [], []
        for level in reversed(range(bits)):
            bit = (order >> level) & 1 != 0
            planes.append(np.packbits(bit, bitorder="little"))
            low, high = order[~bit], order[bit]
            zeros.append(len(low))
            order = np.concatenate([low, high])
        return cls(len(ids), planes, zeros)

    def ones_before(self, level: int, at: int) -> int:
        """Rank: set bits of a plane before a position."""
        byte, rest = divmod(at, 8)
        tail = int(self.planes[level][byte]) & ((1 << rest) - 1) if rest else 0
        return int(self.directory[level][byte]) + tail.bit_count()

    def _place(self, level: int, bit: int, nth: int) -> int:
        """Select: the position of the nth (from 0) set or clear bit of a plane."""
        low, high = 0, self.length
        while low < high:
            middle = (low + high) // 2
            ones = self.ones_before(level, middle + 1)
            if (ones if bit else middle + 1 - ones) > nth:
                high = middle
            else:
                low = middle + 1
        return low

    def __getitem__(self, at: int) -> int:
        value = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[at >> 3]) >> (at & 7) & 1
            ones = self.ones_before(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        low, high = 0, end
        for level in range(len(self.planes)):
            a, b = self.ones_before(level, low), self.ones_before(level, high)
            if token >> (len(self.planes) - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, end: int) -> int:
        """How often a token occurs before a position."""
        if token >> len(self.planes):
            return 0
        low, high = self._range(token, end)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.length)

    def select(self, token: int, nth: int) -> int:
        """The position of the nth (from 0) occurrence of a token."""
        if nth < 0 or nth >= self.count(token):
            raise IndexError(nth)
        at = self._range(token, 0)[0] + nth
        for level in reversed(range(len(self.planes))):
            bit = token >> (len(self.planes) - 1 - level) & 1
            at = self._place(level, bit, at - self.zeros[level] if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All tokens, by undoing the partings from the lowest plane up."""
        bits = len(self.planes)
        order = np.zeros(self.length, np.uint16 if bits <= 16 else np.uint32)
        for level in reversed(range(bits)):
            bit = np.unpackbits(self.planes[level], count=self.length, bitorder="little").astype(bool)
            above = np.empty_like(order)
            above[~bit] = order[:self.zeros[level]]
            above[bit] = order[self.zeros[level]:]
            above |= bit.astype(order.dtype) << order.dtype.type(bits - 1 - level)
            order = above
        return order


def to_file(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    matrix = WaveletMatrix.build(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    body = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(),
            np.array(lengths, "<i8").tobytes(), np.array(matrix.zeros, "<i8").tobytes(),
            *[p.tobytes() for p in matrix.planes]]
    head = struct.pack("<4sQQI", MAGIC, len(doc_ids), len(ids), len(matrix.planes))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(body))


def from_file(data: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """Document ids, their lengths and the matrix of one file."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    magic, docs, length, bits = struct.unpack_from("<4sQQI", raw)
    if magic != MAGIC:
        raise ValueError("not a wavelet-matrix file")
    at = struct.calcsize("<4sQQI")

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(raw, kind, count, at)
        at += part.nbytes
        return part

    ids, known, lengths, zeros = take("<i8", docs), take("u1", docs), take("<i8", docs), take("<i8", bits)
    planes = [take("u1", (length + 7) // 8) for _ in range(bits)]
    return [int(d) if k else None for d, k in zip(ids, known, strict=True)], lengths, WaveletMatrix(
        length, planes, zeros.tolist())


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The library's tokenizer, the bytes of each id and the added tokens, once in a worker; Spark's tasks are its threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    sizes = np.zeros(library.get_vocab_size(), np.int64)
    for token, number in library.get_vocab().items():
        sizes[number] = len(token)
    return library, sizes, [t.content for t in library.get_added_tokens_decoder().values()]


#: What a byte is: 1 white space that may begin a piece, 2 ASCII letter or digit, 3 other visible ASCII character.
KIND = np.zeros(256, np.uint8)
KIND[33:127] = 3
KIND[[9, 10, 13, 32]] = 1
KIND[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2


def _solid(last: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Whether bytes that end with these surely end no white space.

    White space of several bytes begins with C2, E1, E2 or E3; no character that does counts as solid.
    """
    return (last > 32) & (second != 0xC2) & ~((last >= 0x80) & (second >= 0x80) & (third >= 0xE1) & (third <= 0xE3))


def _begins(data: np.ndarray) -> np.ndarray:
    """Where a token must begin: at white space behind a solid character, at a mark behind a letter or digit."""
    last, second, third = (np.concatenate([np.zeros(k, np.uint8), data[:-k]])[:len(data)] for k in (1, 2, 3))
    kind = KIND[data]
    word = (KIND[last] == 2) | ((second == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))
    return ((kind == 1) & _solid(last, second, third)) | ((kind == 3) & word)


def _inner(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which pieces begin with white space and end with a solid character, so that they may stand in a row."""
    last = [np.where(offsets[1:] - k >= offsets[:-1], data[np.maximum(offsets[1:] - k, 0)], 0) for k in (1, 2, 3)]
    return (KIND[data[offsets[:-1]]] == 1) & _solid(*last)


def _several(library, sizes: np.ndarray, pieces: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The ids of inner pieces, encoded some hundreds in a row and cut by their bytes."""
    offsets, data = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1), pieces.buffers()[2]
    cuts = list(range(0, len(pieces), JOINED)) + [len(pieces)]
    joined = [data[offsets[a]:offsets[b]].to_pybytes().decode() for a, b in zip(cuts, cuts[1:])]
    found = [np.array(e.ids, np.uint32) for e in library.encode_batch_fast(joined, add_special_tokens=False)]
    counts = np.zeros(len(pieces), np.int64)
    for ids, a, b in zip(found, cuts, cuts[1:], strict=False):
        reached, ends = np.cumsum(sizes[ids]), offsets[a + 1:b + 1] - offsets[a]
        at = np.searchsorted(reached, ends)
        if not np.array_equal(reached[at], ends):
            raise ValueError("a token goes over the end of a piece")
        counts[a:b] = np.diff(at + 1, prepend=0)
    return found, counts


def encode(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some texts in a row, and their number per text.

    Texts are cut where a token must begin (those with an added token's characters are
    not), equal pieces are merged, and each distinct piece is encoded once; nothing is
    remembered from one call to the next.
    """
    library, sizes, added = tokenizer(path)
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    bounds, whole = bounds - bounds[0], texts.buffers()[2].slice(bounds[0]) if len(texts) and bounds[-1] > bounds[0] else b""
    data = np.frombuffer(whole, np.uint8)[:bounds[-1]]
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    begins = _begins(data)
    for token in added:
        for i in np.flatnonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False)):
            begins[bounds[i]:bounds[i + 1]] = False
    begins[bounds[:-1][bounds[:-1] < len(data)]] = True
    starts = np.flatnonzero(begins)
    pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [
        None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
    known, which = pieces.dictionary, pieces.indices.to_numpy()
    offsets = np.frombuffer(known.buffers()[1], np.int64, len(known) + 1)
    held = np.frombuffer(known.buffers()[2], np.uint8)
    inner = _inner(held, offsets)
    counts = np.zeros(len(known), np.int64)
    some = known.filter(pa.array(inner))
    many, counts[inner] = _several(library, sizes, some) if len(some) else ([], 0)
    others = [np.array(e.ids, np.uint32) for e in library.encode_batch_fast(
        known.filter(pa.array(~inner)).to_pylist(), add_special_tokens=False)]
    counts[~inner] = [len(o) for o in others]
    flat = np.concatenate([np.zeros(0, np.uint32), *many, *others])
    place = np.empty(len(known), np.int64)
    order = np.concatenate([np.flatnonzero(inner), np.flatnonzero(~inner)])
    place[order] = np.cumsum(counts[order]) - counts[order]
    n = counts[which]
    ids = flat[np.arange(n.sum()) + np.repeat(place[which] - (np.cumsum(n) - n), n)]
    of = np.searchsorted(bounds, starts, "right") - 1
    return ids, np.bincount(of, n, len(texts)).astype(np.int64)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``TEXT_BYTES`` of text, one text at least."""
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXT_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def _shards(path: str, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END], np.uint32)
        docs, lengths, parts, held, place, number = [], [], [], 0, None, 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "slice": pa.array([place], pa.int32()), "shard": pa.array([number], pa.int32()),
                "n_tokens": pa.array([held], pa.int64()),
                "file": pa.array([to_file(docs, lengths, np.concatenate(parts))], pa.binary())})

        for batch in (part for whole in batches for part in _parts(whole)):
            every, counts = encode(path, batch.column("text"))
            each = np.split(every, np.cumsum(counts)[:-1])
            for where, doc, ids in zip(batch.column("slice").to_pylist(), batch.column("doc_id").to_pylist(), each, strict=True):
                if docs and (held >= shard_tokens or where != place):
                    yield shard()
                    docs, lengths, parts, held, number = [], [], [], 0, number + 1
                place = where
                docs.append(doc)
                lengths.append(len(ids) + 1)
                parts += [ids, end]
                held += len(ids) + 1
        if docs:
            yield shard()

    return run


def write_shards(docs: DataFrame, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(slice, shard, n_tokens, file), one written part for each shard; (slice, shard) ascends with doc_id."""
    frame, n = texts(docs), tasks(docs.sparkSession)
    sliced = frame.withColumn("slice", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(
        slice_of(F.col("doc_id"), id_cuts(frame, "doc_id", n))))
    ordered = sliced.repartitionById(n, F.col("slice")).sortWithinPartitions("slice", "doc_id", "text")
    rows = ordered.mapInArrow(_shards(tokenizer, shard_tokens), "slice int, shard int, n_tokens long, file binary")
    return saved(rows, "shards", maxRecordsPerFile=1)


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    per = shards.groupBy("slice").agg(F.sum("n_tokens").alias("n"))
    earlier = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("slice").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    base = per.select("slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    starts = shards.select("slice", "shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("skip")).join(
        base, "slice").select("slice", "shard", (F.col("base") + F.col("skip")).alias("start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, number, row in zip(*[batch.column(c) for c in ("slice", "shard", "file")], strict=True):
                ids, lengths, matrix = from_file(row.as_py())
                tokens = matrix.tokens()
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(tokens[e - k:e].astype("<u4").tobytes()) for e, k in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array([where.as_py()] * len(ids), pa.int32()),
                    "shard": pa.array([number.as_py()] * len(ids), pa.int32()),
                    "doc_id": pa.array(ids, pa.int64()), "skip": pa.array(ends - lengths, pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    read = shards.select("slice", "shard", "file").mapInArrow(
        decode, "slice int, shard int, doc_id long, skip long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["slice", "shard"]).select(
        "doc_id", (F.col("start") + F.col("skip")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    return read_shards(write_shards(docs, tokenizer))
