"""WARC files of pages, and a two-level index of their captures.

``write`` puts one record per page into gzip-per-record WARC files. Pages of equal payload
have one response, that of the largest page_id, and revisits of it. ``index`` sorts the
captures by reversed-host key into shards; a shard is a file of compressed blocks of lines,
and at its end a sparse directory with the first key of each block. ``lookup`` sends each
key to the shards whose range holds it, finds the first block by binary search in the
directory and the first line by binary search in the block, and only then do ranges of the
archives get read, in order of file and place.

Files are written by the tasks under names of their own, and only those that a finished
task reported are ever read, so a task that is run again leaves no trace. They lie in the
folder of spark.checkpoint.dir, reached through Arrow's file systems (local, HDFS, S3).

Cases: a null html is an empty payload and a null url an empty one; pages without id are
smaller than all others; rows that tie on the largest page_id of a payload are all
responses; keys drop the scheme, a default port, the fragment and case in the host, and
``lookup`` returns every capture of a key; an empty table gives an empty archive whose
look-ups return nothing; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import saved, shared_folder, tasks

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: Date of all records, since pages have none: the archive of a table is always the same.
DATE = "1970-01-01T00:00:00Z"
#: A file is closed once it holds so many bytes.
FILE_BYTES = 1 << 28
LINES = 256
#: Captures of an index shard; and most shards there are, beyond which they grow instead.
SHARD_CAPTURES, SHARDS = 1 << 12, 1 << 16
#: Characters of a shard's first and last key that the routing table keeps: 32 MB of characters at most.
ROUTED = 256
#: Bytes that one range read takes at least; captures within so many bytes go to one task.
READ, SPAN = 1 << 18, 1 << 24
LEVEL = 6
BATCH = 1 << 10

PLACE = "key string, page_id long, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"




def clean(url: str | None) -> str:
    """The URL with blanks and control characters escaped, so that it fits in a header and a line."""
    return re.sub(r"[\x00-\x20\x7F]", lambda c: f"%{ord(c[0]):02X}", url or "")


def url_key(url: str | None) -> str:
    """net,example,host)/path?query of a URL."""
    rest = clean(url).partition("#")[0]
    scheme, found, after = rest.partition("://")
    if found:
        rest = after
    cut = re.search(r"[/?]", rest)
    host, path = (rest[:cut.start()], rest[cut.start():]) if cut else (rest, "")
    host = host.rpartition("@")[2].lower()
    port = {"http": ":80", "https": ":443"}.get(scheme.lower()) if found else None
    host = host.removesuffix(port) if port else host
    return ",".join(reversed(host.split("."))) + ")" + (path if path.startswith("/") else "/" + path)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _head(first: str, fields: list[tuple[str, object]]) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def _named(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def record(page_id, url, payload: bytes, digest: str, refers_to, response: bool, place: str) -> bytes:
    """One record; a revisit has the full payload's headers and digest without its bytes."""
    block = _head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    fields = [("WARC-Type", "response" if response else "revisit"),
              ("WARC-Record-ID", _named(page_id, digest) if response else _named("revisit", place)),
              ("WARC-Date", DATE), ("WARC-Target-URI", clean(url) if url is not None else None),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id)]
    if response:
        block += payload
    else:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", _named(refers_to, digest)), ("X-Refers-To-Page-ID", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return _head("WARC/1.1", fields) + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parsed(raw: bytes) -> dict:
    """The columns of RECORD and the payload, of one record; its lengths and digest are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[:int(fields["Content-Length"])]
    told, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(_fields(told)["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if rest[len(block):] != b"\r\n\r\n" or (response and (len(payload), base32(hashlib.sha1(payload).digest())) != (size, digest)):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page, other = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    return {"page_id": None if page is None else int(page), "url": fields.get("WARC-Target-URI"),
            "record_type": fields["WARC-Type"], "payload_digest": digest, "payload_bytes": size,
            "refers_to": None if other is None else int(other), "payload": payload if response else None}


def _written(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        sink, name, at = None, None, 0
        try:
            for batch in batches:
                rows = []
                for row in zip(*batch.columns, strict=True):
                    page_id, url, payload, sha, top, response = (v.as_py() for v in row)
                    if sink is None or at >= FILE_BYTES:
                        if sink:
                            sink.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        sink = system.open_output_stream(f"{root}/{name}", compression=None)
                    data = record(page_id, url, payload, base32(bytes.fromhex(sha)), top, response, f"{name}/{at}")
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = packer.compress(data) + packer.flush()
                    sink.write(member)
                    rows.append((url_key(url), page_id, name, at, len(member)))
                    at += len(member)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (
                        pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                    ["key", "page_id", "file", "offset", "length"])
        finally:
            if sink:
                sink.close()

    return run


def _made(system: fs.FileSystem, root: str) -> None:
    system.create_dir(root, recursive=True)


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(key, page_id, file, offset, length) of the record of every page, written to WARC files in the folder."""
    _made(*fs.FileSystem.from_uri(folder))
    each = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
        F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload"))
    hashed = each.withColumn("sha", F.sha1("payload"))
    # Counted on the map side first; only payloads that several pages have are joined to the pages.
    shared = hashed.select("page_id", "sha", F.length("payload").alias("size")).filter(F.col("size") >= least_bytes).groupBy("sha").agg(
        F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1").drop("n").withColumn("several", F.lit(True))
    marked = hashed.join(shared, "sha", "left").select(
        "page_id", "url", "payload", "sha", "top", (F.col("several").isNull() | F.col("page_id").eqNullSafe(F.col("top"))).alias("response"))
    return saved(marked.mapInArrow(_written(folder), PLACE), "captures")


def _blocks(folder: str, lines: int):
    """Writes the sorted captures of a partition as one index shard and tells its range of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        sink, name, at, held, directory, last = None, None, 0, [], [], None

        def close_block() -> None:
            nonlocal at, held
            packed = zlib.compress("\n".join(json.dumps(r) for r in held).encode(), LEVEL)
            sink.write(packed)
            directory.append((held[0][0], at, len(packed)))
            at += len(packed)
            held = []

        try:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if sink is None:
                        name = f"{uuid.uuid4().hex}.idx"
                        sink = system.open_output_stream(f"{root}/{name}", compression=None)
                    held.append(row)
                    last = row[0]
                    if len(held) == lines:
                        close_block()
            if sink:
                if held:
                    close_block()
                packed = zlib.compress(json.dumps(directory).encode(), LEVEL)
                sink.write(packed + struct.pack("<QQ", at, len(packed)))
                yield pa.RecordBatch.from_pydict({
                    "file": pa.array([name]), "first": pa.array([directory[0][0]]), "last": pa.array([last])})
        finally:
            if sink:
                sink.close()

    return run


def index(captures: DataFrame, folder: str, lines: int = LINES, shard_captures: int = SHARD_CAPTURES) -> DataFrame:
    """(file, first, last): the index shards written to the folder, and their ranges of keys."""
    _made(*fs.FileSystem.from_uri(folder))
    shards = max(1, min(SHARDS, -(-captures.count() // shard_captures)))
    order = ("key", "page_id", "file", "offset")
    ranged = captures.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return saved(ranged.mapInArrow(_blocks(folder, lines), "file string, first string, last string"), "shards")


class Shard:
    """An index shard, of which only the directory and the block last asked for are held."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.file = system.open_input_file(path)
        size = self.file.size()
        at, length = struct.unpack("<QQ", self.file.read_at(16, size - 16))
        self.directory = json.loads(zlib.decompress(self.file.read_at(length, at)))
        self.firsts = [d[0] for d in self.directory]
        self.number, self.block = None, []

    def _block(self, number: int) -> list:
        if number != self.number:
            _, at, length = self.directory[number]
            lines = zlib.decompress(self.file.read_at(length, at)).decode().split("\n")
            self.number, self.block = number, [json.loads(x) for x in lines]
        return self.block

    def captures(self, key: str) -> Iterator[list]:
        """All lines of a key, the first found by binary search in the directory and in its block."""
        number = max(0, bisect_left(self.firsts, key) - 1)
        while number < len(self.firsts) and self.firsts[number] <= key:
            block = self._block(number)
            at = bisect_left(block, key, key=lambda row: row[0])
            while at < len(block) and block[at][0] == key:
                yield block[at]
                at += 1
            if at < len(block):
                return
            number += 1


def _routed(ranges: list[tuple[str, str, str]]):
    """(key, shard) of every key and shard whose range may hold it; ranges are in order and overlap at their ends only."""
    lasts = [r[1] for r in ranges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names = [], []
            for key in batch.column("key").to_pylist():
                cut = key[:ROUTED]
                at = bisect_left(lasts, cut)
                while at < len(ranges) and ranges[at][0] <= cut:
                    keys.append(key)
                    names.append(ranges[at][2])
                    at += 1
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "shard": pa.array(names, pa.string())})

    return run


def _searched(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        name, shard, rows = None, None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (
                    pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                ["key", "page_id", "file", "offset", "length"])

        for batch in batches:
            for where, key in zip(batch.column("shard").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if where != name:
                    name, shard = where, Shard(system, f"{root}/{where}")
                for row in shard.captures(key):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield out()
                        rows = []
        yield out()

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"key": pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string())})


def lookup(urls: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """(key, page_id, file, offset, length) of all captures of the keys of the column url."""
    # At most SHARDS rows of two cut keys.
    bounds = shards.select(F.left("first", F.lit(ROUTED)).alias("first"), F.left("last", F.lit(ROUTED)).alias("last"), "file").collect()
    ranges = sorted((r.first, r.last, r.file) for r in bounds)
    asked = urls.select(urls["url"].cast("string").alias("url")).distinct().mapInArrow(_keys, "key string").distinct()
    sent = asked.mapInArrow(_routed(ranges), "key string, shard string")
    dealt = sent.repartition(tasks(urls.sparkSession), "shard").sortWithinPartitions("shard", "key")
    return dealt.mapInArrow(_searched(folder), PLACE)


def _fetched(folder: str, payload: bool):
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    if payload:
        names, kinds = [*names, "payload"], [*kinds, pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        name, source, start, held = None, None, 0, b""
        for batch in batches:
            rows, size = [], 0
            for where, at, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if where != name:
                    if source:
                        source.close()
                    name, source, start, held = where, system.open_input_file(f"{root}/{where}"), 0, b""
                if at < start or at + length > start + len(held):
                    start, held = at, source.read_at(max(length, READ), at)
                row = parsed(zlib.decompress(held[at - start:at - start + length], 31))
                rows.append({n: row[n] for n in names})
                size += row["payload_bytes"] if payload else 0
                if size > FILE_BYTES >> 4:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def fetch(captures: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records at (file, offset, length), read as ranges in order of file and offset; revisits have no payload of their own."""
    spans = captures.select("file", "offset", "length", F.expr(f"offset div {SPAN}").alias("span"))
    ordered = spans.repartition(tasks(captures.sparkSession), "file", "span").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_fetched(folder, payload), RECORD + (", payload binary" if payload else ""))


def archived(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Every page's record: written, indexed, found by its URL in the index and read back."""
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    captures = write(pages, folder, least_bytes)
    shards = index(captures, folder)
    return fetch(lookup(pages, shards, folder), folder, payload=False)
