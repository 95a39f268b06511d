"""A prepared table kept up to date: only slices whose sources changed are built again.

A table is cut into slices by its key. A manifest names, for every slice, a digest of its
source rows and the folder that holds it. A refresh compares digests, builds the changed
slices in one job, and publishes a new manifest as one file, which appears whole or not at
all. Nothing is ever overwritten: who reads an older manifest still finds its slices, a
build that dies leaves only files no manifest names, and of two writers at once each
publishes a whole manifest, of which readers take the later, or the one of the larger name.

Where the listing of the sources is that of the last manifest, no source row is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Slices of a table at most, so that a manifest stays small; slices of a key are this many keys wide at least.
SLICES, LEAST_WIDTH = 4096, 1 << 14
MANIFEST = "seq long, writer string, snapshot string, width long, slice long, digest string, folder string"


class Manifest(NamedTuple):
    seq: int
    snapshot: str
    width: int
    #: slice to (digest, folder)
    slices: dict[int, tuple[str, str]]


def slice_of(key: Column, width: int) -> Column:
    return F.floor(key.cast("long") / F.lit(width)).cast("long")


def digests(frame: DataFrame, key: str, width: int, constant: str = "") -> DataFrame:
    """(slice, digest) of the rows of a source, whatever their order; constant stands for sources that all slices share."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(frame.columns)])
    told = frame.select(slice_of(F.col(key), width).alias("slice"), row.alias("h")).groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
    return told.select("slice", F.sha2(F.concat_ws("|", "n", "x", "s", F.lit(constant)), 256).alias("digest"))


def whole_digest(frames: list[DataFrame]) -> str:
    """One digest of small tables, in the order given."""
    out = []
    for frame in frames:
        row = frame.select(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(frame.columns)]).alias("h"))
        out.append(str(tuple(row.agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first())))
    return "|".join(out)


def latest(spark: SparkSession, folder: str) -> Manifest | None:
    """The manifest published last; half-written ones have no file yet."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifests/*")
        top = rows.agg(F.max(F.struct("seq", "writer")).alias("top")).first().top
    except AnalysisException:
        return None
    if top is None:
        return None
    held = rows.filter((F.col("seq") == top.seq) & (F.col("writer") == top.writer)).collect()
    return Manifest(top.seq, held[0].snapshot, held[0].width, {r.slice: (r.digest, r.folder) for r in held if r.slice is not None})


def publish(spark: SparkSession, folder: str, manifest: Manifest) -> None:
    writer = uuid.uuid4().hex
    rows = [(manifest.seq, writer, manifest.snapshot, manifest.width, k, d, f) for k, (d, f) in manifest.slices.items()] \
        or [(manifest.seq, writer, manifest.snapshot, manifest.width, None, None, None)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{folder}/manifests/{manifest.seq:010d}-{writer}")


def width_for(largest: int | None) -> int:
    width = LEAST_WIDTH
    while (largest or 0) // width >= SLICES:
        width *= 2
    return width


def refresh(spark: SparkSession, folder: str, snapshot: str, largest: Callable[[], int | None],
            told: Callable[[int], DataFrame], build: Callable[[int, list[int]], DataFrame]) -> Manifest:
    """The manifest for the sources as they are, after building the slices that changed.

    largest gives the largest key; told(width) the (slice, digest) of all sources; and
    build(width, slices) the rows of these slices, with a column ``slice``.
    """
    last = latest(spark, folder)
    if last and last.snapshot == snapshot:
        return last
    width = width_for(largest())
    if last and last.width >= width:
        width = last.width
    known = last.slices if last and last.width == width else {}
    now = {r.slice: r.digest for r in told(width).collect()}
    changed = [k for k, d in now.items() if k not in known or known[k][0] != d]
    part = f"{folder}/slices/{uuid.uuid4().hex}"
    if changed:
        build(width, changed).repartition("slice").write.partitionBy("slice").parquet(part)
    slices = {k: (d, part if k in changed else known[k][1]) for k, d in now.items()}
    fresh = Manifest(last.seq + 1 if last else 0, snapshot, width, slices)
    publish(spark, folder, fresh)
    return fresh


def read(spark: SparkSession, manifest: Manifest, schema: StructType) -> DataFrame:
    """The rows of all slices; a folder of several builds is read only for the slices the manifest names there."""
    parts: dict[str, list[int]] = {}
    for k, (_, folder) in manifest.slices.items():
        parts.setdefault(folder, []).append(k)
    frame = None
    for folder, slices in sorted(parts.items()):
        rows = spark.read.schema(schema.add("slice", "long") if "slice" not in schema.names else schema).parquet(folder)
        rows = rows.filter(F.col("slice").isin(slices)).drop("slice")
        frame = rows if frame is None else frame.unionByName(rows)
    return frame if frame is not None else spark.createDataFrame([], schema).drop("slice")
