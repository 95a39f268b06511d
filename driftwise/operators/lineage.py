"""Declared row transforms, row and column policy, and materialised stages."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftwise.session import shared_folder


class PolicyError(ValueError):
    """A contract asks for something that cannot be honoured."""


def dedupe_order_id(frame: DataFrame, key: Sequence[str] = ("order_id",),
                    order: Sequence[str] = ("order_ts",)) -> DataFrame:
    """Keep the first row per key under a total order.

    Remaining columns break ties, so two runs keep the same row. The filter on
    row_number lets Spark drop all but one row per key before the shuffle.
    """
    ties = [c for c in frame.columns if c not in key and c not in order]
    first = Window.partitionBy(*key).orderBy(*order, *ties)
    return frame.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def tz_normalise(frame: DataFrame, region: str = "East",
                 offset: str = "interval 5 hours 30 minutes") -> DataFrame:
    """Move the one region that records local time back to the common clock."""
    return frame.withColumn("order_ts", F.when(
        F.col("region") == region, F.col("order_ts") - F.expr(offset)).otherwise(F.col("order_ts")))


def exclude_test_accounts(frame: DataFrame) -> DataFrame:
    return frame.filter(~F.col("is_test"))


def digital_channels_only(frame: DataFrame, channels: Sequence[str] = ("web", "app")) -> DataFrame:
    return frame.filter(F.col("channel").isin(*channels))


def identity(frame: DataFrame) -> DataFrame:
    """A declared step whose work is already done by the metric's own predicate."""
    return frame


TRANSFORMS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "dedupe_order_id": dedupe_order_id,
    "tz_normalise": tz_normalise,
    "net_returns": identity,
    "exclude_test_accounts": exclude_test_accounts,
    "digital_channels_only": digital_channels_only,
    "exclude_in_flight": identity,
}


def apply_chain(frame: DataFrame, chain: Iterable[str], **overrides: Callable) -> DataFrame:
    """Apply declared transforms in declared order; an unknown name is an error."""
    steps = {**TRANSFORMS, **overrides}
    names = list(chain)
    for name in names:
        if name not in steps:
            raise PolicyError(f"transform {name!r} is declared but not implemented")
    return reduce(lambda out, name: out.transform(steps[name]), names, frame)


def stage_name(base: str, chain: Sequence[str]) -> str:
    """A folder name that changes when the base or anything in the chain does."""
    return f"prepared_{base}_{hashlib.sha256('|'.join((base, *chain)).encode()).hexdigest()[:12]}"


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; its schema is read from the files once per application."""
    held = (spark.sparkContext.applicationId, path)
    if held not in _SCHEMAS:
        _SCHEMAS[held] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[held]).parquet(path)


def snapshot(spark: SparkSession, root: str) -> str:
    """A short digest of the source files' number, sizes and times.

    Read from the file listing alone: the contents column is never asked for.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    seen = listing.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime")).first()
    return hashlib.sha256(f"{root}|{tuple(seen)}".encode()).hexdigest()[:12]


def materialise(spark: SparkSession, build: Callable[[], DataFrame], base: str,
                chain: Sequence[str] = (), options: dict[str, str] | None = None) -> DataFrame:
    """Write a prepared table once to the shared folder and read it from there.

    A second call with the same base and chain reads what is there and builds
    nothing, so every job on one fact table pays for its lineage once. The
    written files also cut lineage: a lost executor costs a re-read, not a
    recomputation. The marker is written last, so a half-written table is never
    taken for whole.
    """
    path = f"{shared_folder(spark)}/{stage_name(base, chain)}"
    try:
        spark.read.schema("id bigint").parquet(f"{path}/done")
    except AnalysisException:
        build().write.mode("overwrite").options(**(options or {})).parquet(f"{path}/rows")
        spark.range(1).write.mode("overwrite").parquet(f"{path}/done")
    return read_table(spark, f"{path}/rows")


def entitled(frame: DataFrame, regions: Sequence[str] | None) -> DataFrame:
    """Rows a reader may see. None means unrestricted; an empty list is refused."""
    if regions is None:
        return frame
    if not regions:
        raise PolicyError("an empty entitlement grants access to nothing")
    if "region" not in frame.columns:
        raise PolicyError("the row policy names region, which this table does not carry")
    return frame.filter(F.col("region").isin(*regions))


def masked(frame: DataFrame, masks: Iterable[str]) -> DataFrame:
    """Drop the columns a policy masks, where they are present."""
    return frame.drop(*[c for c in frame.columns if c in set(masks)])


def narrowed(frame: DataFrame, slice_: dict[str, str]) -> DataFrame:
    """Equality per dimension; a dimension the frame lacks is an error."""
    for dimension, value in slice_.items():
        if dimension not in frame.columns:
            raise PolicyError(f"{dimension} is declared but this frame does not carry it")
        frame = frame.filter(F.col(dimension) == value)
    return frame


def replicated(frame: DataFrame, copies: int, id_columns: Sequence[str]) -> DataFrame:
    """The same facts ``copies`` times over, under new regions and ids."""
    out = frame.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    for column in (*id_columns, "region"):
        out = out.withColumn(column, F.concat(F.col(column).cast("string"), F.lit("-r"),
                                              F.col("copy").cast("string")))
    return out


def freshness(readings: DataFrame, sla: DataFrame) -> DataFrame:
    """Lag of each declared source against its limit.

    A source with no reading counts as an hour past its limit, never as fresh.
    """
    hours = F.expr("timestampdiff(SECOND, as_of, observed_at) / 3600.0D")
    lag = F.coalesce(hours, F.col("sla_hours") + 1.0)
    return sla.join(readings, "source_id", "left").select(
        "kpi_id", "source_id", "sla_hours", lag.alias("lag_hours"),
        (lag <= F.col("sla_hours")).alias("sla_met"),
    )


def dimension_values(frame: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Distinct non-null values of each dimension in one pass over the facts."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
        for d in dims
    ]))
    return frame.select(pairs.alias("p")).select("p.*").filter("value is not null").distinct()


def latest_day(*dated: tuple[DataFrame, str]) -> DataFrame:
    """The last day any of the given tables carries."""
    parts = [f.agg(F.max(F.to_date(c)).alias("day")) for f, c in dated]
    return reduce(DataFrame.unionByName, parts).agg(F.max("day").alias("latest_day"))
