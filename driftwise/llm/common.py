"""What the text operators share: shared-folder stages, document keys, exact slices."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id in keys, so that joins need no null-safe comparison.
NO_ID = -(2**63)
ID, HASH = "__dw_id", "__dw_hash"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one is made only where it is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="driftwise-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(frame: DataFrame, name: str, **options) -> DataFrame:
    """The frame written once to the shared folder and read back: later reads survive lost executors."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    frame.write.options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_column(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty ones; no other column is read."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_column(docs).alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """Every column of docs beside a key by which per-document results are joined back.

    Rows with equal id and text share a key and get the same result. A null id is
    a document of its own kind that sorts before all others.
    """
    return docs.withColumns({
        ID: F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)),
        HASH: F.xxhash64(text_column(docs)),
    })


def id_cuts(frame: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts - 1 ids that cut the rows into ranges of about equal size."""
    if parts < 2:
        return []
    row = frame.select(F.percentile_approx(
        column, [i / parts for i in range(1, parts)], max(1000, 20 * parts)).alias("q")).first()
    return sorted(set(row.q or []))


def slice_of(column: Column, cuts: list[int]) -> Column:
    """The range that an id falls in: how many cuts lie below it."""
    if not cuts:
        return F.lit(0)
    tree = [F.lit(i) for i in range(len(cuts) + 1)]

    def search(low: int, high: int) -> Column:
        if low == high:
            return tree[low]
        middle = (low + high) // 2
        return F.when(column <= F.lit(cuts[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(cuts))
