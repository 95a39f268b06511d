"""Prepared tables: what a refresh builds, what it leaves, and writers at the same time."""

import random

import pytest
from pyspark.sql import functions as F

from driftwise.sources import prepared

ROW = "k long, v string"
WIDTH = 100


class Source:
    """A table in memory and how often its slices were built."""

    def __init__(self, spark, folder, rows, shared=""):
        self.spark, self.folder, self.rows, self.shared, self.built = spark, folder, list(rows), shared, []

    def frame(self):
        return self.spark.createDataFrame(self.rows, ROW).repartition(3)

    def refresh(self, snapshot):
        def build(width, slices):
            self.built.append(sorted(slices))
            return self.frame().withColumn("slice", prepared.slice_of(F.col("k"), width)).filter(F.col("slice").isin(slices))

        return prepared.refresh(
            self.spark, self.folder, snapshot, lambda: max((k for k, _ in self.rows), default=None),
            lambda width: prepared.digests(self.frame().filter("k is not null"), "k", width, self.shared), build)

    def read(self, manifest):
        return sorted(tuple(r) for r in prepared.read(self.spark, manifest, self.frame().schema).collect())


@pytest.fixture
def source(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prepared, "LEAST_WIDTH", WIDTH)
    r = random.Random(1)
    return Source(spark, str(tmp_path), [(k, str(r.random())) for k in range(0, 1000, 3)])


def files(tmp_path):
    return {p for p in tmp_path.glob("slices/*/*/*.parquet")}


def test_only_the_changed_slices_are_built(source, tmp_path):
    first = source.refresh("a")
    assert source.built == [list(range(10))] and source.read(first) == sorted(source.rows)
    before = files(tmp_path)
    assert source.refresh("a") == first and len(source.built) == 1, "an unchanged listing reads nothing"

    source.rows[150] = (450, "changed")
    source.rows.append((451, "new"))
    second = source.refresh("b")
    assert source.built[1:] == [[4]] and source.read(second) == sorted(source.rows)
    added = files(tmp_path) - before
    assert len(added) == 1 and before <= files(tmp_path), "one file more, and none taken away"
    assert source.read(first) != source.read(second), "an older manifest still reads its own slices"


def test_touched_files_with_equal_rows_build_nothing(source):
    first = source.refresh("a")
    random.Random(2).shuffle(source.rows)
    again = source.refresh("b")
    assert len(source.built) == 1 and again.slices == first.slices and again.snapshot == "b"


def test_a_slice_that_goes_away_and_shared_sources(source):
    source.refresh("a")
    source.rows = [r for r in source.rows if r[0] < 800]
    less = source.refresh("b")
    assert len(source.built) == 1 and source.read(less) == sorted(source.rows)
    source.shared = "other products"
    source.refresh("c")
    assert source.built[1:] == [list(range(8))]


def test_two_writers_publish_whole_manifests(spark, source, tmp_path, monkeypatch):
    source.refresh("a")
    other = Source(spark, source.folder, source.rows)
    other.rows[0] = (0, "theirs")
    source.rows[200] = (600, "ours")
    # The other writer publishes between this one's reading of the last manifest and its own.
    plain = prepared.publish

    def late(spark_, folder, manifest):
        monkeypatch.setattr(prepared, "publish", plain)
        other.refresh("theirs")
        plain(spark_, folder, manifest)

    monkeypatch.setattr(prepared, "publish", late)
    ours = source.refresh("ours")
    assert len(list(tmp_path.glob("manifests/0000000001-*"))) == 2
    held = prepared.latest(spark, source.folder)
    mine = source.read(ours) == sorted(source.rows)
    assert mine and held.snapshot in ("ours", "theirs")
    assert source.read(held) == sorted((source if held.snapshot == "ours" else other).rows)
    # Whoever comes next finds a whole table and mends what differs.
    last = source.refresh("again")
    assert source.read(last) == sorted(source.rows)


def test_a_build_that_dies_leaves_the_last_table(spark, source, monkeypatch):
    first = source.refresh("a")
    source.rows[3] = (9, "changed")

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(prepared, "publish", dies)
    with pytest.raises(RuntimeError):
        source.refresh("b")
    monkeypatch.undo()
    assert prepared.latest(spark, source.folder) == first


def test_wider_slices_for_more_keys_and_nothing_at_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prepared, "LEAST_WIDTH", 10)
    monkeypatch.setattr(prepared, "SLICES", 4)
    assert [prepared.width_for(n) for n in (None, 0, 39, 40, 1000)] == [10, 10, 10, 20, 320]
    grows = Source(spark, f"{tmp_path}/grows", [(k, "x") for k in range(30)])
    grows.refresh("a")
    grows.rows += [(k, "x") for k in range(30, 100)]
    last = grows.refresh("b")
    assert last.width == 40 and grows.read(last) == sorted(grows.rows)
    none = Source(spark, f"{tmp_path}/none", [])
    assert none.read(none.refresh("a")) == [] and none.built == []
    assert prepared.latest(spark, f"{tmp_path}/nowhere") is None
