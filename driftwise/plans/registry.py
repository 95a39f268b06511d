"""Where the named jobs are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftwise.sources.estate import Estate

JOBS: dict[str, Callable[[Estate], DataFrame]] = {}


def job(name: str):
    """Register a job under a name; it receives the tables and returns a frame."""
    def keep(build: Callable[[Estate], DataFrame]) -> Callable[[Estate], DataFrame]:
        if name in JOBS:
            raise ValueError(f"job {name!r} is registered twice")
        JOBS[name] = build
        return build
    return keep


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, root: str) -> DataFrame:
        return JOBS[name](Estate(spark, root))
    run.__name__ = name
    return run
