"""Seconds of the stages of a run, and names for them where Spark shows its jobs."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Stages:
    """Stages in the order in which they ended: name, seconds and rows, if a stage tells them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.done = spark, []

    @contextmanager
    def stage(self, name: str) -> Iterator[dict]:
        told: dict = {}
        self.spark.sparkContext.setJobDescription(name)
        began = time.monotonic()
        try:
            yield told
        finally:
            self.spark.sparkContext.setJobDescription(None)
            self.done.append((name, time.monotonic() - began, told.get("rows")))

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.done, "stage string, seconds double, rows long")
