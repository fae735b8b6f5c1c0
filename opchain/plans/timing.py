"""Timing of steps, printed by verbosity and shown as job descriptions."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def timed(spark: SparkSession, label: str, output_level: int, least: int = 1) -> Iterator[None]:
    """Names the Spark jobs within, and prints the time they took if output_level is `least` or more."""
    context, began = spark.sparkContext, time.perf_counter()
    before = context.getLocalProperty("spark.job.description")
    context.setJobDescription(label)
    try:
        yield
    finally:
        context.setLocalProperty("spark.job.description", before)
        if output_level >= least:
            print(f"{label}: {time.perf_counter() - began:.3f} s", flush=True)
