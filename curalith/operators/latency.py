"""Timing of a callable in the shape of the latency summary."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curalith.operators.history import latency


def benchmark(spark: SparkSession, operation: Callable[[], object], *, warmup: int = 10, measured: int = 100, target_ms: float = 5000.0, clock: Callable[[], float] = time.perf_counter) -> tuple[list[float], DataFrame]:
    """(raw milliseconds, one-row summary) of ``measured`` calls after ``warmup`` ones."""
    for name, value in (("warmup", warmup), ("measured", measured)):
        if isinstance(value, bool) or not isinstance(value, int) or value < (name == "measured"):
            raise ValueError(f"{name} must be a positive integer, not {value!r}")
    for _ in range(warmup):
        operation()
    raw = []
    for _ in range(measured):
        began = clock()
        operation()
        raw.append((clock() - began) * 1000.0)
    return raw, latency(spark.createDataFrame([(x,) for x in raw], "ms double"), "ms", target_ms)
