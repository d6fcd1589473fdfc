"""Block statistics of a stream of labelled cells: the moments add up, so an update-mode aggregate keeps them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.operators.blocks import moments


def streaming_block_stats(labelled: DataFrame, d: int, *keys: str, time: str | None = None, window: str | None = None, late: str = "10 minutes") -> DataFrame:
    """n, mean and scatter by ``keys`` ((k, l) if none), in event-time windows if ``time`` and ``window`` are given."""
    keys = keys or ("k", "l")
    if time and window:
        return labelled.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(*moments(d))
    return labelled.groupBy(*keys).agg(*moments(d))
