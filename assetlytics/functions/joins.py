"""Join helpers with an explicit size check before broadcasting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

# A learned parameter table (one row per group) is broadcast only below this.
DEFAULT_MAX_BROADCAST_ROWS = 200_000


def checked_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Write ``df`` (a small aggregate) to the shared folder, count its rows (a
    partial count a task) and return a broadcast-hinted frame only when the
    bound holds; otherwise the plain frame, so the optimizer (with AQE) picks
    a shuffle join. The result is the same either way."""
    df = written(df, "lookup")
    return F.broadcast(df) if df.count() <= max_rows else df


def lookup_join(left: DataFrame, params: DataFrame, on, how: str = "left",
                max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    return left.join(checked_broadcast(params, max_rows), on, how)
