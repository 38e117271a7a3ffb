"""Quality of a stream by windows of event time. An addition of ours: the same partial sums, with a watermark.

Late rows beyond the watermark are dropped by Spark; state is one row of sums for each open window and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.completeness import present


def monitor(stream: DataFrame, time: str, columns: Sequence[str], *, window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes", by: Sequence[str] = ()) -> DataFrame:
    """Of each window and group: rows, completeness of each column, and mean, standard deviation and about how many values of each number."""
    numbers = [c for c, kind in stream.dtypes if c in columns and kind in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    aggregates = [F.count(F.lit(1)).alias("rows")]
    aggregates += [(F.count_if(present(stream, c)) / F.count(F.lit(1))).alias(f"completeness_{c}") for c in columns]
    aggregates += [F.approx_count_distinct(f"`{c}`").alias(f"{c}_about_distinct") for c in columns]
    for c in numbers:
        v = F.when(present(stream, c), F.col(f"`{c}`"))
        aggregates += [F.avg(v).alias(f"{c}_mean"), F.stddev_pop(v).alias(f"{c}_std")]
    span = F.window(time, window, slide) if slide else F.window(time, window)
    if stream.isStreaming:
        stream = stream.withWatermark(time, delay)
    out = stream.groupBy(span.alias("window"), *by).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(c for c in out.columns if c != "window"))
