"""Streaming level counts (T1); alert damping (T2) is in ``damping``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causetrace.sources.logs import COUNTS, level_counts


def stream_log_counts(logs: DataFrame, step: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts of each level per entity and bin. In append mode a bin appears once, when the watermark has passed its end, and its state goes; later rows of it are dropped and
    counted in the query's progress (``damping.late_rows``). Empty bins appear on reading (S7), not in the stream."""
    timed = logs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counts = timed.groupBy("entity", F.window("ts", step)).agg(*level_counts())
    total = F.col(COUNTS[0]) + F.col(COUNTS[1]) + F.col(COUNTS[2])
    return counts.select("entity", F.col("window.start").alias("ts"), *COUNTS[:3], total.alias(COUNTS[3]))
