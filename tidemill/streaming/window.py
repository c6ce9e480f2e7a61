"""The recurring ingest window as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, hours: float, id_col: str = "id", time_col: str = "published_at") -> DataFrame:
    """Items once within the window: state is dropped as the watermark passes. A stronger promise than the batch form's."""
    return stream.withWatermark(time_col, f"{int(hours * 3600)} seconds").dropDuplicatesWithinWatermark([id_col])


def daily_issues(stream: DataFrame, hours: float, *keys: str, time_col: str = "published_at") -> DataFrame:
    """Counts by UTC day; late items within ``hours`` still count."""
    return stream.withWatermark(time_col, f"{int(hours * 3600)} seconds").groupBy(F.window(time_col, "1 day"), *keys).agg(F.count("*").alias("items")).select(F.to_date("window.start").alias("issue_day"), *keys, "items")
