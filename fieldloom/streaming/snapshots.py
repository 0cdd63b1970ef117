"""Streaming front-end: snapshots arrive, records and daily health statistics leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.stats import fill_rate
from fieldloom.sources import extract


def extracted_stream(snapshots: DataFrame, spec: dict) -> DataFrame:
    """Long hits of a stream of (site, run_id, fetched_at, html); stateless, one pass for each page."""
    return extract.hits(snapshots, spec, ["site", "run_id", "fetched_at"])


def fill_by_window(results: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Fill rate of each field and time window of a stream of results; rows later than ``late`` are left out."""
    held = results.withWatermark("fetched_at", late)
    return held.groupBy(F.window("fetched_at", width), "site", "field").agg(F.count("*").alias("n"), fill_rate(F.col("value")).alias("fill"))
