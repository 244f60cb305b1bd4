"""Slides as a stream: distinct URLs of a page, across batches; streaming.walk has the walk itself."""

from __future__ import annotations

from pyspark.sql import DataFrame


def first_urls(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Distinct (page_id, url) of a stream with a time column ts; state is let go behind the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["page_id", "url"])
