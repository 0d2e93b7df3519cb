"""Scraped metric streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracelode.operators.metrics import scrape_samples


def stream_scrape(samples: DataFrame, series: list[str], step: str = "15 seconds", delay: str = "1 minute") -> DataFrame:
    """(I) Last value of each series per scrape step, given out when the step is closed."""
    return scrape_samples(samples.withWatermark("ts", delay), series, step)
