"""Metric samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def match_labels(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(I) Samples whose labels equal all the given ones."""
    for key, value in labels.items():
        df = df.where(F.col("labels")[key] == value)
    return df


def metric_pipeline(df: DataFrame, namespace: str, environment: str = "development") -> DataFrame:
    """(I) The whole way of a sample to its sink: the environment, which is always set, then the prefix of its name."""
    return namespace_metrics(df.withColumn("environment", F.lit(environment)), namespace)


def series_up(samples: DataFrame, labels: dict[str, str], order: list[str], name: str = "up") -> DataFrame:
    """(I) One check row: whether the query result holds a series of the name and labels, how many, and the first one's value."""
    found = match_labels(samples, {"__name__": name, **labels})
    return found.agg((F.count("*") > 0).alias("success"), F.count("*").alias("series"), F.min_by("value", F.struct(*order)).alias("first_value"))


def latest_sample(df: DataFrame, series: list[str]) -> DataFrame:
    """(I) Newest value per series."""
    newest = F.max_by(F.struct("ts", "value"), F.struct("ts", "event_id")).alias("last")
    return df.groupBy(*series).agg(newest).select(*series, "last.ts", "last.value")


def scrape_samples(df: DataFrame, series: list[str], step: str = "15 seconds", time: str = "ts") -> DataFrame:
    """(I) Last value of each series in each scrape step."""
    last = F.max_by("value", F.struct(time, "event_id")).alias("value")
    stepped = df.groupBy(*series, F.window(time, step).alias("step")).agg(last)
    return stepped.select(*series, F.col("step.start").alias("step_start"), F.col("step.end").alias("step_end"), "value")


def namespace_metrics(df: DataFrame, prefix: str, name: str = "name") -> DataFrame:
    """(I) Metric names with the export prefix."""
    return df.withColumn(name, F.concat_ws("_", F.lit(prefix), name))


def metric_line_count(df: DataFrame, line: str = "line") -> DataFrame:
    """(I) Lines that are neither empty nor a comment; a blank-only line counts."""
    counted = (F.length(line) > 0) & ~F.col(line).startswith("#")
    return df.agg(F.count_if(counted).alias("metric_lines"))
