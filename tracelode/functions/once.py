"""Columns that are worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column (parsed JSON, say) that later steps read in many places.

    The optimizer copies a plain column's expression into every place that reads it, and
    narrows each copy of ``from_json`` on its own, so one text would be parsed once per
    field. The explode of a one-element array keeps the value as it is.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
