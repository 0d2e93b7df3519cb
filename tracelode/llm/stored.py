"""Frames written below the shared folder and read again, which cuts their lineage and survives lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracelode.session import run_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a compressed table of its own in the shared folder."""
    folder = run_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
