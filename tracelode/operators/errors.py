"""Structured errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def error_is(df: DataFrame, code: str) -> DataFrame:
    """(I) Errors of one code with their text ``[code] message: cause``."""
    head = F.concat(F.lit("["), "code", F.lit("] "), "message")
    text = F.when(F.col("cause").isNull(), head).otherwise(F.concat(head, F.lit(": "), "cause"))
    return df.where(F.col("code") == code).withColumn("error_text", text)


def error_families(df: DataFrame) -> DataFrame:
    """(D) Errors per family (text before the dot), per code, and in total."""
    family = F.split_part("code", F.lit("."), F.lit(1))
    return df.select(family.alias("family"), "code").rollup("family", "code").agg(F.count("*").alias("errors"))
