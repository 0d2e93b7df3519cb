"""Metric payloads: instant-query JSON and the text format."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracelode.functions.once import with_once

RESULT = """status string, data struct<resultType:string,
  result:array<struct<metric:map<string,string>, value:array<string>>>>"""
SAMPLE = r"^\s*([a-zA-Z_:][a-zA-Z0-9_:]*)(\{.*\})?\s+(\S+)"
LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'


def metric_json_load(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(I) Successful query results in a column to one row per series: labels, ts (seconds), value."""
    parsed = with_once(df, "_r", F.from_json(payload, RESULT)).where("_r.status = 'success'")
    rows = parsed.withColumn("_s", F.explode("_r.data.result"))
    return rows.select(*[c for c in df.columns if c != payload], F.col("_s.metric").alias("labels"),
                       F.get("_s.value", 0).try_cast("double").alias("ts"),
                       F.get("_s.value", 1).try_cast("double").alias("value"))


def split_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Lines of text payloads; the text after a final newline is no line."""
    lines = F.split(F.regexp_replace(F.col(payload), r"\n$", ""), "\n")
    return df.withColumn("line", F.explode(lines)).drop(payload)


def exposition_load(df: DataFrame, line: str = "line") -> DataFrame:
    """(I) Lines of the text format to samples; comments, empty and blank lines are dropped. Of a repeated label the first
    value counts."""
    text = F.col(line)
    samples = df.where((F.length(text) > 0) & ~text.startswith("#"))
    labels = F.regexp_extract(text, SAMPLE, 2)
    names = F.regexp_extract_all(labels, F.lit(LABEL), F.lit(1))
    pairs = F.zip_with(names, F.regexp_extract_all(labels, F.lit(LABEL), F.lit(2)), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    parsed = samples.withColumns({
        "name": F.regexp_extract(text, SAMPLE, 1),
        "labels": F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(names, p["key"]) == i + 1)),
        "value": F.regexp_extract(text, SAMPLE, 3).try_cast("double"),
    })
    return parsed.where("name <> ''").drop(line)
