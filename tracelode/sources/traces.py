"""Trace documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DOCUMENT = """data array<struct<traceID:string, spans:array<struct<
  traceID:string, spanID:string, operationName:string,
  references:array<struct<refType:string, traceID:string, spanID:string>>,
  startTime:bigint, duration:bigint,
  tags:array<struct<key:string, type:string, value:string>>>>>>"""


def tag_map(tags: Column) -> Column:
    """Tags as a map; of a repeated key the first value stays (the array keeps all)."""
    names = F.array_distinct(F.transform(tags, lambda t: t["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.filter(tags, lambda t: t["key"] == n)[0]["value"]))


def explode_traces(documents: DataFrame) -> DataFrame:
    """One row per span of parsed trace documents. Times are microseconds (our reading)."""
    traces = documents.select(F.explode("data").alias("trace"))
    spans = traces.select(F.col("trace.traceID").alias("trace_id"), F.explode("trace.spans").alias("s"))
    parent = F.get(F.filter("s.references", lambda r: r["refType"] == "CHILD_OF"), 0)
    return spans.select(
        F.coalesce("s.traceID", "trace_id").alias("trace_id"), F.col("s.spanID").alias("span_id"),
        parent["spanID"].alias("parent_span_id"),
        F.col("s.operationName").alias("operation"), F.timestamp_micros("s.startTime").alias("start_ts"),
        F.col("s.duration").alias("duration_us"), F.col("s.tags").alias("tags"), tag_map(F.col("s.tags")).alias("tag_map"))


def trace_json_load(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(I) Trace documents in files (one per file, or one per line) to one row per span."""
    return explode_traces(spark.read.schema(DOCUMENT).json(path, multiLine=multi_line))


def to_documents(spans: DataFrame) -> DataFrame:
    """Spans as trace documents of one span each, as JSON text in ``value``."""
    reference = F.struct(F.lit("CHILD_OF").alias("refType"), F.col("trace_id").alias("traceID"),
                         F.col("parent_span_id").cast("string").alias("spanID"))
    span = F.struct(
        F.col("trace_id").alias("traceID"), F.col("span_id").cast("string").alias("spanID"),
        F.col("operation").alias("operationName"),
        F.when(F.col("parent_span_id").isNotNull(), F.array(reference)).alias("references"),
        F.unix_micros(F.col("start_ts").cast("timestamp")).alias("startTime"), F.col("duration_us").alias("duration"), "tags")
    trace = F.struct(F.col("trace_id").alias("traceID"), F.array(span).alias("spans"))
    return spans.select(F.to_json(F.struct(F.array(trace).alias("data"))).alias("value"))
