"""Event counters, latencies, connections and the text payload made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracelode.operators.ordered import running_sum, slices

# Fixed value: latencies kept per event name.
RING = 100


def _one_row(*frames: DataFrame) -> DataFrame:
    """Frames of one row each, side by side."""
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return wide.agg(*[F.first(c, ignorenulls=True).alias(c) for c in wide.columns])


def latency_ring(df: DataFrame, keep: int = RING) -> DataFrame:
    """(I) The last ``keep`` processed samples per event name, by (ts, event_id).

    The rank filter is applied before the shuffle as well, so a name with most of the rows
    sends at most ``keep`` of them per input partition.
    """
    newest = Window.partitionBy("event_name").orderBy(F.desc("ts"), F.desc("event_id"))
    processed = df.where(~F.col("is_error"))
    return processed.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= keep)


def event_stats(df: DataFrame, keep: int = RING) -> DataFrame:
    """(I) Count, errors, mean of the last samples (whole nanoseconds) and their number.

    A name with errors but no processed row is left out.
    """
    counts = df.groupBy("event_name").agg(
        F.count_if(~F.col("is_error")).alias("count"), F.count_if(F.col("is_error")).alias("errors"))
    ring = latency_ring(df, keep).groupBy("event_name").agg(
        F.sum("latency_ns").alias("total_ns"), F.count("*").alias("latency_samples"))
    joined = counts.where("count > 0").join(ring, "event_name")
    return joined.select(
        "event_name", "count", "errors", F.expr("total_ns div latency_samples").alias("avg_latency_ns"),
        "latency_samples")


def connection_totals(df: DataFrame) -> DataFrame:
    """(I) Connections opened in total and open now."""
    return df.agg(
        F.count_if(F.col("delta") > 0).alias("total"),
        F.coalesce(F.sum("delta"), F.lit(0)).cast("bigint").alias("active"))


def total_events(df: DataFrame) -> DataFrame:
    """(I) Number of processed events."""
    return df.agg(F.count_if(~F.col("is_error")).alias("total_events"))


def active_gauge(df: DataFrame, parts: int | None = None) -> DataFrame:
    """(I) Open connections after each open or close, over range slices of time."""
    order = ["ts", "event_id"]
    cut = slices(df.select("ts", "event_id", "delta"), [], order, parts)
    return running_sum(cut, [], order, F.col("delta"), "active").drop("_slice")


def stats_snapshot(events: DataFrame, connections: DataFrame) -> DataFrame:
    """(I) All stats as rows: one of the connections (event_name null), one per event name."""
    empty = {c: F.lit(None).cast("bigint") for c in ("count", "errors", "avg_latency_ns", "latency_samples")}
    whole = connection_totals(connections).select(F.lit(None).cast("string").alias("event_name"), "total", "active", *[v.alias(c) for c, v in empty.items()])
    names = event_stats(events).select("event_name", *[F.lit(None).cast("bigint").alias(c) for c in ("total", "active")], *empty)
    return whole.unionByName(names)


def metric_name(event: str) -> str:
    """Metric name of an event's latency."""
    return "ws_" + event.replace(".", "_") + "_latency_seconds"


def render_exposition(events: DataFrame, connections: DataFrame, latency_event: str = "kc.request.next") -> DataFrame:
    """(I) The text payload: open connections, processed events, latency of one event in seconds."""
    stats = event_stats(events).agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_events"),
        F.coalesce(F.max(F.when(F.col("event_name") == latency_event, F.col("avg_latency_ns"))), F.lit(0)).alias("ns"))

    def metric(no: int, kind: str, name: str, value: Column) -> list[Column]:
        return [
            F.struct(F.lit(no).alias("line_no"), F.lit(f"# TYPE {name} {kind}").alias("line")),
            F.struct(F.lit(no + 1).alias("line_no"), F.concat(F.lit(name + " "), value).alias("line")),
        ]

    lines = F.array(
        *metric(1, "gauge", "ws_connections", F.col("active").cast("string")),
        *metric(3, "counter", "ws_events_total", F.col("total_events").cast("string")),
        *metric(5, "gauge", metric_name(latency_event), F.format_string("%.6f", F.col("ns") / 1e9)),
    )
    return _one_row(connection_totals(connections), stats).select(F.inline(lines))


def error_rate(df: DataFrame) -> DataFrame:
    """(D) Errors over all outcomes per event name and for all names ("(all)")."""
    both = df.rollup("event_name").agg(F.count("*").alias("outcomes"), F.count_if(F.col("is_error")).alias("errors"))
    rate = F.when(F.col("outcomes") > 0, F.col("errors") / F.col("outcomes")).otherwise(F.lit(0.0))
    return both.select(F.coalesce("event_name", F.lit("(all)")).alias("event_name"), "outcomes", "errors",
                       rate.alias("error_rate"))
