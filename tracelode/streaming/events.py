"""Running event counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracelode.operators.events import RING, latency_ring
from tracelode.streaming.run import use_rocksdb

SAMPLE = "ts timestamp, event_id bigint, latency_ns bigint"


class _Counter(StatefulProcessor):
    """Counts of one (event, salt) and its last samples."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "processed bigint, errors bigint")
        self.ring = handle.getListState("ring", SAMPLE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        processed, errors = self.counts.get() if self.counts.exists() else (0, 0)
        columns = ["ts", "event_id", "latency_ns"]
        ring = pd.DataFrame(list(self.ring.get()) if self.ring.exists() else [], columns=columns)
        for batch in rows:
            good = batch[~batch["is_error"]]
            processed, errors = processed + len(good), errors + len(batch) - len(good)
            both = pd.concat([ring, good[columns]]) if len(ring) else good[columns]
            ring = both.sort_values(["ts", "event_id"]).tail(self.keep)
        self.counts.update((processed, errors))
        samples = [(ts, int(i), int(n)) for ts, i, n in ring.itertuples(index=False)]
        if samples:
            self.ring.put(samples)
        yield pd.DataFrame({
            "event_name": [key[0]], "salt": [key[1]], "processed": [processed], "errors": [errors],
            "ring": [[{"ts": ts, "event_id": i, "latency_ns": n} for ts, i, n in samples]]})

    def close(self) -> None:
        pass


SALTED = ["event_name", "salt"]


def stream_event_stats(events: DataFrame, keep: int = RING, salts: int | None = None) -> DataFrame:
    """(I) Counts, errors and last samples per event and salt, updated per batch.

    The salt spreads one busy event over ``salts`` tasks, by default one for every shuffle partition that the stream
    starts with. The last samples of the event are among the last samples of its salts, so nothing is lost;
    ``merge_event_stats`` puts them together. Samples are kept by (ts, event_id), so late input gives the same ring.
    Written by ``update_table`` with the keys SALTED.
    """
    use_rocksdb(events.sparkSession)
    salts = salts or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = events.withColumn("salt", F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int"))
    return salted.select("event_name", "salt", "ts", "event_id", "latency_ns", "is_error").groupBy(
        "event_name", "salt").transformWithStateInPandas(
        _Counter(keep), f"event_name string, salt int, processed bigint, errors bigint, ring array<struct<{_fields()}>>",
        "update", "none")


def _fields() -> str:
    return ", ".join(f"{name}:{kind}" for name, kind in (f.split() for f in SAMPLE.split(", ")))


def merge_event_stats(now: DataFrame, keep: int = RING) -> DataFrame:
    """Stats per event from the rows of all its salts, as ``event_stats`` gives them."""
    counts = now.groupBy("event_name").agg(F.sum("processed").alias("count"), F.sum("errors").alias("errors"))
    samples = now.select("event_name", F.lit(False).alias("is_error"), F.inline("ring"))
    ring = latency_ring(samples, keep).groupBy("event_name").agg(
        F.sum("latency_ns").alias("total_ns"), F.count("*").alias("latency_samples"))
    return counts.where("count > 0").join(ring, "event_name").select(
        "event_name", "count", "errors", F.expr("total_ns div latency_samples").alias("avg_latency_ns"), "latency_samples")


def stream_active_gauge(connections: DataFrame) -> DataFrame:
    """(I) Opened in total and open now, updated per batch; partial sums come before the shuffle."""
    return connections.groupBy().agg(
        F.count_if(F.col("delta") > 0).alias("total"), F.sum("delta").cast("bigint").alias("active"))
