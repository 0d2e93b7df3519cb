"""Outputs by signal.

``write_signals`` writes below a folder of its own and then one manifest, which names the folder of every signal: readers see
all signals of a run or none. ``stream_signal`` appends batches to a table of ``streaming.tables``, each once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelode.files import Store
from tracelode.streaming.tables import BatchTable, read_folders


def _by_day(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn("day", F.to_date(time))


def _manifests(store: Store, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in store.names(f"{path}/manifests") if n.endswith(".json"))


def _current(store: Store, path: str, number: int | None) -> dict[str, str]:
    return json.loads(store.read(f"{path}/manifests/{number}.json")) if number is not None else {}


def write_signals(signals: dict[str, tuple[DataFrame, str]], path: str) -> None:
    """(I) Each signal (logs, traces, metrics) by day below ``path``; takes the place of what was there of these signals.

    ``signals`` maps a name to its frame and time column. The rebalance hint gathers a day
    into few files and lets adaptive execution split a day that holds most of the rows. A run that is stopped before its
    manifest leaves the old state readable; what no manifest but the last two names is removed.
    """
    if not signals:
        return
    spark = next(iter(signals.values()))[0].sparkSession
    store, run = Store(spark, path), f"run-{uuid.uuid4().hex}"
    for name, (df, time) in signals.items():
        days = _by_day(df, time).hint("rebalance", "day")
        days.write.partitionBy("day").parquet(f"{path}/{run}/signal={name}")
    numbers = _manifests(store, path)
    before = numbers[-1] if numbers else None
    old = _current(store, path, before)
    now = {**old, **{name: f"{run}/signal={name}" for name in signals}}
    store.write(f"{path}/manifests/{0 if before is None else before + 1}.json", json.dumps(now))
    needed = {folder.split("/")[0] for state in (old, now) for folder in state.values()}
    for number in numbers[:-1]:
        store.remove(f"{path}/manifests/{number}.json")
    for folder in store.names(path):
        if folder.startswith("run-") and folder not in needed:
            store.remove(f"{path}/{folder}")


def _stream_table(spark: SparkSession, path: str, name: str) -> BatchTable:
    return BatchTable(spark, f"{path}/stream={name}", partition=["day"])


def stream_signal(df: DataFrame, time: str, name: str, path: str, checkpoint: str,
                  trigger: dict | None = None) -> StreamingQuery:
    """(I) One signal by day, written by a stream. The trigger defaults to batches of one second."""
    table = _stream_table(df.sparkSession, path, name)
    return (
        _by_day(df, time).writeStream.foreachBatch(lambda rows, batch: table.append(rows, batch))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
    )


def read_signal(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One signal, of the last run and of its stream; a filter on ``day`` prunes folders."""
    store = Store(spark, path)
    numbers = _manifests(store, path)
    run = _current(store, path, numbers[-1] if numbers else None).get(name)
    folders = [f"{path}/{run}"] if run else []
    folders += _stream_table(spark, path, name).folders()
    if not folders:
        raise FileNotFoundError(f"no signal {name} below {path}")
    return read_folders(spark, folders)
