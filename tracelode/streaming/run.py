"""Writing streams to tables in the shared folder."""

from __future__ import annotations

from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from tracelode.session import run_folder
from tracelode.streaming.tables import BatchTable

#: Far, and within what nanoseconds since 1970 can hold.
CLOSING_TIME = datetime(2200, 1, 1)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on local disk with changelogs in the checkpoint folder, not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def append_table(df: DataFrame, path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Append-mode rows into parquet files."""
    return (df.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def update_table(df: DataFrame, path: str, checkpoint: str, trigger: dict, keys: list[str]) -> StreamingQuery:
    """A table of the newest row of every key, as it is after the last batch; see ``streaming.tables``."""
    table = BatchTable(df.sparkSession, path)
    return (df.writeStream.outputMode("update").foreachBatch(lambda rows, batch: table.merge(rows, batch, keys))
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


@contextmanager
def one_state_partition_per_core(spark: SparkSession):
    """Shuffle partitions of streams started inside: at most one per core.

    A stream keeps its number of state partitions for life, and each costs files per batch.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def finish(df: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote: all rows, or the newest of every key."""
    spark = df.sparkSession
    folder = run_folder(spark, name)
    out, checkpoint, trigger = f"{folder}/out", f"{folder}/checkpoint", {"availableNow": True}
    with one_state_partition_per_core(spark):
        query = append_table(df, out, checkpoint, trigger) if keys is None else update_table(df, out, checkpoint, trigger, keys)
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out) if keys is None else BatchTable(spark, out).read(df.schema)


def closed_by(stream: DataFrame, *rows: dict, time: str = "ts") -> DataFrame:
    """The stream and closing rows of a far time: once they are read, every window before them is given out.

    ``rows`` holds the columns that are not null. They must come with the last batch, as what follows them is late.
    """
    spark = stream.sparkSession
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in stream.schema])
    folder = run_folder(spark, "closing")
    closing = [tuple({time: CLOSING_TIME, **row}.get(f.name) for f in schema) for row in rows]
    spark.createDataFrame(closing, schema).coalesce(1).write.parquet(folder)
    return stream.unionByName(spark.readStream.schema(schema).parquet(folder))
