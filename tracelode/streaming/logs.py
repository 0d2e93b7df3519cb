"""Log streams."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tracelode.files import Store
from tracelode.operators.logs import joined_parts, severe_logs
from tracelode.streaming.tables import BatchTable

KEY = "container_id"
LINE = "container_id string, ts timestamp, log string"
OPEN = "container_id string, started timestamp, ts timestamp, log string"


def join_parts(lines: DataFrame, open_parts: DataFrame, order: list[str], flush_seconds: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """Lines of a batch put together with what earlier ones left open: (joined lines, unfinished last line of each container).

    A container's lines are cut into slices of (container, time, order), so one container is many tasks; `folder` gets the
    joined lines, from which both frames are read.
    """
    new = lines.select(KEY, F.lit(1).alias("_new"), F.col("ts").alias("_started"), "ts", "log", *order)
    kinds = {f.name: f.dataType for f in new.schema}
    old = open_parts.select(KEY, F.lit(0).alias("_new"), F.col("started").alias("_started"), "ts", "log", *[F.lit(None).cast(kinds[c]).alias(c) for c in order])
    whole = joined_parts(old.unionByName(new), [KEY], ["_new", "ts", *order], flush_seconds, folder)
    waits = F.col("final") & ~F.col("log").endswith("\n")
    return whole.where(~waits).select(KEY, F.col("_started").alias("ts"), "log"), whole.where(waits).select(KEY, F.col("_started").alias("started"), "ts", "log")


class LineJoiner:
    """Writes the joined lines of a stream, batch by batch.

    Below `path`, ``lines`` is the result and ``open`` the part of each container that is still waiting for its end: one row
    a container. Such a part is given out when the newest time seen is `delay` and the flush time past it. Both are tables of
    ``streaming.tables``: a batch that is run again changes nothing that it has written before, and reads the open parts as
    they were before it.
    """

    def __init__(self, path: str, order: list[str], flush_seconds: int, delay_seconds: int, then: Callable[[DataFrame], DataFrame] | None) -> None:
        self._path, self._order, self._flush, self._wait, self._then = path, order, flush_seconds, delay_seconds, then

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        lines, open_parts = BatchTable(spark, f"{self._path}/lines"), BatchTable(spark, f"{self._path}/open")
        if open_parts.done(batch):
            return
        rows = rows.persist()
        seen = rows.agg(F.max("ts")).first()[0]
        before = open_parts.state(batch)["notes"].get("seen")
        seen = max(filter(None, (seen, before and datetime.fromisoformat(before))), default=None)
        # A batch that is run again writes over what it left here.
        folder = f"{self._path}/joined-{batch}"
        done, waiting = join_parts(rows, open_parts.read(OPEN, batch), self._order, self._flush, folder)
        limit = seen and seen - timedelta(seconds=self._flush + self._wait)
        over = F.coalesce(F.col("ts") < F.lit(limit), F.lit(False))
        given_out = done.unionByName(waiting.where(over).select(KEY, F.col("started").alias("ts"), "log"))
        lines.append(self._then(given_out) if self._then else given_out, batch)
        open_parts.replace(waiting.where(~over), batch, seen=seen and seen.isoformat())
        rows.unpersist()
        Store(spark, folder).remove(folder)


def stream_reassemble(lines: DataFrame, path: str, checkpoint: str, trigger: dict, order: list[str], flush_seconds: int = 5,
                      delay_seconds: int = 60, then: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """(I) Joins split lines per container into the table ``path``/lines; see ``operators.logs.reassemble`` for the rule.

    Lines of a batch are put in order by time, then by the columns of ``order``, behind what earlier batches left open;
    `then` changes the joined lines before they are written.
    """
    return (lines.select(KEY, "ts", "log", *order).writeStream.foreachBatch(LineJoiner(path, order, flush_seconds, delay_seconds, then))
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def severe(joined: DataFrame) -> DataFrame:
    """Joined lines to severe log records by the batch rules."""
    return severe_logs(joined.withColumns({"container_name": F.col(KEY), "level": F.lit(None).cast("string")}))


def stream_logs(lines: DataFrame, path: str, checkpoint: str, trigger: dict, order: list[str], delay_seconds: int = 60) -> StreamingQuery:
    """(I) Container lines to severe log records: join parts, then the batch rules unchanged."""
    return stream_reassemble(lines, path, checkpoint, trigger, order, delay_seconds=delay_seconds, then=severe)


def written_lines(spark: SparkSession, path: str, schema: T.StructType | str = LINE) -> DataFrame:
    """What a line stream has written so far."""
    return BatchTable(spark, f"{path}/lines").read(schema)
