"""Session message streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tracelode.operators.sessions import ANSWER, DEADLINE_SECONDS, RESULT, UPDATE
from tracelode.streaming.run import use_rocksdb


def stream_answer_deadline(messages: DataFrame, seconds: int = DEADLINE_SECONDS, delay: str = "1 minute") -> DataFrame:
    """(I) Answers as ``answer_deadline`` gives them, each when the watermark has passed every time its replies may have.

    Time is cut into windows as long as the deadline, and two of them that follow each other are a span. A reply in time lies in
    the answer's window, at or after the answer, or in the next one, not after the deadline, so an answer belongs to the one span
    that begins with its window, and of the span's replies the last time in the first half and the first time in the second
    decide (as in the batch form): a busy session keeps four times a span. Replies are reduced to these, and answers joined
    to them, when the watermark passes the end of the span; so all answers come out, late and unanswered ones too, as long as
    time goes on, and at the end of a stream one closing event of a far time does it (``closed_by``).

    An answer is known by its session, id and time, and counts once; one without an id or a time is left out.
    """
    use_rocksdb(messages.sparkSession)
    width = seconds * 1_000_000
    # A stream may have one column with a watermark, so beside the span times are numbers.
    timed = [F.window("ts", f"{2 * seconds} seconds", f"{seconds} seconds").alias("span"), F.unix_micros("ts").alias("us")]
    second = F.col("us") >= F.unix_micros("span.start") + width
    rows = messages.withWatermark("ts", delay)
    replies = rows.where(F.col("event").isin(RESULT, UPDATE)).select("session_id", "event", *timed)

    def bound(event: str, of: Callable[[Column], Column], half: Column, name: str) -> Column:
        return of(F.when((F.col("event") == event) & half, F.col("us"))).alias(name)

    bounds = replies.groupBy(F.col("session_id").alias("_s"), F.col("span").alias("_span")).agg(
        bound(RESULT, F.max, ~second, "last_result"), bound(RESULT, F.min, second, "next_result"),
        bound(UPDATE, F.max, ~second, "last_update"), bound(UPDATE, F.min, second, "next_update"))
    asked = rows.where((F.col("event") == ANSWER) & F.col("event_id").isNotNull()).select(
        F.col("event_id").cast("bigint").alias("answer_id"), "session_id", "ts").dropDuplicates()
    asked = asked.select("answer_id", "session_id", *timed).where(~second)

    def in_time(name: str) -> Column:
        hit = F.coalesce(F.col(f"last_{name}") >= F.col("us"), F.lit(False)) | F.coalesce(F.col(f"next_{name}") <= F.col("us") + width, F.lit(False))
        return hit.alias(f"{name}_in_time")

    met = asked.join(bounds, F.col("session_id").eqNullSafe(F.col("_s")) & (F.col("span") == F.col("_span")), "left")
    settled = met.select("answer_id", "session_id", F.timestamp_micros("us").alias("answered_at"), in_time("result"), in_time("update"))
    complete = F.col("result_in_time") & F.col("update_in_time")
    return settled.withColumn("status", F.when(complete, "complete").otherwise("late_or_absent"))
