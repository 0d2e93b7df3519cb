"""Session messages: envelopes, widgets, deadlines, funnel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tracelode.functions.once import with_once

# Message names, the order of a full session, the answer deadline.
EVENTS = ["client.connect", "server.connected", "kc.request.next", "kc.question", "kc.answer.submit",
          "kc.answer.result", "kc.adaptive.update"]
STAGES = EVENTS[:6]
ANSWER, RESULT, UPDATE = "kc.answer.submit", "kc.answer.result", "kc.adaptive.update"
DEADLINE_SECONDS = 8
NEVER = np.iinfo(np.int64).max
ENVELOPE = """event string, data string,
  meta struct<timestamp:bigint, user_id:string, session_id:string, request_id:string>, _corrupt_record string"""
WIDGET = """widget struct<type:string, id:string, props:string>, difficulty int, concepts array<string>"""


def parse_envelopes(df: DataFrame, raw: str = "raw", known: list[str] = EVENTS) -> DataFrame:
    """(I) Message JSON to event, data and meta, with an error code on bad rows."""
    parsed = with_once(df, "_m", F.from_json(F.col(raw), ENVELOPE))
    broken = F.col("_m").isNull() | F.col("_m._corrupt_record").isNotNull()
    event = F.when(~broken, F.nullif(F.col("_m.event"), F.lit("")))
    error = (
        F.when(event.isNull(), "protocol.invalid_envelope")
        .when(~event.isin(known), "protocol.unknown_event")
        .when(F.col("_m.data").isNull() | ~F.ltrim("_m.data").startswith("{"), "protocol.invalid_payload")
    )

    def meta(name: str) -> Column:
        return F.when(~broken, F.col(f"_m.meta.{name}"))

    return parsed.select(
        *[c for c in df.columns if c not in (raw, "event", "session_id")], event.alias("event"),
        F.when(~broken, F.col("_m.data")).alias("data"), F.timestamp_millis(meta("timestamp")).alias("sent_at"),
        meta("user_id").alias("meta_user_id"), meta("session_id").alias("meta_session_id"),
        meta("request_id").alias("meta_request_id"), error.alias("error_code"))


def parse_widgets(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(I) Question payload to type, ids, question text, first option, difficulty and concepts."""
    parsed = with_once(df, "_w", F.from_json(F.col(payload), WIDGET))
    props = F.col("_w.widget.props")
    return parsed.select(
        *[c for c in df.columns if c != payload], F.col("_w.widget.type").alias("widget_type"),
        F.col("_w.widget.id").alias("widget_id"), F.get_json_object(props, "$.question_id").alias("asked_id"),
        F.get_json_object(props, "$.question").alias("question"),
        F.get_json_object(props, "$.options[0]").alias("first_option"),
        F.col("_w.difficulty").alias("difficulty"), F.col("_w.concepts").alias("concepts"))


def window_number(time: Column, seconds: int) -> Column:
    """Number of the fixed time window a time falls in."""
    micros, width = F.unix_micros(time.cast("timestamp")), F.lit(seconds * 1_000_000)
    return ((micros - F.pmod(micros, width)) / width).cast("bigint")


def answer_deadline(messages: DataFrame, seconds: int = DEADLINE_SECONDS) -> DataFrame:
    """(I) Per answer whether its result and its update came in the same session within the deadline.

    Replies are reduced to first and last time per session and window as long as the
    deadline. A reply in time lies in the answer's window, at or after the answer, or in
    the next one, not after the deadline; the window's last, or first, time decides that.
    So an answer meets at most two rows, however many replies a session has.
    """
    asked = messages.where(F.col("event") == ANSWER).select("session_id", F.col("event_id").alias("answer_id"),
                                                            F.col("ts").alias("answered_at"))
    number = window_number(F.col("ts"), seconds)
    replies = messages.where(F.col("event").isin(RESULT, UPDATE)).groupBy("session_id", number.alias("win")).agg(
        *[f(F.when(F.col("event") == e, F.col("ts"))).alias(f"{n}_{name}")
          for e, name in ((RESULT, "result"), (UPDATE, "update")) for n, f in (("first", F.min), ("last", F.max))])
    own = window_number(F.col("answered_at"), seconds)
    probes = asked.withColumn("win", F.explode(F.array(own, own + 1)))
    due = F.timestamp_add("SECOND", F.lit(seconds), F.col("answered_at"))

    def in_time(name: str) -> Column:
        # The last reply of a window is at or after the answer in its own window and in the next one.
        hit = (F.col(f"last_{name}") >= F.col("answered_at")) & (
            (F.col("win") == window_number(F.col("answered_at"), seconds)) | (F.col(f"first_{name}") <= due))
        return F.coalesce(F.bool_or(hit), F.lit(False)).alias(f"{name}_in_time")

    met = probes.join(replies, ["session_id", "win"], "left").groupBy("answer_id", "session_id", "answered_at").agg(
        in_time("result"), in_time("update"))
    complete = F.col("result_in_time") & F.col("update_in_time")
    return met.withColumn("status", F.when(complete, "complete").otherwise("late_or_absent"))


FUNNEL = "session_id string, reached array<bigint>"


def session_funnel(messages: DataFrame, stages: list[str] = STAGES) -> DataFrame:
    """(I) Per session the stages reached in order and the first one missing.

    A stage is reached at its first message at or after the time the stage before it was
    reached, so later rounds of a session count. One shuffle brings a session's messages
    together in order of time; they pass by, and what is kept of a session is the time it reached each
    stage, so its length does not matter. Messages of other kinds are not sent; a message without a time reaches nothing.
    """
    number = F.coalesce(*[F.when(F.col("event") == stage, F.lit(i)) for i, stage in enumerate(stages)])
    n = len(stages)
    rows = messages.select(F.col("session_id").cast("string").alias("session_id"), F.when(F.col("ts").isNotNull(), number).alias("stage"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    # One row keeps a session that has no message of any stage.
    useful = rows.where("stage is not null").unionByName(rows.select("session_id").distinct().select("session_id", F.lit(None).cast("int").alias("stage"), F.lit(None).cast("bigint").alias("us")))

    def fold(batches):
        open_id, open_times = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("session_id").dictionary_encode()
            codes = pc.fill_null(ids.indices, -1).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            names = batch.column("session_id").take(pa.array(first)).to_pylist()
            owner = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(codes)]])))
            stage = pc.fill_null(batch.column("stage"), -1).to_numpy(zero_copy_only=False)
            us = pc.fill_null(batch.column("us"), 0).to_numpy(zero_copy_only=False)
            times = np.full((len(first), n), NEVER)
            if open_times is not None and names[0] == open_id:
                times[0] = open_times
            elif open_times is not None:
                yield out([open_id], open_times[None, :])
            for i in range(n):
                after = times[owner, i - 1] if i else np.full(len(us), -NEVER)
                hit = (stage == i) & (us >= after) & (after < NEVER)
                np.minimum.at(times[:, i], owner[hit], us[hit])
            if len(names) > 1:
                yield out(names[:-1], times[:-1])
            open_id, open_times = names[-1], times[-1]
        if open_times is not None:
            yield out([open_id], open_times[None, :])

    def out(names, times):
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1) * n, pa.int32()), pa.array(times.ravel(), pa.int64(), mask=times.ravel() == NEVER))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), lists], names=["session_id", "reached"])

    together = useful.repartition("session_id").sortWithinPartitions("session_id", "us", "stage")
    when = together.mapInArrow(fold, FUNNEL)
    reached = F.size(F.filter("reached", lambda t: t.isNotNull()))
    return when.select("session_id", reached.alias("stages_reached"), F.get(F.array(*map(F.lit, stages)), reached).alias("first_missing"))
