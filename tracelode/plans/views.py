"""Telemetry-shaped views over the given star, event and text tables.

Each view is a function (spark, folder) -> DataFrame. ``plans/oracle.py`` states the
same views in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracelode.operators.ordered import previous_in_time
from tracelode.sources.tables import table

Reader = Callable[[SparkSession, str, str], DataFrame]


def _pick(number: Column, values: list[str | None], otherwise: str | None = None) -> Column:
    chain = F.lit(otherwise)
    for i, value in reversed(list(enumerate(values))):
        chain = F.when(number == i, F.lit(value)).otherwise(chain)
    return chain


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def ev(spark: SparkSession, folder: str, read: Reader = table) -> DataFrame:
    """Events with the number in ``props``. ``read`` is ``table`` or ``table_stream``."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return read(spark, folder, "events").withColumn("k", k)


def _service(column: str = "user_id") -> Column:
    return F.concat(F.lit("svc-"), (F.col(column) % 5).cast("string"))


def logs(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    log = (
        F.when((kind == "error") & (F.col("k") % 2 == 0), "Request failed: connection refused")
        .when(kind == "error", "Fatal: no such host")
        .when(kind == "signup", "Deprecated API used")
        .when(kind == "purchase", "CRITICAL stock level")
        .when(kind == "view", '{"level":"warn","msg":"slow page"}')
    )
    return ev(spark, folder).select(
        F.col("event_id").alias("log_id"), "ts", "user_id",
        F.when(F.col("user_id") % 5 != 0, _service()).alias("container_name"),
        _pick(F.col("k") % 8, ["error", "WARNING", "critical", "info", "trace", "notice"]).alias("level"),
        log.alias("log"),
    )


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user on a day of the month form a trace; each event's parent is the one before."""
    return previous_in_time(flat_spans(spark, folder), ["trace_id"], "start_ts", "span_id", F.col("span_id"),
                            "parent_span_id")


def flat_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans without parent links: no shuffle, for work that does not read them."""
    return ev(spark, folder).select(
        F.concat(F.lit("t"), _text("user_id"), F.lit("-"), F.dayofmonth("ts").cast("string")).alias("trace_id"),
        F.col("event_id").alias("span_id"),
        _service().alias("service_name"),
        F.col("event_type").alias("operation"),
        F.col("ts").alias("start_ts"),
        F.round(F.col("value") * 1000).cast("bigint").alias("duration_us"),
        F.when(F.col("event_type") == "error", "Error").otherwise("Ok").alias("status"),
        "user_id", "k",
    )


def tagged_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans with their id tags as an array."""
    def tag(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), F.lit("string").alias("type"), value.alias("value"))

    return flat_spans(spark, folder).withColumn("tags", F.array(
        tag("user.id", _text("user_id")), tag("session.id", F.col("trace_id")), tag("request.id", _text("span_id"))))


def db_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans whose operations are renamed to database work."""
    op = (
        F.when(F.col("operation").isin("click", "error"), "db.query")
        .when(F.col("operation") == "view", "db.transaction.save")
        .when(F.col("operation") == "purchase", "db.migration")
        .otherwise(F.col("operation"))
    )
    return flat_spans(spark, folder).withColumn("operation", op).withColumn("param_count", F.col("k") % 4)


def event_samples(spark: SparkSession, folder: str) -> DataFrame:
    return ev(spark, folder).where("event_type <> 'error'").select(
        "event_id", "ts", F.col("event_type").alias("event_name"), F.lit(False).alias("is_error"), _latency())


def _latency() -> Column:
    return F.round(F.col("value") * 1000000).cast("bigint").alias("latency_ns")


def event_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return ev(spark, folder).select(
        "event_id", "ts", F.concat(F.lit("user."), _text("user_id")).alias("event_name"),
        (F.col("event_type") == "error").alias("is_error"), _latency())


def kind_outcomes(spark: SparkSession, folder: str, read: Reader = table) -> DataFrame:
    """Outcomes named by event type, a bounded set of names; a few of each fail."""
    return ev(spark, folder, read).select(
        "event_id", "ts", F.col("event_type").alias("event_name"),
        (F.col("k") < 10).alias("is_error"), _latency())


def connections(spark: SparkSession, folder: str, read: Reader = table) -> DataFrame:
    return ev(spark, folder, read).where("event_type in ('signup', 'purchase')").select(
        "event_id", "ts", F.when(F.col("event_type") == "signup", 1).otherwise(-1).alias("delta"))


def metric_samples(spark: SparkSession, folder: str, read: Reader = table) -> DataFrame:
    return ev(spark, folder, read).select(
        F.col("event_type").alias("job"),
        F.concat(F.lit("host-"), (F.col("user_id") % 3).cast("string")).alias("instance"),
        "ts", "event_id", "value")


def labelled_samples(spark: SparkSession, folder: str) -> DataFrame:
    labels = F.create_map(F.lit("job"), F.col("job"), F.lit("instance"), F.col("instance"))
    return metric_samples(spark, folder).withColumn("labels", labels)


def metric_payloads(spark: SparkSession, folder: str) -> DataFrame:
    payload = F.concat(
        F.lit('{"status":"success","data":{"resultType":"vector","result":[{"metric":{"__name__":"up","job":"'), "job",
        F.lit('","instance":"'), "instance", F.lit('"},"value":['),
        (F.lit(1700000000) + F.col("event_id")).cast("string"), F.lit(',"'),
        F.when(F.col("job") == "error", "0").otherwise("1"), F.lit('"]}]}}'))
    return metric_samples(spark, folder).select("event_id", payload.alias("payload"))


def text_payload_lines(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("n")
    line = (
        F.when(n == 0, F.concat(F.lit("# TYPE ws_"), "job", F.lit(" gauge")))
        .when(n == 1, F.concat(F.lit("ws_"), "job", F.lit(" "), _text("event_id")))
        .when(F.col("event_id") % 2 == 0, "")
        .otherwise(" ")
    )
    rows = metric_samples(spark, folder).withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return rows.select((F.col("event_id") * 3 + n).alias("line_no"), line.alias("line"))


def progress(spark: SparkSession, folder: str) -> DataFrame:
    return ev(spark, folder).where("event_type in ('purchase', 'click')").select(
        "event_id", "user_id", (F.col("k") % 50).cast("bigint").alias("question_id"),
        (F.col("event_type") == "purchase").alias("correct"),
        (F.lit(1) + F.col("k") % 5).cast("int").alias("difficulty"), F.col("ts").alias("answered_at"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("question_id"), (F.lit(1) + F.col("doc_id") % 5).cast("int").alias("difficulty"),
        F.array("source", "lang").alias("concepts"))


def question_bank(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of which some break the constraints of the question table."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("question_id"),
        F.when(F.col("n_chars") % 5 > 0, F.col("lang")).alias("body"),
        F.when(F.col("doc_id") % 11 > 0, (F.col("doc_id") % 7).cast("int")).alias("difficulty"),
        F.when(F.col("n_chars") % 13 == 0, F.lit(None).cast("array<string>"))
        .when(F.col("n_chars") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("source")).alias("concepts"))


def question_payloads(spark: SparkSession, folder: str) -> DataFrame:
    is_choice = F.col("doc_id") % 2 == 0
    payload = F.concat(
        F.lit('{"widget":{"type":"'), F.when(is_choice, "mcq").otherwise("text"), F.lit('","id":"w'), _text("doc_id"),
        F.lit('","props":{"question_id":"'), _text("doc_id"), F.lit('"'),
        F.when(is_choice, F.concat(F.lit(',"options":["'), "lang", F.lit('","'), "source", F.lit('"]'))).otherwise(""),
        F.lit('}},"difficulty":'), (F.lit(1) + F.col("doc_id") % 5).cast("string"),
        F.lit(',"concepts":["'), "source", F.lit('","'), "lang", F.lit('"]}'))
    return table(spark, folder, "documents").select(F.col("doc_id").alias("question_id"), payload.alias("payload"))


def status_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return ev(spark, folder).select(
        "event_id", "ts", F.to_date("ts").alias("day"), _service().alias("service"),
        F.when(F.col("event_type") == "error", "exited").otherwise("running").alias("state"),
        _pick(F.col("k") % 4, ["none", "healthy", "starting"], "unhealthy").alias("health"))


def invocation_params(spark: SparkSession, folder: str) -> DataFrame:
    return ev(spark, folder).select(
        F.col("event_id").alias("invocation_id"),
        _pick(F.col("k") % 5, ["db.query", "infra.logs", "infra.start", "obs.metrics"], "no.such").alias("command"),
        F.when(F.col("event_type") == "click", "sql").when(F.col("event_type") == "view", "service")
        .when(F.col("event_type") == "signup", "timeout").alias("param"),
        _text("k").alias("param_value"))


def session_messages(spark: SparkSession, folder: str, read: Reader = table) -> DataFrame:
    kind = F.col("event_type")
    raw = F.concat(
        F.lit('{"event":"'), kind, F.lit('","data":'), "props", F.lit(',"meta":{"user_id":"'), _text("user_id"), F.lit('"'),
        F.when(F.col("k") % 7 == 0, "").otherwise("}}"))
    return ev(spark, folder, read).select(
        "event_id", "ts",
        F.concat(F.lit("s"), _text("user_id"), F.lit("-"), F.dayofmonth("ts").cast("string")).alias("session_id"),
        F.when(kind == "signup", "client.connect").when(kind == "view", "kc.request.next")
        .when(kind == "click", "kc.answer.submit").when(kind == "purchase", "kc.answer.result")
        .otherwise("kc.adaptive.update").alias("event"),
        raw.alias("raw"))


def raw_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Container log lines; every third record comes in two parts, the last part ends the line.

    The second part is written a microsecond after the first.
    """
    split_up = F.col("log_id") % 3 == 0
    parts = F.when(split_up, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    msg = F.coalesce("log", F.lit("no message at all"))
    piece = F.when(~split_up, F.col("msg")).when(F.col("part") == 0, F.substring("msg", 1, 8)).otherwise(
        F.expr("substr(msg, 9)"))
    time = F.timestamp_add("MICROSECOND", F.col("part"), F.col("ts"))
    line = F.concat(
        F.lit('{"log":"'), F.replace(piece, F.lit('"'), F.lit('\\"')),
        F.when(split_up & (F.col("part") == 0), "").otherwise("\\n"),
        F.lit('","stream":"stdout","time":"'), F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('"}'))
    return (
        logs(spark, folder).select("log_id", "ts", "user_id", msg.alias("msg"), F.explode(parts).alias("part"))
        .select((F.col("log_id") * 2 + F.col("part")).alias("line_no"), "log_id", "ts",
                F.concat(F.lit("c"), (F.col("user_id") % 16).cast("string")).alias("container_id"), line.alias("line"))
    )


def app_errors(spark: SparkSession, folder: str) -> DataFrame:
    codes = ["protocol.invalid_envelope", "protocol.unknown_event", "protocol.invalid_payload", "auth.token_expired",
             "auth.unauthorized", "db.query_failed", "db.not_found", "rate_limit.exceeded"]
    return ev(spark, folder).where("event_type = 'error'").select(
        "event_id", "ts", "user_id", _pick(F.col("k") % 9, codes, "internal.error").alias("code"),
        F.concat(F.lit("message "), _text("k")).alias("message"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("cause "), _text("k"))).alias("cause"),
        F.when(F.col("k") % 4 == 0, "").otherwise(F.concat(F.lit("req-"), _text("event_id"))).alias("request_id"),
        F.concat(F.lit("t"), _text("user_id"), F.lit("-"), F.dayofmonth("ts").cast("string")).alias("trace_id"))


def span_event_json(spark: SparkSession, folder: str) -> DataFrame:
    events = F.concat(
        F.lit('[{"name":"executing query","level":"debug","db.rows":'), F.col("k").cast("string"), F.lit('},{"name":"retry","attempt":"'), (F.col("k") % 3).cast("string"), F.lit('"}'),
        F.when(F.col("status") == "Error", ',{"name":"query failed","level":"error","error.message":"boom"}')
        .otherwise(',{"name":"query completed successfully","level":"info"}'), F.lit("]"))
    return flat_spans(spark, folder).select("trace_id", "span_id", "start_ts", events.alias("events"))


def utterances(spark: SparkSession, folder: str) -> DataFrame:
    """Short requests made of a verb by event type, an object and an ending by number."""
    verb = (
        F.when(F.col("event_type") == "click", "please show the").when(F.col("event_type") == "view", "Start my")
        .when(F.col("event_type") == "purchase", "stop").when(F.col("event_type") == "signup", "run")
        .otherwise("zzz"))
    noun = _pick(F.col("k") % 8, ["Postgres logs", "Jaeger services", "database migrations", "prometheus METRICS",
                                  "infrastructure", "sql query", "otel-collector logs"], "é e quux")
    end = _pick(F.col("k") % 3, ["in background", "and remove volume"], "now")
    return ev(spark, folder).select("event_id", F.concat_ws(" ", verb, noun, end).alias("text"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders")


def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark")


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def migration_files(spark: SparkSession, folder: str) -> DataFrame:
    """One numbered input file per document; the labelled documents are applied."""
    return table(spark, folder, "documents").select(
        F.concat(F.lpad(_text("doc_id"), 9, "0"), F.lit("_"), "source", F.lit(".sql")).alias("file_name"))


def migration_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(F.col("doc_id").alias("version"))
