"""Every operator as a named query over a folder of the given tables."""

from __future__ import annotations

import glob
import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracelode.functions.vectors import l2
from tracelode.operators import (
    calls, checks, errors, events, graph, learning, logs, matching, metrics, sessions, traces, vectors)
from tracelode.plans import sql, views
from tracelode.session import cut_lineage, run_folder
from tracelode.sources import logs as log_files, metrics as metric_texts, sinks, traces as trace_files
from tracelode.sources.tables import table_stream
from tracelode.streaming import events as event_streams, logs as log_streams, metrics as metric_streams
from tracelode.streaming import sessions as session_streams
from tracelode.streaming.run import append_table, closed_by, finish, one_state_partition_per_core

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _r6(column: str | Column, name: str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6).alias(name)


def _joined(column: str) -> Column:
    return F.array_join(F.sort_array(column), ",").alias(column)


# ---------------------------------------------------------------- sources and sinks

def _write_raw_lines(spark: SparkSession, sf: str) -> str:
    """Container log files as the tail reads them: a folder per container, lines in order."""
    path = run_folder(spark, "raw-lines")
    lines = views.raw_log_lines(spark, sf).select("container_id", "line_no", F.col("line").alias("value"))
    ordered = lines.repartitionByRange("container_id", "line_no").sortWithinPartitions("container_id", "line_no")
    ordered.drop("line_no").write.partitionBy("container_id").text(path)
    return path


def _tail(spark: SparkSession, sf: str) -> DataFrame:
    return _without_key(log_files.log_tail_load(spark, _write_raw_lines(spark, sf) + "/*/*"))


def _followed(spark: SparkSession, sf: str) -> DataFrame:
    return _without_key(log_files.log_tail_follow(spark, _write_raw_lines(spark, sf).removeprefix("file:") + "/*/*.txt"))


def _without_key(tail: DataFrame) -> DataFrame:
    return tail.withColumn("container_id", F.regexp_replace("container_id", "^container_id=", ""))


def _ntz(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz").alias(column)


@query
def log_tail_load(spark, sf):
    return _tail(spark, sf).select("container_id", "log", "stream", "source", _ntz("ts"))


def _grow(lines: DataFrame, folder: str) -> None:
    """Appends lines to the file of their container, as its runtime does; a container is one task."""
    def append(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        path = f"{folder}/{key[0]}/app.log"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "a", encoding="utf-8") as file:
            file.write("".join(line + "\n" for line in rows.sort_values("line_no")["line"]))
        return pd.DataFrame({"n": [len(rows)]})

    lines.select("container_id", "line_no", "line").groupBy("container_id").applyInPandas(append, "n bigint").agg(F.sum("n")).collect()


@query
def log_tail_follow(spark, sf):
    """Three times the files grow and are read on from where the last run stopped; in between they are rotated."""
    folder = run_folder(spark, "growing").removeprefix("file:")
    lines = views.raw_log_lines(spark, sf)
    for step in range(3):
        _grow(lines.where(F.pmod("log_id", F.lit(3)) == step), f"{folder}/logs")
        if step == 1:
            for path in glob.glob(f"{folder}/logs/*/app.log"):
                os.rename(path, f"{path}.1")
        records = log_files.log_tail_follow(spark, f"{folder}/logs/*/app.log*", part_bytes=1 << 20)
        append_table(records, f"{folder}/out", f"{folder}/checkpoint", {"availableNow": True}).awaitTermination()
    return spark.read.schema(records.schema).parquet(f"{folder}/out").select("container_id", "log", "stream", "source", _ntz("ts"))


@query
def reassemble(spark, sf):
    lines = _tail(spark, sf)
    return logs.reassemble(lines, ["container_id"], log_files.LINE_ORDER).select("container_id", _ntz("ts"), "log")


@query
def trace_json_load(spark, sf):
    path = run_folder(spark, "trace-documents")
    source = views.spans(spark, sf).join(views.tagged_spans(spark, sf).select("span_id", "tags"), "span_id")
    trace_files.to_documents(source).write.text(path)
    spans = trace_files.trace_json_load(spark, path, multi_line=False)
    return spans.select(
        "trace_id", "span_id", "parent_span_id", "operation", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"),
        "duration_us", F.size("tags").alias("tag_count"), F.col("tag_map")["user.id"].alias("user_tag"),
        F.col("tag_map")["request.id"].alias("request_tag"))


@query
def metric_json_load(spark, sf):
    samples = metric_texts.metric_json_load(views.metric_payloads(spark, sf))
    return samples.select("event_id", F.col("labels")["job"].alias("job"), F.col("labels")["instance"].alias("instance"),
                          F.col("labels")["__name__"].alias("name"), "ts", "value")


@query
def exposition_load(spark, sf):
    return metric_texts.exposition_load(views.text_payload_lines(spark, sf)).select("line_no", "name", "value")


@query
def union_receivers(spark, sf):
    forwarded = views.logs(spark, sf).select("ts", "container_name", "level", F.col("log").alias("body"))
    direct = views.app_errors(spark, sf).select(
        "ts", F.col("message").alias("body"), F.lit("ERROR").alias("severity_text"), "request_id")
    return logs.union_receivers(forwarded, direct)


@query
def render_exposition(spark, sf):
    return events.render_exposition(views.event_samples(spark, sf), views.connections(spark, sf), "purchase")


@query
def write_signals(spark, sf):
    path = run_folder(spark, "signals")
    unnamed = views.flat_spans(spark, sf).withColumn("service_name", F.when(F.col("status") == "Ok", F.col("service_name")))
    named = views.metric_samples(spark, sf).withColumn("name", F.col("job"))
    sinks.write_signals({
        "logs": (views.logs(spark, sf).transform(logs.severe_logs).drop("log_fields"), "ts"),
        "traces": (unnamed.transform(traces.trace_pipeline), "start_ts"),
        "metrics": (named.transform(metrics.metric_pipeline, "agent"), "ts"),
    }, path)
    label = {"logs": F.col("service_name"), "traces": F.col("service_name"), "metrics": F.col("name")}
    counted = [
        sinks.read_signal(spark, path, name).groupBy("day", "environment", label[name].alias("name")).agg(F.count("*").alias("n"))
        .select(F.lit(name).alias("signal"), F.col("day").cast("string").alias("day"), "environment", "name", "n")
        for name in ("logs", "traces", "metrics")
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def _sql_query(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        text, args = sql.TEXTS[name]
        sql.register_tables(spark, sf, text)
        return sql.sql_query(spark, text, args, {"questions": views.questions(spark, sf).drop("concepts")})
    return run


for _name in sql.TEXTS:
    QUERIES[f"sql_query_{_name}"] = _sql_query(_name)


@query
def sql_query_rows_affected(spark, sf):
    return sql.rows_affected(_sql_query("filter")(spark, sf))


# ---------------------------------------------------------------- projections and filters

@query
def detect_level(spark, sf):
    return views.logs(spark, sf).transform(logs.detect_level).select("log_id", "severity_text", "severity_number")


@query
def merge_json_log(spark, sf):
    merged = views.logs(spark, sf).transform(logs.merge_json_log, ["level", "msg"])
    return merged.select("log_id", "level", "msg", "log")


@query
def extract_level_word(spark, sf):
    return views.logs(spark, sf).transform(logs.extract_level_word).select("log_id", "level_word")


@query
def keep_severe(spark, sf):
    return (views.logs(spark, sf).transform(logs.detect_level).transform(logs.keep_severe)
            .select("log_id", "severity_text"))


@query
def drop_below_warn(spark, sf):
    return (views.logs(spark, sf).transform(logs.detect_level).transform(logs.drop_below_warn)
            .select("log_id", "severity_number"))


@query
def severity_band(spark, sf):
    numbered = views.ev(spark, sf).select("event_id", (F.col("k") % 26).alias("severity_number"))
    return logs.severity_band(numbered)


@query
def modify_fields(spark, sf):
    return views.logs(spark, sf).transform(logs.modify_fields).select("log_id", "service_name", "environment")


@query
def log_transform(spark, sf):
    return (views.logs(spark, sf).transform(logs.detect_level).transform(logs.log_transform)
            .select("log_id", "service_name", "operation", "body"))


@query
def tag_for_trace_ui(spark, sf):
    out = (views.logs(spark, sf).transform(logs.detect_level).transform(logs.log_transform)
           .transform(logs.tag_for_trace_ui))
    return out.select("log_id", "jaeger_service", "jaeger_operation", "environment")


@query
def trace_default_service(spark, sf):
    unnamed = views.flat_spans(spark, sf).withColumn(
        "service_name", F.when(F.col("status") == "Ok", F.col("service_name")))
    return traces.trace_default_service(unnamed, "backend").select("span_id", "service_name")


@query
def drop_long_lines(spark, sf):
    return logs.drop_long_lines(views.logs(spark, sf), 25).select("log_id", "log")


@query
def match_labels(spark, sf):
    found = metrics.match_labels(views.labelled_samples(spark, sf), {"job": "purchase", "instance": "host-1"})
    return found.select("event_id", "job", "instance", "value")


@query
def filter_difficulty(spark, sf):
    return learning.filter_difficulty(views.questions(spark, sf), 3).select("question_id", "difficulty")


@query
def filter_concepts(spark, sf):
    questions = views.questions(spark, sf)
    either = learning.filter_concepts(questions, ["src1", "fr"], "any").withColumn("match", F.lit("any"))
    both = learning.filter_concepts(questions, ["src1", "fr"], "all").withColumn("match", F.lit("all"))
    return either.unionByName(both).select("match", "question_id", F.array_join("concepts", ",").alias("concepts"))


@query
def filter_concepts_indexed(spark, sf):
    """The same questions by the index on concepts."""
    questions = views.questions(spark, sf)
    postings = learning.write_postings(questions, run_folder(spark, "postings"))
    either, both = (learning.filter_concepts_indexed(questions, postings, ["src1", "fr"], match).withColumn("match", F.lit(match)) for match in ("any", "all"))
    return either.unionByName(both).select("match", "question_id", F.array_join("concepts", ",").alias("concepts"))


@query
def embedding_backfill(spark, sf):
    docs = views.documents(spark, sf).select("doc_id", "lang")
    return learning.embedding_backfill(docs, views.embeddings(spark, sf), "doc_id", "vec_id")


@query
def enrich_context(spark, sf):
    rows = views.app_errors(spark, sf).withColumn(
        "session_id", F.when(F.col("cause").isNull(), "").otherwise(F.concat(F.lit("s"), "trace_id")))
    out = traces.enrich_context(rows, ["event_id", "code"])
    return out.select("event_id", "request_id", "correlation_id", "user_id", "session_id")


@query
def error_is(spark, sf):
    return errors.error_is(views.app_errors(spark, sf), "db.not_found").select("event_id", "code", "error_text")


# ---------------------------------------------------------------- joins

def _id_sets(spark: SparkSession, sf: str) -> DataFrame:
    return views.app_errors(spark, sf).select(
        F.col("event_id").alias("set_id"), F.col("user_id").cast("string").alias("user_id"),
        F.col("trace_id").alias("session_id"), F.col("event_id").cast("string").alias("request_id"))


@query
def correlation_match(spark, sf):
    return traces.correlation_match(views.tagged_spans(spark, sf), _id_sets(spark, sf))


@query
def trace_check(spark, sf):
    spans = views.tagged_spans(spark, sf)
    return traces.trace_check(spans, _id_sets(spark, sf), ["click", "error", "purchase", "signup", "view"])


@query
def series_up(spark, sf):
    samples = metric_texts.metric_json_load(views.metric_payloads(spark, sf))
    return metrics.series_up(samples, {"job": "purchase"}, ["event_id"])


@query
def missing_spans(spark, sf):
    return traces.missing_spans(views.flat_spans(spark, sf), ["click", "error", "purchase", "signup", "view"])


@query
def trace_integrity(spark, sf):
    """Parents are also looked up one trace away: error spans name the first span of their user as parent."""
    spans = views.spans(spark, sf)
    first = spans.groupBy("user_id").agg(F.min("span_id").alias("first_span"))
    broken = spans.join(first, "user_id").withColumn("parent_span_id", F.when(
        F.col("status") == "Error", F.when(F.col("k") % 2 == 0, F.col("first_span")).otherwise(-F.col("span_id")))
        .otherwise(F.col("parent_span_id")))
    return traces.trace_integrity(broken)


@query
def error_pattern_scan(spark, sf):
    return logs.error_pattern_scan(views.logs(spark, sf), ["ts", "log_id"])


@query
def pattern_table_scan(spark, sf):
    """Documents that hold the beginning of a benchmark text, in any letter case: one pattern an item."""
    patterns = views.benchmark(spark, sf).select(F.substring("text", 1, 30).alias("pattern"))
    return logs.pattern_table_scan(views.documents(spark, sf), patterns, ["doc_id"], "text")


@query
def pending_versions(spark, sf):
    return checks.pending_versions(views.migration_files(spark, sf), views.migration_ledger(spark, sf))


@query
def validate_invocations(spark, sf):
    return calls.validate_invocations(views.invocation_params(spark, sf), calls.parameter_spec(spark))


@query
def answer_deadline(spark, sf):
    return sessions.answer_deadline(views.session_messages(spark, sf), 8 * 3600)


@query
def progress_by_concept(spark, sf):
    out = learning.progress_by_concept(views.progress(spark, sf), views.questions(spark, sf))
    return out.select("user_id", "concept", "attempts", _r6("correct_share", "correct_share"))


@query
def concept_mastery(spark, sf):
    """The mastery table with the check of its key and of its score's bounds."""
    table = learning.concept_mastery(views.progress(spark, sf), views.questions(spark, sf))
    twice = checks.check_unique(table, ["user_id", "concept"]).select("user_id", "concept", F.lit(False).alias("valid"))
    bounds = F.col("mastery_score").between(0, 1)
    return table.join(twice, ["user_id", "concept"], "left").select(
        "user_id", "concept", "answers", _r6("mastery_score", "mastery_score"), (bounds & F.col("valid").isNull()).alias("valid"))


@query
def nearest_concepts(spark, sf):
    vectors_of = views.embeddings(spark, sf).select(F.col("vec_id").alias("question_id"), "embedding")
    concepts = learning.concept_vectors(views.questions(spark, sf), vectors_of)
    return learning.nearest_concepts(concepts, 3, 64).select("concept", "rank", "near", _r6("distance", "distance"))


@query
def log_trace_join(spark, sf):
    """Every other log row names no span and is placed by its time."""
    spans = views.flat_spans(spark, sf)
    written = views.ev(spark, sf).select(
        "event_id", F.when(F.col("k") % 2 == 0, F.col("event_id")).alias("span_id"),
        F.concat(F.lit("t"), F.col("user_id").cast("string"), F.lit("-"), F.dayofmonth("ts").cast("string")).alias("trace_id"),
        F.timestamp_add("MICROSECOND", F.col("k") * 1000, F.col("ts")).alias("ts"))
    return logs.log_trace_join(written, spans, ["event_id"]).select("event_id", "trace_id", "span_id", "ts", "operation")


def _label_means(spark: SparkSession, sf: str) -> DataFrame:
    means = vectors.mean_vectors(views.embeddings(spark, sf), "label")
    return means.select(F.col("label").cast("bigint").alias("query_id"), "query")


def _near(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "vec_id", _r6("distance", "distance"))


@query
def retrieve_documents(spark, sf):
    nearest = vectors.knn_cosine(views.embeddings(spark, sf), _label_means(spark, sf), 5, 64)
    found = vectors.retrieve_documents(nearest, views.documents(spark, sf), "doc_id")
    return found.select("query_id", "rank", "doc_id", "text")


# ---------------------------------------------------------------- aggregations

@query
def event_stats(spark, sf):
    return events.event_stats(views.event_outcomes(spark, sf))


@query
def event_stats_by_kind(spark, sf):
    return events.event_stats(views.kind_outcomes(spark, sf))


@query
def connection_totals(spark, sf):
    return events.connection_totals(views.connections(spark, sf))


@query
def total_events(spark, sf):
    return events.total_events(views.event_outcomes(spark, sf))


@query
def stats_snapshot(spark, sf):
    return events.stats_snapshot(views.kind_outcomes(spark, sf), views.connections(spark, sf))


@query
def trace_summary(spark, sf):
    out = traces.trace_summary(views.flat_spans(spark, sf))
    return out.select("trace_id", "spans", _joined("operations"), "started", "ended")


@query
def list_services(spark, sf):
    return traces.list_services(views.flat_spans(spark, sf))


@query
def metric_line_count(spark, sf):
    return metrics.metric_line_count(views.text_payload_lines(spark, sf))


@query
def receiver_seen(spark, sf):
    named = views.logs(spark, sf).withColumn("log", F.when(F.col("level") == "notice", F.concat(F.lit("otlp "), "log"))
                                             .otherwise(F.replace("log", F.lit("no"), F.lit("OtLp"))))
    return logs.receiver_seen(named)


@query
def service_readiness(spark, sf):
    return checks.service_readiness(views.status_snapshots(spark, sf), ["day"], 5)


@query
def check_report(spark, sf):
    spans, lines = views.flat_spans(spark, sf), views.logs(spark, sf)
    samples, text = views.metric_samples(spark, sf), views.text_payload_lines(spark, sf)
    low, high = F.min("start_ts"), F.max("start_ts")
    report = checks.check_report(
        checks.check("traces", "spans exist", spans, F.count("*") > 0, low, high),
        checks.check("traces", "services named", spans, F.bool_and(F.col("service_name").isNotNull()), low, high),
        checks.check("logs", "no export errors", lines, F.count_if(F.lower("log").contains("connection refused")) == 0,
                     F.min("ts"), F.max("ts")),
        checks.check("metrics", "samples exist", samples, F.count("*") > 0, F.min("ts"), F.max("ts")),
        checks.check("metrics", "lines exist", text, F.count_if(F.length("line") > 0) > 0,
                     F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz")),
    )
    results = F.transform("results", lambda r: F.concat(r["step"], F.lit("="), r["success"].cast("string")))
    return report.withColumn("results", F.array_join(results, ";"))


@query
def verify_run(spark, sf):
    """The whole verification over the services, id sets, samples, counters and log lines of the other checks."""
    lines = views.logs(spark, sf)
    return checks.verify_run(service_readiness(spark, sf), trace_check(spark, sf), series_up(spark, sf), stats_snapshot(spark, sf), lines,
                             logs.error_pattern_scan(lines, ["ts", "log_id"]))


@query
def trace_operations(spark, sf):
    return traces.trace_operations(views.flat_spans(spark, sf))


@query
def call_groups(spark, sf):
    return calls.call_groups(views.invocation_params(spark, sf))


@query
def query_span_stats(spark, sf):
    out = traces.query_span_stats(views.db_spans(spark, sf))
    return out.withColumn("mean_params", F.round("mean_params", 6))


@query
def error_families(spark, sf):
    return errors.error_families(views.app_errors(spark, sf))


@query
def error_rate(spark, sf):
    out = events.error_rate(views.event_outcomes(spark, sf))
    return out.withColumn("error_rate", F.round("error_rate", 6))


@query
def span_red(spark, sf):
    out = traces.span_red(views.flat_spans(spark, sf))
    return out.select("service_name", "operation", "spans", _r6("error_share", "error_share"), _r6("mean_us", "mean_us"),
                      _r6("p95_us", "p95_us"))


# ---------------------------------------------------------------- windows

@query
def latency_ring(spark, sf):
    return events.latency_ring(views.event_samples(spark, sf)).select("event_name", "event_id", "latency_ns", "rank")


@query
def active_gauge(spark, sf):
    return events.active_gauge(views.connections(spark, sf)).select("event_id", "ts", "active")


@query
def recent_progress(spark, sf):
    return learning.recent_progress(views.progress(spark, sf), 5).select(
        "user_id", "rank", "event_id", "question_id", "correct", "answered_at")


@query
def log_tail(spark, sf):
    return logs.log_tail(views.logs(spark, sf), ["container_name"], ["ts", "log_id"]).select(
        "container_name", "log_id", "rank")


@query
def latest_sample(spark, sf):
    return metrics.latest_sample(views.metric_samples(spark, sf), ["job", "instance"])


@query
def scrape_samples(spark, sf):
    return metrics.scrape_samples(views.metric_samples(spark, sf), ["job", "instance"], "15 seconds")


@query
def conversation_history(spark, sf):
    return learning.conversation_history(views.conversations(spark, sf), 4)


@query
def context_size(spark, sf):
    return learning.context_size(views.conversations(spark, sf))


# ---------------------------------------------------------------- search

@query
def search_traces(spark, sf):
    spans = views.flat_spans(spark, sf)
    newest = spans.agg(F.max("start_ts")).scalar()
    return traces.search_traces(spans, "svc-1", newest, 24 * 3600)


@query
def knn_cosine(spark, sf):
    return _near(vectors.knn_cosine(views.embeddings(spark, sf), _label_means(spark, sf), 10, 64))


@query
def knn_l2(spark, sf):
    return _near(vectors.knn_l2(views.embeddings(spark, sf), _label_means(spark, sf), 10, 64))


@query
def knn_ivf(spark, sf):
    """Lists around the mean vector of each label, written once; each query looks into three of them."""
    means = _label_means(spark, sf).orderBy("query_id").collect()
    centres = np.array([r.query for r in means])
    store = views.embeddings(spark, sf).select("vec_id", "embedding")
    listed = vectors.write_lists(store, centres, run_folder(spark, "lists"))
    return _near(vectors.knn_ivf(listed, _label_means(spark, sf), centres, 10, 3))


def _every_20th(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.embeddings(spark, sf).where("vec_id % 20 = 0 and embedding is not null")
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query"))


def _ivf_rows(spark: SparkSession, sf: str) -> DataFrame:
    centres = np.array([r.query for r in _label_means(spark, sf).orderBy("query_id").collect()])
    store = views.embeddings(spark, sf).select("vec_id", "embedding")
    listed = vectors.write_lists(store, centres, run_folder(spark, "lists"))
    return vectors.knn_ivf(listed, _every_20th(spark, sf), centres, 10, 8)


@query
def knn_ivf_rows(spark, sf):
    """The same lists asked for every 20th vector, which is no centre; each looks into eight of the lists."""
    return _near(_ivf_rows(spark, sf))


@query
def knn_ivf_rows_recall(spark, sf):
    """Recall of `knn_ivf_rows` against the exact search."""
    exact = vectors.knn_l2(views.embeddings(spark, sf), _every_20th(spark, sf), 10, 64)
    return vectors.recall(_ivf_rows(spark, sf), exact).select(_r6("recall", "recall"))


def _codes(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """Ten nearest of every 20th vector by codes, and how many vectors each is compared with."""
    store = views.embeddings(spark, sf).select("vec_id", "embedding")
    centres, books = vectors.train_lists(store, lists=20), vectors.train_codes(store, 64)
    folder, compared = run_folder(spark, "index"), 60
    listed = vectors.write_lists(store, centres, f"{folder}/vectors")
    codes = vectors.write_codes(listed, books, f"{folder}/codes")
    return vectors.knn_ivf_codes(codes, listed, _every_20th(spark, sf), centres, books, 10, 17, compared), compared


@query
def knn_ivf_codes(spark, sf):
    """How many neighbours each query has, and how many differ in rank, vector or distance from an exact comparison."""
    found, _ = _codes(spark, sf)
    found = cut_lineage(found)
    whole = views.embeddings(spark, sf).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    pairs = found.join(whole, "vec_id").join(_every_20th(spark, sf), "query_id")
    true = l2(F.col("embedding"), F.col("query"))
    exact = pairs.withColumn("_place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round(true, 9), "vec_id")))
    wrong = (F.col("_place") != F.col("rank")) | (F.abs(true - F.col("distance")) > 1e-8)
    return exact.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(wrong).alias("n_wrong"))


@query
def knn_ivf_recall(spark, sf):
    """Whether the search by codes finds 9 of 10 exact neighbours and compares a fifth of the vectors at most."""
    found, compared = _codes(spark, sf)
    exact = vectors.knn_l2(views.embeddings(spark, sf), _every_20th(spark, sf), 10, 64)
    share = F.lit(compared) / F.lit(views.embeddings(spark, sf).where("embedding is not null").count())
    return vectors.recall(found, exact).select((F.col("recall") >= 0.9).alias("finds_nine_tenths"), (share <= 0.2).alias("compares_a_fifth"))


@query
def intent_match(spark, sf):
    catalogue = views.benchmark(spark, sf).select(F.col("item_id").alias("entry"), "text")
    out = matching.intent_match(views.documents(spark, sf), catalogue, "doc_id")
    return out.select("doc_id", "entry", _r6("confidence", "confidence"))


@query
def intent_match_commands(spark, sf):
    out = matching.intent_match(views.utterances(spark, sf), matching.command_catalogue(spark), "event_id")
    return out.select("event_id", "entry", _r6("confidence", "confidence"))


# ---------------------------------------------------------------- text, JSON

@query
def tokenize(spark, sf):
    return matching.token_counts(views.documents(spark, sf), "doc_id")


@query
def term_vectors(spark, sf):
    catalogue = views.benchmark(spark, sf).select(F.col("item_id").alias("entry"), "text")
    out = matching.term_vectors(views.documents(spark, sf), catalogue, "doc_id")
    return out.select("doc_id", "token", "n", _r6("weight", "weight"))


@query
def intent_route(spark, sf):
    out = matching.intent_match(views.utterances(spark, sf), matching.command_catalogue(spark), "event_id")
    alone = matching.intent_route(out).withColumnRenamed("source", "source_alone")
    both = matching.intent_route(alone, second_opinion=True)
    return both.groupBy("entry", "source_alone", "source").agg(F.count("*").alias("n"))


@query
def extract_slots(spark, sf):
    texts = views.utterances(spark, sf)
    matched = matching.intent_match(texts, matching.command_catalogue(spark), "event_id").join(texts, "event_id")
    more = [("infra.start", "detached", "bool"), ("infra.stop", "removeVolumes", "bool")]
    spec = spark.createDataFrame([p[:3] for p in calls.PARAMETERS] + more, "command string, param string, type string")
    return matching.extract_slots(matched, spec).select("event_id", "entry", "service", "detached", "remove_volumes")


@query
def parse_envelopes(spark, sf):
    out = sessions.parse_envelopes(views.session_messages(spark, sf), known=["click", "view", "purchase", "signup"])
    return out.select("event_id", "event", F.get_json_object("data", "$.k").cast("int").alias("k"), "meta_user_id",
                      "error_code")


@query
def parse_widgets(spark, sf):
    out = sessions.parse_widgets(views.question_payloads(spark, sf))
    return out.withColumn("concepts", F.array_join("concepts", ","))


@query
def namespace_metrics(spark, sf):
    named = views.metric_samples(spark, sf).select(F.col("job").alias("name"), "instance").distinct()
    return metrics.namespace_metrics(named, "agent")


@query
def span_events(spark, sf):
    out = traces.span_events(views.span_event_json(spark, sf))
    texts = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.withColumn("attributes", F.array_join(texts, ";"))


@query
def session_funnel(spark, sf):
    stages = ["client.connect", "kc.request.next", "kc.answer.submit", "kc.answer.result"]
    return sessions.session_funnel(views.session_messages(spark, sf), stages)


# ---------------------------------------------------------------- data checks

@query
def check_rows(spark, sf):
    rules = [checks.not_null("body"), checks.not_null("difficulty"), checks.in_range("difficulty", 1, 5), checks.not_null("concepts"),
             checks.not_empty("concepts")]
    questions = checks.check_rows(views.question_bank(spark, sf), ["question_id"], rules)
    stored = views.embeddings(spark, sf).select(F.col("vec_id").alias("question_id"), "embedding")
    return questions.unionByName(checks.check_rows(stored, ["question_id"], [checks.vector_length("embedding", 64)]))


@query
def check_unique(spark, sf):
    return checks.check_unique(views.progress(spark, sf), ["user_id", "question_id"])


@query
def apply_defaults(spark, sf):
    gaps = views.progress(spark, sf).withColumn("answered_at", F.when(F.col("correct"), F.col("answered_at")))
    out = checks.apply_defaults(gaps, ["answered_at"], F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return out.select("event_id", "answered_at")


# ---------------------------------------------------------------- graph

@query
def dependency_levels(spark, sf):
    spans = views.spans(spark, sf)
    out = graph.dependency_levels(spans.select(F.col("span_id").alias("node"), F.col("parent_span_id").alias("dep")))
    return out.withColumn("level", F.col("level").cast("bigint"))


@query
def dependency_levels_dag(spark, sf):
    """Numbers of orders that depend on their half and their third, as far as these are positive."""
    key = F.col("o_orderkey").cast("bigint")
    deps = F.array(F.expr("o_orderkey div 2"), F.expr("o_orderkey div 3")).cast("array<bigint>")
    edges = views.orders(spark, sf).select(key.alias("node"), F.explode(deps).alias("dep"))
    out = graph.dependency_levels(edges.select("node", F.when(F.col("dep") > 0, F.col("dep")).alias("dep")))
    return out.withColumn("level", F.col("level").cast("bigint"))


@query
def span_depth(spark, sf):
    return graph.span_depth(views.spans(spark, sf))


# ---------------------------------------------------------------- the whole way of a log record

@query
def severe_log_counts(spark, sf):
    """Severe log records per service and severity: the first query of the library."""
    return views.logs(spark, sf).transform(logs.severe_logs).groupBy(
        "service_name", "severity_text", "operation").agg(F.count("*").alias("records"))


# ---------------------------------------------------------------- streams, run over all that is there

def _lines_of(start, spark: SparkSession, sf: str, name: str, schema) -> DataFrame:
    folder = run_folder(spark, name)
    with one_state_partition_per_core(spark):
        start(_followed(spark, sf), folder, f"{folder}/checkpoint", {"availableNow": True}, log_files.STREAM_ORDER).awaitTermination()
    return log_streams.written_lines(spark, folder, schema)


@query
def stream_reassemble(spark, sf):
    return _lines_of(log_streams.stream_reassemble, spark, sf, "reassemble", log_streams.LINE).select("container_id", _ntz("ts"), "log")


@query
def stream_logs(spark, sf):
    schema = log_streams.severe(spark.createDataFrame([], log_streams.LINE)).schema
    severe = _lines_of(log_streams.stream_logs, spark, sf, "severe-logs", schema)
    return severe.select("service_name", _ntz("ts"), "severity_text", "operation", "body", "msg")


@query
def stream_event_stats(spark, sf):
    rows = views.kind_outcomes(spark, sf, table_stream)
    return event_streams.merge_event_stats(finish(event_streams.stream_event_stats(rows), "event-stats", event_streams.SALTED))


@query
def stream_active_gauge(spark, sf):
    rows = views.connections(spark, sf, table_stream)
    return finish(event_streams.stream_active_gauge(rows), "gauge", [])


@query
def stream_scrape(spark, sf):
    rows = closed_by(views.metric_samples(spark, sf, table_stream), {"job": "closing"})
    steps = finish(metric_streams.stream_scrape(rows, ["job", "instance"]), "scrape")
    return steps.select("job", "instance", _ntz("step_start"), _ntz("step_end"), "value")


@query
def stream_answer_deadline(spark, sf):
    rows = closed_by(views.session_messages(spark, sf, table_stream), {"session_id": "closing", "event": sessions.RESULT})
    settled = finish(session_streams.stream_answer_deadline(rows, 8 * 3600), "deadline")
    return settled.withColumn("answered_at", F.col("answered_at").cast("timestamp_ntz"))
