"""Trace spans: checks, summaries, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracelode.functions.once import with_once
from tracelode.operators.ordered import running_sum, slices
from tracelode.session import cut_lineage

# Operations every full trace holds, and the tags that carry the ids.
EXPECTED_SPANS = ["ws.connection", "ws.auth", "ws.event.dispatch", "db.query"]
ID_TAGS = {"user_id": "user.id", "session_id": "session.id", "request_id": "request.id"}


def trace_default_service(df: DataFrame, default: str) -> DataFrame:
    """(I) Spans without a service get the default name."""
    return df.withColumn("service_name", F.coalesce("service_name", F.lit(default)))


def trace_pipeline(df: DataFrame, default: str = "unknown-service", environment: str = "development") -> DataFrame:
    """(I) The whole way of a span to its sink: default service, then the environment, which is always set."""
    return trace_default_service(df, default).withColumn("environment", F.lit(environment))


def trace_check(spans: DataFrame, id_sets: DataFrame, expected: list[str] = EXPECTED_SPANS) -> DataFrame:
    """(I) Per id set whether its trace is there and whole: the matched trace, agreeing ids, expected spans it lacks.

    ``spans`` has tags as for ``correlation_match``. An id set without a match fails with all expected spans missing.
    """
    matched = correlation_match(spans, id_sets).select("set_id", "trace_id", "hits")
    wanted = spans.join(matched.select("trace_id").distinct(), "trace_id", "left_semi")
    lacking = missing_spans(wanted, expected).groupBy("trace_id").agg(F.count("*").alias("n_missing"))
    whole = id_sets.select("set_id").join(matched, "set_id", "left").join(lacking, "trace_id", "left")
    absent = F.when(F.col("trace_id").isNull(), F.lit(len(expected))).otherwise(F.coalesce("n_missing", F.lit(0))).cast("bigint")
    return whole.select("set_id", "trace_id", F.coalesce("hits", F.lit(0)).alias("hits"), absent.alias("n_missing"),
                        (F.col("trace_id").isNotNull() & (absent == 0)).alias("success"))


def enrich_context(df: DataFrame, row_key: list[str]) -> DataFrame:
    """(I) Request id made when empty, correlation id = trace id, other ids only when non-empty.

    A made id is a hash of the row key, so a rerun makes the same one.
    """
    made = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in row_key]))

    def given(name: str) -> Column:
        return F.nullif(F.col(name).cast("string"), F.lit(""))

    return df.withColumns({
        "request_id": F.coalesce(given("request_id"), made),
        "correlation_id": F.coalesce("trace_id", F.lit("")),
        "user_id": given("user_id"),
        "session_id": given("session_id"),
    })


def _pair(a: Column, b: Column) -> Column:
    return F.concat_ws("\x1f", a["key"], a["value"], b["key"], b["value"])


def _pairs(ids: Column) -> Column:
    """Text keys of all pairs of different id tags."""
    return F.flatten(F.transform(ids, lambda a: F.transform(
        F.filter(ids, lambda b: b["key"] > a["key"]), lambda b: _pair(a, b))))


def _id_tags(tags: Column) -> Column:
    """The id tags among the tags of a span, repeated ones included."""
    return F.filter(tags, lambda t: t["key"].isin(list(ID_TAGS.values())) & t["value"].isNotNull())


def correlation_match(spans: DataFrame, id_sets: DataFrame) -> DataFrame:
    """(I) Per id set the first span on which at least 2 of user, session and request id agree.

    ``spans`` has ``tags`` as array of (key, type, value); ``id_sets`` has ``set_id`` and
    the three ids as text. Hits are counted per tag entry. The first span is the earliest
    by (start_ts, span_id).

    A join on single ids would pair every id set of a busy user with all its spans. Two
    agreeing hits are needed, so the join key is a *pair*: two different id tags, or one
    tag present twice. Only pairs that are asked for go on; of each the first span can win,
    so they are reduced to one narrow row before they meet the id sets. What else a span
    has is fetched for the spans that won.
    """
    tagged = with_once(spans.select("trace_id", "span_id", "start_ts", "tags"), "ids", _id_tags(F.col("tags"))).drop("tags")
    repeated = F.filter("ids", lambda a: F.size(F.filter("ids", lambda b: a == b)) > 1)
    hit_twice = F.array_distinct(F.transform(repeated, lambda a: _pair(a, a)))
    by_pair = tagged.select("start_ts", "span_id", "trace_id", F.explode(F.concat(_pairs(F.col("ids")), hit_twice)).alias("pair"))

    wanted = F.array(*[F.struct(F.lit(tag).alias("key"), F.col(c).alias("value")) for c, tag in ID_TAGS.items()])
    sets = with_once(id_sets, "wanted", F.filter(wanted, lambda w: w["value"].isNotNull()))
    asked = F.concat(_pairs(F.col("wanted")), F.transform("wanted", lambda w: _pair(w, w)))
    set_pairs = sets.select("set_id", "wanted", F.explode(asked).alias("pair"))
    # Compared field by field, so the smallest is the first by (start_ts, span_id).
    first = F.min(F.struct("start_ts", "span_id", "trace_id")).alias("span")
    first_by_pair = by_pair.join(set_pairs.select("pair").distinct(), "pair", "left_semi").groupBy("pair").agg(first)
    best = first_by_pair.join(set_pairs, "pair").groupBy("set_id").agg(F.min(F.struct("span", "wanted")).alias("best"))
    won = best.select("set_id", F.col("best.span.trace_id").alias("trace_id"), F.col("best.span.span_id").alias("span_id"), F.col("best.wanted").alias("wanted"))
    whole = spans.select("trace_id", "span_id", "operation", _id_tags(F.col("tags")).alias("ids"))
    hits = F.size(F.filter("ids", lambda i: F.exists("wanted", lambda w: (w["key"] == i["key"]) & (w["value"] == i["value"]))))
    return whole.join(won, ["trace_id", "span_id"]).groupBy("set_id", "trace_id", "span_id").agg(
        F.min(F.struct(-hits, "operation")).alias("_w")).select("set_id", "trace_id", "span_id", F.col("_w.operation").alias("operation"), (-F.col("_w.col1")).alias("hits"))


def missing_spans(spans: DataFrame, expected: list[str] = EXPECTED_SPANS) -> DataFrame:
    """(I) Expected operations absent from a trace, one row each.

    One flag per expected name is kept for a trace, however large it is.
    """
    seen = [F.coalesce(F.bool_or(F.col("operation") == name), F.lit(False)).alias(f"_{i}") for i, name in enumerate(expected)]
    absent = spans.groupBy("trace_id").agg(*seen)
    missing = F.array(*[F.when(~F.col(f"_{i}"), F.lit(name)) for i, name in enumerate(expected)])
    return absent.select("trace_id", F.explode(F.filter(missing, lambda m: m.isNotNull())).alias("missing"))


def trace_integrity(spans: DataFrame) -> DataFrame:
    """(I) Per trace: spans, roots, children without parent in the trace, children of another trace.

    One pass gives, per span id and trace, how often the id is a span there and how often a
    parent. A parent with very many children is one row of that, and all counts follow
    from these rows, which are written once because they are read three times.
    """
    as_span = F.struct(F.col("span_id").alias("id"), F.lit(1).alias("is_span"))
    as_parent = F.struct(F.col("parent_span_id").alias("id"), F.lit(0).alias("is_span"))
    named = spans.select("trace_id", F.explode(F.array(as_span, as_parent)).alias("n")).where("n.id is not null")
    ids = cut_lineage(named.groupBy("n.id", "trace_id").agg(
        F.sum("n.is_span").alias("spans"), F.sum(1 - F.col("n.is_span")).alias("children")))
    known = ids.where("spans > 0").select("id", F.lit(True).alias("elsewhere")).distinct()
    lost = ids.where("spans = 0").join(known, "id", "left").groupBy("trace_id").agg(
        F.sum("children").alias("orphans"), F.sum(F.when(F.col("elsewhere"), F.col("children")).otherwise(0)).alias(
            "foreign_parents"))
    own = ids.groupBy("trace_id").agg(
        F.sum("spans").alias("spans"), (F.sum("spans") - F.sum("children")).alias("roots"))
    return own.join(lost, "trace_id", "left").na.fill(0, ["orphans", "foreign_parents"])


def trace_operations(spans: DataFrame) -> DataFrame:
    """(I) Spans, start and end per trace and operation: the summary of a trace as rows, for operations of open-ended names."""
    end = F.timestamp_add("MICROSECOND", F.col("duration_us"), F.col("start_ts"))
    return spans.groupBy("trace_id", "operation").agg(F.count("*").alias("spans"), F.min("start_ts").alias("started"), F.max(end).alias("ended"))


def trace_summary(spans: DataFrame) -> DataFrame:
    """(I) Spans, operation names, start and end per trace.

    Spans are added up per trace and operation first, so what is gathered of a trace is one row per name. Names are meant to
    come from the code of a service; ``trace_operations`` is the form without a list.
    """
    return trace_operations(spans).groupBy("trace_id").agg(
        F.sum("spans").alias("spans"), F.sort_array(F.collect_list("operation")).alias("operations"),
        F.min("started").alias("started"), F.max("ended").alias("ended"))


def list_services(spans: DataFrame) -> DataFrame:
    """(I) Services with at least one span."""
    return spans.select("service_name").where("service_name is not null").distinct()


def search_traces(spans: DataFrame, service: str, as_of: Column, lookback_seconds: int = 300,
                  limit: int = 100) -> DataFrame:
    """(I) Traces of a service that started within the lookback, newest first, at most ``limit``."""
    since = as_of - F.make_dt_interval(secs=F.lit(lookback_seconds))
    recent = spans.where((F.col("service_name") == service) & (F.col("start_ts") >= since) & (F.col("start_ts") <= as_of))
    traces = recent.groupBy("trace_id").agg(F.count("*").alias("spans"), F.min("start_ts").alias("started"))
    return traces.orderBy(F.desc("started"), "trace_id").limit(limit)


def query_span_stats(spans: DataFrame) -> DataFrame:
    """(D) Database spans per operation: count, failures, time in total, mean parameter count."""
    db = spans.where(F.col("operation").isin("db.query", "db.migration") | F.col("operation").startswith("db.transaction."))
    return db.groupBy("operation").agg(
        F.count("*").alias("spans"), F.count_if(F.col("status") == "Error").alias("failures"),
        F.sum("duration_us").alias("total_us"), F.avg("param_count").alias("mean_params"))


def span_red(spans: DataFrame, share: float = 0.95, parts: int | None = None) -> DataFrame:
    """(D) Per service and operation: spans, error share, mean and exact quantile of the duration.

    The quantile interpolates between ranks. It is read from running counts over the
    distinct durations, cut into range slices, so no group is held by one task.
    """
    keys = ["service_name", "operation"]
    groups = spans.groupBy(*keys).agg(
        F.count("*").alias("spans"), (F.count_if(F.col("status") == "Error") / F.count("*")).alias("error_share"),
        F.avg("duration_us").alias("mean_us"))
    counts = spans.groupBy(*keys, "duration_us").agg(F.count("*").alias("n"))
    running = running_sum(slices(counts, keys, ["duration_us"], parts), keys, ["duration_us"], F.col("n"), "upto")
    rank = (F.col("spans") - 1) * F.lit(share)
    low, high = F.floor(rank), F.ceil(rank)

    def holds(r: Column) -> Column:
        return (F.col("upto") > r) & (F.col("upto") - F.col("n") <= r)

    at_ranks = running.join(groups, keys).where(holds(low) | holds(high)).groupBy(*keys).agg(
        F.first("spans").alias("spans"), F.first("error_share").alias("error_share"), F.first("mean_us").alias("mean_us"),
        F.min("duration_us").alias("at_low"), F.max("duration_us").alias("at_high"))
    quantile = F.col("at_low") + (rank - F.floor(rank)) * (F.col("at_high") - F.col("at_low"))
    return at_ranks.select(*keys, "spans", "error_share", "mean_us", quantile.alias("p95_us"))


def span_events(df: DataFrame, events: str = "events") -> DataFrame:
    """(I) Events of a span (JSON list of objects) as rows: name, level if it has one, the message of an error, and all
    attributes but the name as a map. Values that are no text keep their JSON form."""
    rows = df.withColumn("_e", F.explode(F.from_json(F.col(events), "array<map<string,string>>")))
    return rows.select(*[c for c in df.columns if c != events], F.col("_e")["name"].alias("event_name"), F.col("_e")["level"].alias("level"),
                       F.col("_e")["error.message"].alias("error_message"), F.map_filter("_e", lambda k, _: k != "name").alias("attributes"))
