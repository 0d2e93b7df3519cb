import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.operators import traces
from tracelode.sources import traces as files

START = datetime(2024, 1, 1)
SPAN = "trace_id string, span_id string, parent_span_id string, operation string, start_ts timestamp_ntz"


def spans(spark, rows):
    return spark.createDataFrame([(t, s, p, o, START + timedelta(seconds=i)) for i, (t, s, p, o) in enumerate(rows)], SPAN)


def tagged(spark, rows):
    """rows: (trace, span, [(key, value)])"""
    full = [(t, s, "op", START + timedelta(seconds=i), [(k, "string", v) for k, v in tags]) for i, (t, s, tags) in enumerate(rows)]
    return spark.createDataFrame(full, "trace_id string, span_id string, operation string, start_ts timestamp_ntz, "
                                       "tags array<struct<key:string,type:string,value:string>>")


def match(spark, rows, ids=("u", "s", "r")):
    sets = spark.createDataFrame([("set", *ids)], "set_id string, user_id string, session_id string, request_id string")
    return [(r.span_id, r.hits) for r in traces.correlation_match(tagged(spark, rows), sets).collect()]


def test_two_of_three_ids(spark):
    one, two, three = [("user.id", "u")], [("user.id", "u"), ("session.id", "s")], [
        ("user.id", "u"), ("session.id", "s"), ("request.id", "r")]
    assert match(spark, [("t", "1", one)]) == []
    assert match(spark, [("t", "1", one), ("t", "2", two), ("t", "3", three)]) == [("2", 2)]
    assert match(spark, [("t", "3", three), ("t", "2", two)]) == [("3", 3)]


def test_repeated_tag_counts_twice(spark):
    assert match(spark, [("t", "1", [("user.id", "u"), ("user.id", "u")])]) == [("1", 2)]
    assert match(spark, [("t", "1", [("user.id", "u"), ("user.id", "v"), ("x", "s")])]) == []
    assert match(spark, [("t", "1", [("user.id", "u"), ("user.id", "u"), ("request.id", "r")])]) == [("1", 3)]
    assert match(spark, [("t", "1", [("user.id", "u"), ("session.id", "s")])], ("u", None, "r")) == []


def test_correlation_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(f"t{i % 5}", f"{i:03d}", [(k, str(rng.integers(3))) for k in rng.choice(
        ["user.id", "session.id", "request.id", "other"], 3)]) for i in range(60)]
    sets = [(f"s{i}", *[str(rng.integers(3)) for _ in range(3)]) for i in range(20)]
    df = spark.createDataFrame(sets, "set_id string, user_id string, session_id string, request_id string")
    got = {r.set_id: (r.span_id, r.hits) for r in traces.correlation_match(tagged(spark, rows), df).collect()}
    expected = {}
    for name, *ids in sets:
        wanted = dict(zip(["user.id", "session.id", "request.id"], ids))
        for _, span, tags in rows:
            hits = sum(wanted.get(k) == v for k, v in tags)
            if hits >= 2:
                expected[name] = (span, hits)
                break
    assert got == expected


def test_missing_spans(spark):
    df = spans(spark, [("t", "1", None, "ws.connection"), ("t", "2", "1", "db.query"), ("t", "3", "1", "other")])
    assert sorted(r.missing for r in traces.missing_spans(df).collect()) == ["ws.auth", "ws.event.dispatch"]


def test_trace_integrity(spark):
    df = spans(spark, [("t", "parent", None, "a"), ("t", "child", "parent", "b"), ("u", "1", "parent", "c"),
                       ("u", "2", "nowhere", "c"), ("u", "3", "nowhere", "c")])
    rows = {r.trace_id: (r.spans, r.roots, r.orphans, r.foreign_parents) for r in traces.trace_integrity(df).collect()}
    assert rows == {"t": (2, 1, 0, 0), "u": (3, 0, 3, 1)}


def test_search_limit_and_order(spark):
    df = spans(spark, [(f"t{i}", "1", None, "a") for i in range(5)]).withColumn("service_name", F.lit("s"))
    last = F.lit(START + timedelta(seconds=3)).cast("timestamp_ntz")
    found = [r.trace_id for r in traces.search_traces(df, "s", last, 2, limit=2).collect()]
    assert found == ["t3", "t2"]
    assert traces.search_traces(df, "other", last).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_span_red_quantile(spark, parts):
    rng = np.random.default_rng(1)
    rows = [("hot" if rng.random() < 0.5 else f"s{i % 4}", "op", int(d), "Ok" if i % 3 else "Error")
            for i, d in enumerate(rng.integers(0, 50, 400))]
    df = spark.createDataFrame(rows, "service_name string, operation string, duration_us bigint, status string")
    for r in traces.span_red(df, parts=parts).collect():
        own = [d for s, _, d, _ in rows if s == r.service_name]
        assert r.spans == len(own) and abs(r.p95_us - np.quantile(own, 0.95)) < 1e-9


def test_enrich_context(spark):
    df = spark.createDataFrame([(1, "t", "", "user-123", "sess-456"), (2, None, "req-789", "", None)],
                               "id int, trace_id string, request_id string, user_id string, session_id string")
    a, b = traces.enrich_context(df, ["id"]).orderBy("id").collect()
    assert len(a.request_id) == 32 and (a.correlation_id, a.user_id, a.session_id) == ("t", "user-123", "sess-456")
    assert (b.request_id, b.correlation_id, b.user_id, b.session_id) == ("req-789", "", None, None)
    again = traces.enrich_context(df, ["id"]).where("id = 1").first()
    assert again.request_id == a.request_id


def test_trace_documents(spark, tmp_path):
    document = {"data": [{"traceID": "t", "spans": [
        {"traceID": "t", "spanID": "a", "operationName": "ws.connection", "references": [], "startTime": 1_000_000,
         "duration": 5, "tags": [{"key": "user.id", "type": "int64", "value": 42},
                                 {"key": "user.id", "type": "string", "value": "x"}, {"key": "ok", "type": "bool", "value": True}]},
        {"traceID": "t", "spanID": "b", "operationName": "db.query",
         "references": [{"refType": "CHILD_OF", "traceID": "t", "spanID": "a"}], "startTime": 2, "duration": 1, "tags": []}]}]}
    (tmp_path / "a.json").write_text(json.dumps(document, indent=1))
    rows = {r.span_id: r for r in files.trace_json_load(spark, str(tmp_path)).collect()}
    assert rows["a"].tag_map == {"user.id": "42", "ok": "true"} and len(rows["a"].tags) == 3
    assert rows["a"].parent_span_id is None and rows["b"].parent_span_id == "a"
    assert rows["a"].start_ts.second == 1


def test_query_spans(spark):
    rows = [("db.query", "Ok", 5, 2), ("db.query", "Error", 7, 0), ("db.transaction.save", "Ok", 1, None), ("other", "Ok", 9, 1)]
    df = spark.createDataFrame(rows, "operation string, status string, duration_us bigint, param_count int")
    got = {r.operation: tuple(r)[1:] for r in traces.query_span_stats(df).collect()}
    assert got == {"db.query": (2, 1, 12, 1.0), "db.transaction.save": (1, 0, 1, None)}


def test_span_event_attributes(spark):
    df = spark.createDataFrame([(1, '[{"name":"cache.miss","key":"k1","n":3},{"name":"query failed","level":"error","error.message":"boom"}]')], "span_id int, events string")
    rows = [tuple(r) for r in traces.span_events(df).collect()]
    assert rows == [(1, "cache.miss", None, None, {"key": "k1", "n": "3"}),
                    (1, "query failed", "error", "boom", {"level": "error", "error.message": "boom"})]


def test_logs_meet_the_innermost_span(spark):
    from datetime import datetime, timedelta

    from tracelode.operators import logs
    start = datetime(2024, 1, 1)
    spans = spark.createDataFrame([("t", "outer", "root", start, 600_000_000), ("t", "inner", "step", start + timedelta(seconds=100), 50_000_000),
                                   ("t", "short", "step2", start + timedelta(seconds=100), 20_000_000)],
                                  "trace_id string, span_id string, operation string, start_ts timestamp, duration_us bigint")
    at = lambda s: start + timedelta(seconds=s)
    rows = [(1, "t", None, at(110)), (2, "t", None, at(130)), (3, "t", None, at(500)), (4, "t", None, at(700)), (5, "t", "inner", at(110)),
            (6, "t", "inner", at(400)), (7, None, None, at(110))]
    df = spark.createDataFrame(rows, "id int, trace_id string, span_id string, ts timestamp")
    got = {r.id: (r.span_id, r.operation) for r in logs.log_trace_join(df, spans, ["id"]).collect()}
    assert got == {1: ("short", "step2"), 2: ("inner", "step"), 3: ("outer", "root"), 5: ("inner", "step")}


def test_long_and_short_spans_of_one_trace(spark):
    """Against all pairs, spans of microseconds to years; a span is two rows at most."""
    import random
    from datetime import datetime, timedelta

    from tracelode.operators import logs
    rng, start = random.Random(1), datetime(2024, 1, 1)
    spans = [(rng.choice("ab"), i, f"op{i}", start + timedelta(microseconds=rng.randrange(10**9)), rng.choice([0, 1, 10**3, 10**6, 10**8, 400 * 86_400 * 10**6])) for i in range(120)]
    rows = [(i, rng.choice("abc"), rng.choice([None, None, rng.randrange(120)]), start + timedelta(microseconds=rng.randrange(2 * 10**9))) for i in range(300)]
    rows += [(1000, "a", None, start + timedelta(days=300)), (1001, None, None, start), (1002, "a", None, start - timedelta(days=9000))]
    expected = {}
    for i, trace, span, ts in rows:
        hits = [s for s in spans if s[0] == trace and s[3] <= ts <= s[3] + timedelta(microseconds=s[4]) and (span is None or span == s[1])]
        if hits:
            best = min(hits, key=lambda s: (-s[3].timestamp(), s[4], s[1]))
            expected[i] = (best[1], best[2])
    df = spark.createDataFrame(rows, "id int, trace_id string, span_id int, ts timestamp")
    frame = spark.createDataFrame(spans, "trace_id string, span_id int, operation string, start_ts timestamp, duration_us bigint")
    assert {r.id: (r.span_id, r.operation) for r in logs.log_trace_join(df, frame, ["id"]).collect()} == expected
    assert logs.log_trace_join(df, frame.limit(0), ["id"]).count() == 0
