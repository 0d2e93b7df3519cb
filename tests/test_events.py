import random

import pytest
from pyspark.sql import functions as F

from tracelode.operators import events
from tracelode.operators.ordered import previous, running_sum, slices

OUTCOME = "event_id bigint, ts timestamp_ntz, event_name string, is_error boolean, latency_ns bigint"


def outcomes(spark, rows):
    from datetime import datetime, timedelta
    start = datetime(2024, 1, 1)
    full = [(i, start + timedelta(seconds=i), name, bad, ns) for i, (name, bad, ns) in enumerate(rows)]
    return spark.createDataFrame(full, OUTCOME)


def stats(spark, rows):
    return {r.event_name: r for r in events.event_stats(outcomes(spark, rows)).collect()}


def test_counts_and_samples(spark):
    out = stats(spark, [("kc.request.next", False, 100_000_000)] * 2)["kc.request.next"]
    assert (out["count"], out.latency_samples, out.avg_latency_ns) == (2, 2, 100_000_000)


def test_errors_need_a_processed_row(spark):
    out = stats(spark, [("kc.answer.submit", False, 10), *[("kc.answer.submit", True, 1)] * 3, ("only.bad", True, 1)])
    assert set(out) == {"kc.answer.submit"} and out["kc.answer.submit"].errors == 3


def test_average_covers_last_hundred_only_and_is_whole(spark):
    out = stats(spark, [("e", False, 1_000_000)] * 50 + [("e", False, n) for n in range(100)])["e"]
    assert (out["count"], out.latency_samples, out.avg_latency_ns) == (150, 100, 49)


def test_ring_equals_plain_average_below_hundred(spark):
    values = [random.Random(1).randrange(10**9) for _ in range(60)]
    assert stats(spark, [("e", False, v) for v in values])["e"].avg_latency_ns == sum(values) // 60


def connections(spark, deltas):
    return outcomes(spark, [("c", False, d) for d in deltas]).select("event_id", "ts", F.col("latency_ns").alias("delta"))


def test_open_open_close(spark):
    assert tuple(events.connection_totals(connections(spark, [1, 1, -1])).first()) == (2, 1)
    assert tuple(events.connection_totals(connections(spark, [1, -1] * 10)).first()) == (10, 0)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_gauge_over_slices(spark, parts):
    deltas = [random.Random(2).choice([1, 1, -1]) for _ in range(200)]
    rows = events.active_gauge(connections(spark, deltas), parts).orderBy("event_id").collect()
    total, expected = 0, []
    for d in deltas:
        total += d
        expected.append(total)
    assert [r.active for r in rows] == expected


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_running_values_with_a_hot_key(spark, parts):
    """A third of the rows and more share one key; null is a key like any other."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), i, rng.randrange(10)) for i in range(300)]
    cut = slices(spark.createDataFrame(rows, "k string, n int, v int"), ["k"], ["n"], parts)
    out = running_sum(previous(cut, ["k"], ["n"], F.col("v"), "before"), ["k"], ["n"], F.col("v"), "upto")
    got = {(r.k, r.n): (r.before, r.upto) for r in out.collect()}
    total, last = {}, {}
    for k, n, v in rows:
        total[k] = total.get(k, 0) + v
        assert got[(k, n)] == (last.get(k), total[k])
        last[k] = v
    assert len(got) == len(rows)


def test_snapshot_is_rows(spark):
    rows = events.stats_snapshot(outcomes(spark, [("a", False, 4), ("b", False, 6), ("b", True, 1)]), connections(spark, [1, 1, -1])).collect()
    assert sorted((r.event_name or "", r.total, r.active, r["count"], r.errors) for r in rows) == [
        ("", 2, 1, None, None), ("a", None, None, 1, 0), ("b", None, None, 1, 1)]


def test_exposition_text(spark):
    rows = events.render_exposition(outcomes(spark, [("kc.request.next", False, 1_500_000)] * 2), connections(spark, [1, 1]))
    assert [r.line for r in rows.orderBy("line_no").collect()] == [
        "# TYPE ws_connections gauge", "ws_connections 2", "# TYPE ws_events_total counter", "ws_events_total 2",
        "# TYPE ws_kc_request_next_latency_seconds gauge", "ws_kc_request_next_latency_seconds 0.001500"]


def test_exposition_without_the_event(spark):
    rows = events.render_exposition(outcomes(spark, [("e", False, 5)]), connections(spark, [1])).collect()
    assert rows[-1].line.endswith("latency_seconds 0.000000")


def test_error_rate_of_nothing(spark):
    assert events.error_rate(outcomes(spark, [])).count() in (0, 1)
