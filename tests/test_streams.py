"""Streams over several batches equal their batch forms below the final watermark."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracelode.operators import events, logs, metrics, sessions
from tracelode.streaming import events as event_streams, logs as log_streams, metrics as metric_streams
from tracelode.streaming import sessions as session_streams
from tracelode.streaming import tables
from tracelode.streaming.run import closed_by, finish

START = datetime(2024, 1, 1)
CLOSING = 10**6   # an event far in the future closes all windows


@pytest.fixture
def stream(spark, tmp_path):
    """Rows as a stream that takes one file per batch, and as a frame."""
    def make(rows, schema, batches=4):
        df = spark.createDataFrame(rows, schema)
        step = -(-len(rows) // batches)
        for i in range(batches):
            part = rows[i * step:(i + 1) * step]
            if part:
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return source, df
    return make


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    found, expected = (sorted(map(str, df.select(columns).collect())) for df in (a, b))
    assert found == expected and found


def test_event_stats(stream):
    """In any arrival order, with one event name holding most rows."""
    rng = random.Random(5)
    rows = [(i, START + timedelta(seconds=i), rng.choice(["hot", "hot", "hot", "b"]), rng.random() < 0.2, rng.randrange(10**6))
            for i in range(600)] + [(601, START, "only.bad", True, 1)]
    rng.shuffle(rows)
    source, df = stream(rows, "event_id bigint, ts timestamp, event_name string, is_error boolean, latency_ns bigint")
    now = finish(event_streams.stream_event_stats(source, salts=3), "stats", event_streams.SALTED)
    assert now.count() == now.select(*event_streams.SALTED).distinct().count()
    same(event_streams.merge_event_stats(now), events.event_stats(df))


def test_gauge(stream):
    rows = [(i, START, d) for i, d in enumerate([1, 1, -1, 1, -1, 1, 1])]
    source, df = stream(rows, "event_id bigint, ts timestamp, delta int")
    same(finish(event_streams.stream_active_gauge(source), "gauge", []), events.connection_totals(df))


def test_scrape(stream):
    rng = random.Random(6)
    rows = [(i, START + timedelta(seconds=i), rng.choice("ab"), rng.random()) for i in range(200)]
    rows.append((10**6, START + timedelta(seconds=CLOSING), "a", 0.0))
    source, df = stream(rows, "event_id bigint, ts timestamp, job string, value double")
    closed = metrics.scrape_samples(df, ["job"]).where(F.col("step_end") < F.lit(START + timedelta(seconds=CLOSING - 100)))
    same(finish(metric_streams.stream_scrape(source, ["job"]), "scrape"), closed)


def test_late_rows_are_dropped(stream):
    rows = [(1, START + timedelta(hours=1), "a", 1.0), (2, START + timedelta(hours=3), "a", 2.0), (3, START, "a", 3.0),
            (4, START + timedelta(hours=9), "a", 4.0)]
    source, _ = stream(rows, "event_id bigint, ts timestamp, job string, value double")
    assert [r.value for r in finish(metric_streams.stream_scrape(source, ["job"]), "late").orderBy("value").collect()] == [1.0, 2.0]


def test_deadline(stream):
    """Every answer is settled once, over batches, by the event that comes last."""
    rng = random.Random(7)
    kinds = [sessions.ANSWER, sessions.RESULT, sessions.UPDATE]
    rows = [(i, START + timedelta(milliseconds=i * 700), rng.choice(["hot", "hot", "b"]), rng.choice(kinds)) for i in range(240)]
    rows += [(300 + i, START + timedelta(minutes=9, seconds=30 * i), "slow", kinds[i % 3]) for i in range(9)]
    rows.append((10**6, START + timedelta(seconds=CLOSING), "end", sessions.RESULT))
    source, df = stream(rows, "event_id bigint, ts timestamp, session_id string, event string")
    settled = finish(session_streams.stream_answer_deadline(source), "deadline")
    same(settled, sessions.answer_deadline(df))
    assert {r.status for r in settled.collect()} == {"complete", "late_or_absent"}


def test_deadline_of_shuffled_arrivals(stream):
    """Replies before their answers, within the delay."""
    rng = random.Random(8)
    kinds = [sessions.ANSWER, sessions.RESULT, sessions.UPDATE]
    rows = [(i, START + timedelta(milliseconds=i * 333, microseconds=i), rng.choice("abc"), rng.choice(kinds)) for i in range(300)]
    rows = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randrange(40)))
    rows.append((None, START + timedelta(seconds=CLOSING), "end", sessions.RESULT))
    source, df = stream(rows, "event_id bigint, ts timestamp, session_id string, event string", batches=6)
    same(finish(session_streams.stream_answer_deadline(source, 4), "deadline"), sessions.answer_deadline(df, 4))


def test_deadline_of_odd_rows(stream):
    """Answers that come twice, without a session, an id or a time; no row goes to Python."""
    a, r, u = sessions.ANSWER, sessions.RESULT, sessions.UPDATE
    at = lambda s: START + timedelta(seconds=s)
    rows = [(1, at(5), "s", a), (1, at(5), "s", a), (2, None, "s", a), (None, at(5), "s", a), (3, at(13), "s", r), (4, at(4.9), "s", u), (5, at(5), "s", u),
            (6, at(20), None, a), (7, at(27), None, r), (8, at(28.1), None, u), (9, at(CLOSING), "end", r)]
    source, _ = stream(rows, "event_id bigint, ts timestamp, session_id string, event string", batches=2)
    settled = session_streams.stream_answer_deadline(source)
    assert "InPandas" not in settled._jdf.queryExecution().toString()
    got = sorted((x.answer_id, x.session_id, x.result_in_time, x.update_in_time, x.status) for x in finish(settled, "deadline").collect())
    assert got == [(1, "s", True, True, "complete"), (6, None, True, False, "late_or_absent")]


def lines(rows):
    return [(c, i, START + timedelta(seconds=t), text) for i, (c, t, text) in enumerate(rows)]


LINE = "container_id string, n int, ts timestamp, log string"


def run_lines(start, source, tmp_path, schema=log_streams.LINE):
    path = str(tmp_path / "out")
    start(source, path, str(tmp_path / "checkpoint"), {"availableNow": True}, ["n"]).awaitTermination()
    return log_streams.written_lines(source.sparkSession, path, schema)


def test_reassemble_over_batches(stream, tmp_path):
    rows = lines([("a", 0, "one "), ("b", 0, "left"), ("a", 1, "two"), ("b", 7, "late\n"), ("a", 2, " three\n"), ("a", 3, "x\n"),
                  ("c", 3, "open"), ("a", CLOSING, "end\n")])
    source, df = stream(rows, LINE)
    joined = run_lines(log_streams.stream_reassemble, source, tmp_path)
    same(joined, logs.reassemble(df, ["container_id"], ["n"]))
    assert "one two three\n" in [r.log for r in joined.collect()]


def test_one_container_of_parts(stream, tmp_path):
    """Parts of equal times stand by their place in the file, over many batches of one container."""
    rng, rows = random.Random(3), []
    for i in range(400):
        rows.append(("hot" if i % 9 else None, i // 7, f"{i}" + ("\n" if rng.random() < 0.3 else " ")))
    source, df = stream(lines(rows + [("z", CLOSING, "end\n")]), LINE, batches=9)
    same(run_lines(log_streams.stream_reassemble, source, tmp_path), logs.reassemble(df, ["container_id"], ["n"]))


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    joiner = log_streams.LineJoiner(path, ["n"], 5, 60, None)
    batches = [spark.createDataFrame(lines(rows), LINE) for rows in ([("a", 0, "one ")], [("a", 1, "two\n"), ("b", 1, "x\n")], [("b", 900, "y\n")])]
    for number in (0, 0, 1, 0, 1, 1, 2):
        joiner(batches[number], number)
    found = log_streams.written_lines(spark, path)
    assert sorted(r.log for r in found.collect()) == ["one two\n", "x\n", "y\n"]


def test_joined_lines_of_a_batch_go_when_it_ends(spark, tmp_path):
    """The joined lines are written once, for both tables to read, and are gone after the batch."""
    seen, out, rng = [], tmp_path / "out", random.Random(9)

    def look(joined):
        seen.append([f.name for f in out.iterdir() if f.name.startswith("joined-")])
        return joined

    joiner = log_streams.LineJoiner(str(out), ["n"], 5, 60, look)
    for batch in range(2):
        rows = lines([(rng.choice("abc"), i // 9, f"{i}" + rng.choice(["\n", " "])) for i in range(100)])
        joiner(spark.createDataFrame(rows, LINE), batch)
    assert seen == [["joined-0"], ["joined-1"]]
    assert sorted(f.name for f in out.iterdir()) == ["lines", "open"]


def test_lines_without_time_or_text(stream, tmp_path):
    """As in the batch form, nothing is lost; a line that is not closed by the end of the stream is still open."""
    rows = [("a", 0, START, "x\n"), ("a", 1, None, "no time\n"), ("a", 2, START, None), ("a", 3, START, "tail\n"), (None, 4, START, "lone\n"), ("b", 5, None, "open")]
    source, df = stream(rows, LINE, batches=1)
    found = sorted(r.log for r in run_lines(log_streams.stream_reassemble, source, tmp_path).collect())
    assert found == sorted(r.log for r in logs.reassemble(df, ["container_id"], ["ts", "n"]).collect() if r.log != "open")


def test_severe_logs(stream, tmp_path):
    rows = lines([("a", 0, '{"level":"warn",'), ("a", 1, '"msg":"slow"}\n'), ("a", 2, "fine\n"), ("b", 3, "it fai"), ("b", 4, "led\n"),
                  ("a", CLOSING, "end\n")])
    source, df = stream(rows, LINE)
    columns = ["service_name", "severity_text", "operation", "body", "msg", "environment"]
    batch = log_streams.severe(logs.reassemble(df, ["container_id"], ["n"]))
    out = run_lines(log_streams.stream_logs, source, tmp_path, batch.schema).select(columns)
    same(out, batch.select(columns))
    assert out.count() == 2


def test_tables_stay_small_over_many_batches(spark, tmp_path):
    """A merged table is one folder, an appended one a few, however many batches came; older states go."""
    merged, appended = (tables.BatchTable(spark, str(tmp_path / n), 3) for n in ("merged", "appended"))
    for batch in range(30):
        rows = spark.createDataFrame([(batch % 4, batch), (None, batch)], "k int, v int").coalesce(1)
        for _ in range(1 + batch % 2):
            merged.merge(rows, batch, ["k"])
            appended.append(rows, batch)
    assert sorted((r.k, r.v) for r in merged.read(rows.schema).where("k is not null").collect()) == [(0, 28), (1, 29), (2, 26), (3, 27)]
    assert [r.v for r in merged.read(rows.schema).where("k is null").collect()] == [29]
    assert sorted(r.v for r in appended.read(rows.schema).where("k is not null").collect()) == list(range(30))
    assert len(merged.state()["folders"]) == 1 and len(appended.state()["folders"]) <= 9
    assert merged.batches() == appended.batches() == [28, 29]
    for name, most in (("merged", 2), ("appended", 14)):
        assert len([f for f in (tmp_path / name).iterdir() if f.name.startswith("part-")]) <= most


def test_a_batch_without_manifest_is_not_seen(spark, tmp_path):
    table = tables.BatchTable(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(1,)], "v int")
    table.append(rows, 0)
    table._write(rows)  # as a run that was stopped before its manifest
    assert table.read(rows.schema).count() == 1
    table.append(rows, 1)
    assert table.read(rows.schema).count() == 2 and len([f for f in (tmp_path / "t").iterdir() if f.name.startswith("part-")]) == 2


def test_stream_into_signal_folders(stream, spark, tmp_path):
    from tracelode.sources import sinks
    source, _ = stream([(1, START), (2, START + timedelta(days=1))], "id int, ts timestamp")
    out = str(tmp_path / "out")
    sinks.stream_signal(source, "ts", "logs", out, str(tmp_path / "cp"), {"availableNow": True}).awaitTermination()
    assert sinks.read_signal(spark, out, "logs").where("day = '2024-01-02'").first().id == 2


def test_partitioned_tables_are_merged(spark, tmp_path):
    """Folders by day stay folders by day when they are written together, and a filter on the day prunes them."""
    table = tables.BatchTable(spark, str(tmp_path / "t"), 2, ["day"])
    for batch in range(5):
        rows = spark.createDataFrame([(batch, START), (batch, START + timedelta(days=batch))], "v int, ts timestamp").withColumn("day", F.to_date("ts"))
        table.append(rows, batch)
    read = tables.read_folders(spark, table.folders())
    assert read.count() == 10 and read.where("day = '2024-01-01'").count() == 6 and len(table.folders()) <= 3
    assert table.read(rows.schema).where("day = '2024-01-05'").first().v == 4
    assert "PartitionFilters: [isnotnull(day" in read.where("day = '2024-01-05'")._jdf.queryExecution().toString()
