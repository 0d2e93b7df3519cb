import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracelode.functions import severity
from tracelode.operators import logs
from tracelode.sources import logs as log_files


def levels(spark, rows):
    df = spark.createDataFrame(rows, "level string, log string")
    return [tuple(r) for r in logs.detect_level(df).select("severity_text", "severity_number").collect()]


@pytest.mark.parametrize("level,log,text,number", [
    (None, "fatal error", "ERROR", 17),           # error words are tested first
    (None, "critical: deprecated", "WARN", 13),   # then warnings
    (None, "it is fatal", "FATAL", 21),
    (None, "terror at night", "ERROR", 17),       # words are plain substrings
    ("notice", "all fine", "INFO", 9),
    ("notice", "PANIC", "ERROR", 17),
    (None, None, "INFO", 9),
    ("", "", "INFO", 9),
    ("Err", "x", "ERROR", 17),
    ("WARNING", "panic", "WARN", 13),             # the field wins over the text
    ("critical", "x", "FATAL", 21),
    ("trace", "error", "DEBUG", 5),
])
def test_detect_level(spark, level, log, text, number):
    assert levels(spark, [(level, log)]) == [(text, number)]


def test_severity_band(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 4, 5, 12, 13, 20, 24, 25)], "severity_number int")
    bands = [r.severity_band for r in logs.severity_band(df).orderBy("severity_number").collect()]
    assert bands == [None, "TRACE", "TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", None]


def test_missing_number_is_dropped(spark):
    df = spark.createDataFrame([(None,), (12,), (13,)], "severity_number int")
    assert [r[0] for r in logs.drop_below_warn(df).collect()] == [13]


def test_merge_json_log(spark):
    df = spark.createDataFrame(
        [(1, "info", '{"level":"error","n":3,"deep":{"a":1}}'), (2, "info", "{broken"), (3, None, "text"), (4, "warn", None)],
        "id int, level string, log string")
    rows = {r.id: r for r in logs.merge_json_log(df, ["level", "n"]).collect()}
    assert (rows[1].level, rows[1].n, rows[1].log_fields["deep"]) == ("error", "3", '{"a":1}')
    assert (rows[2].level, rows[2].n, rows[2].log) == ("info", None, "{broken")
    assert rows[3].level is None and rows[4].level == "warn"


def test_level_word_and_logger_level(spark):
    df = spark.createDataFrame([("a WARNING b",), ("Error",), ("x error",), (None,)], "log string")
    assert [r.level_word for r in logs.extract_level_word(df).collect()] == ["WARN", None, "error", None]
    names = spark.createDataFrame([("WARNING",), ("fatal",), (None,), ("Debug",)], "n string")
    assert [r[0] for r in names.select(severity.logger_level(F.col("n"))).collect()] == ["warn", "info", "info", "debug"]


def test_existing_names_win(spark):
    df = spark.createDataFrame([("a", "b", "prod"), ("a", None, None)],
                               "container_name string, service_name string, environment string")
    rows = logs.modify_fields(df).select("service_name", "environment").collect()
    assert [tuple(r) for r in rows] == [("b", "prod"), ("a", "development")]
    named = logs.log_transform(df.withColumn("severity_text", F.lit(None).cast("string")).withColumn("log", F.lit("t")))
    assert [tuple(r) for r in named.select("service_name", "operation", "body").collect()] == [
        ("b", "log.unknown", "t"), ("a", "log.unknown", "t")]
    kept = logs.log_transform(named.withColumn("operation", F.lit("own")))
    assert {r.operation for r in kept.collect()} == {"own"}


def test_long_lines_are_measured_in_bytes(spark):
    df = spark.createDataFrame([("éé",), ("abc",), (None,)], "log string")
    assert [r.log for r in logs.drop_long_lines(df, 3).collect()] == ["abc", None]


def test_error_patterns_are_plain_text(spark):
    df = spark.createDataFrame(
        [(1, "dial tcp 10.0.0.1 failed"), (2, "DIAL TCP.*FAILED"), (3, "no such host"), (4, "No Such Host"), (5, None)],
        "n int, log string")
    found = {r.pattern: (r.first_line, r.n_lines) for r in logs.error_pattern_scan(df, ["n"]).collect()}
    assert found == {"dial tcp.*failed": ("DIAL TCP.*FAILED", 1), "no such host": ("no such host", 2)}


def test_receiver_seen(spark):
    def seen(*texts):
        return logs.receiver_seen(spark.createDataFrame([(t,) for t in texts], "log string")).first().seen
    assert seen("x otlp") and seen("OTLP", None)
    assert not seen("Otlp", "oTLP", None)


def test_reassemble(spark):
    rows = [("a", 1, "2024-01-01 00:00:00", "one "), ("a", 2, "2024-01-01 00:00:01", "two\n"),
            ("a", 3, "2024-01-01 00:00:02", "three\n"), ("b", 1, "2024-01-01 00:00:00", "left"),
            ("b", 2, "2024-01-01 00:00:06", "late\n"), ("a", 4, "2024-01-01 00:00:03", "open")]
    df = spark.createDataFrame(rows, "c string, n int, t string, log string").withColumn("ts", F.to_timestamp("t"))
    for parts in (1, 2, 5):
        lines = logs.reassemble(df, ["c"], ["n"], parts=parts)
        assert sorted((r.c, r.log) for r in lines.collect()) == [
            ("a", "one two\n"), ("a", "open"), ("a", "three\n"), ("b", "late\n"), ("b", "left")]


def test_reassemble_sends_on_two_lines_a_slice(spark, tmp_path):
    """One pass joins all but the lines at the ends of slices, over batches of a few rows; null keys, texts and times are rows."""
    rng, day, rows = random.Random(5), datetime(2024, 1, 1), []
    for i in range(600):
        text = rng.choice([f"{i} ", f"{i} ", f"{i}\n", None])
        rows.append((rng.choice(["a", "a", "a", "b", None]), i, None if i % 11 == 0 else day + timedelta(seconds=i * (1 if i % 50 else 3)), "x" if 200 < i < 350 else text))
    wanted, last = [], {}
    for key, i, ts, text in sorted(rows, key=lambda r: r[1]):
        line = last.get(key)
        if line is None or line["ended"] or (ts and line["at"] and ts > line["at"] + timedelta(seconds=5)):
            last[key] = line = {"key": key, "text": "", "times": []}
            wanted.append(line)
        line["text"] += text or ""
        line["times"] += [ts] if ts else []
        line.update(at=ts, ended=bool(text) and text.endswith("\n"))
    df = spark.createDataFrame(rows, "c string, n int, ts timestamp, log string").withColumn("_started", F.col("ts"))
    expected = sorted((str(w["key"]), str(min(w["times"], default=None)), str(max(w["times"], default=None)), w["text"], w is last[w["key"]]) for w in wanted)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for parts in (1, 4, 40):
            found = logs.joined_parts(df, ["c"], ["n"], 5, f"{tmp_path}/{parts}", parts)
            assert sorted((str(r.c), str(r._started), str(r.ts), r.log, r.final) for r in found.collect()) == expected
            assert spark.read.parquet(f"{tmp_path}/{parts}").where("_edge is not null").count() <= 2 * parts
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_container_of_a_path(spark):
    """The search of a path takes as long as the path, not as its square."""
    paths = ["file:/logs/c1/app.log", "/c2/app.log.1", "c3/x", "x", "", "/x", "a//x", "a/b/", None, "/" + "d" * 150_000 + "/c4/" + "f" * 150_000]
    start = time.perf_counter()
    df = spark.createDataFrame([(p,) for p in paths], "p string").select(log_files.folder_name(F.col("p")).alias("c"), log_files.file_age(F.col("p")).alias("age"))
    rows = df.collect()
    assert [r.c for r in rows] == ["c1", "c2", "c3", "", "", "", "", "", None, "c4"]
    assert [r.age for r in rows] == [0, -1, 0, 0, 0, 0, 0, 0, 0, 0]
    assert time.perf_counter() - start < 10
    assert "try_cast" not in df._jdf.queryExecution().toString()


def test_tail_reads_files(spark, tmp_path):
    folder = tmp_path / "c1"
    folder.mkdir()
    (folder / "c1-json.log").write_text(
        '{"log":"hi\\n","stream":"stdout","time":"2024-01-01T10:00:00.123456789Z"}\n'
        '{"log":"no zone","stream":"stderr","time":"2024-01-01T10:00:00.5"}\nbroken\n')
    rows = log_files.log_tail_load(spark, f"{tmp_path}/*/*").orderBy("line_id").collect()
    assert [(r.log, r.source, r.container_id) for r in rows] == [
        ("hi\n", "docker", "c1"), ("no zone", "docker", "c1"), (None, "docker", "c1")]
    assert rows[0].ts.microsecond == 123456 and rows[1].ts.microsecond == 500000


def test_union_receivers_fills_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, log string")
    b = spark.createDataFrame([(2, "y")], "id int, body string")
    assert sorted(map(tuple, logs.union_receivers(a, b).collect()), key=str) == [(1, "x", None), (2, None, "y")]


def test_table_of_patterns(spark, monkeypatch):
    """Patterns within patterns, overlapping, in other letters, many of them, in one scan and in several."""
    rows = [(2, "She sells Sea shells"), (1, "he and SHE"), (None, "hers"), (3, None), (4, ""), (5, "éÉ she")]
    lines = spark.createDataFrame(rows, "n int, log string")
    texts = ["he", "SHE", "she", "hers", "ells s", "É", "", None, "absent", *[f"x{i}" for i in range(3000)]]
    patterns = spark.createDataFrame([(t,) for t in texts], "pattern string")
    expected = {"he": ("hers", 4), "SHE": ("he and SHE", 3), "she": ("he and SHE", 3), "hers": ("hers", 1), "ells s": ("She sells Sea shells", 1), "É": ("éÉ she", 1)}
    for most in (100_000, 500):
        monkeypatch.setattr(logs, "PATTERNS_PER_SCAN", most)
        found = logs.pattern_table_scan(lines, patterns, ["n"]).collect()
        assert {r.pattern: (r.first_line, r.n_lines) for r in found} == expected and len(found) == 6
    assert logs.pattern_table_scan(lines.limit(0), patterns, ["n"]).count() == 0
    assert logs.pattern_table_scan(lines, patterns.limit(0), ["n"]).count() == 0


def test_table_of_patterns_equals_the_list(spark):
    rows = [(i, t) for i, t in enumerate(["Connection REFUSED by x", "ok", "tls handshake", "no such host: connection error", "dial tcp.*failed"] * 3)]
    lines = spark.createDataFrame(rows, "n int, log string")
    table = spark.createDataFrame([(p,) for p in logs.EXPORT_ERRORS], "pattern string")
    columns = ["pattern", "first_line", "n_lines"]
    found, expected = (sorted(map(tuple, df.select(columns).collect())) for df in (logs.pattern_table_scan(lines, table, ["n"]), logs.error_pattern_scan(lines, ["n"])))
    assert found == expected
