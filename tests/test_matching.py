import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelode.functions.text import tokens
from tracelode.functions.typed import duration_ns, typed_text
from tracelode.functions.vectors import cosine, l2
from tracelode.operators import calls, matching


def cut(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t"))).first()[0]


def test_tokens(spark):
    assert cut(spark, "Please show THE Postgres-logs, é e 7 x1!") == ["show", "postgres", "logs", "é", "x1"]
    assert cut(spark, "") == [] and cut(spark, "...") == []


def best(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = matching.intent_match(df, matching.command_catalogue(spark), "id").orderBy("id").collect()
    return [(r.entry, r.confidence) for r in rows]


def python_best(text):
    """The rule in plain Python, for one text."""
    def cut_text(t):
        words = "".join(c if c.isalnum() else " " for c in t.lower()).split()
        return [w for w in words if len(w.encode()) > 1 and w not in matching.STOP]
    entries = {n: cut_text(" ".join([n, d, *e])) for n, d, e in matching.COMMANDS}
    known = {w for words in entries.values() for w in words}
    own = [w for w in cut_text(text) if w in known]
    scored = []
    for name, words in entries.items():
        dot = sum(own.count(w) * words.count(w) for w in set(own))
        norms = math.sqrt(sum(own.count(w) ** 2 for w in set(own)) * sum(words.count(w) ** 2 for w in set(words)))
        if dot:
            scored.append((-dot / norms, name))
    return min(scored)[::-1] if scored else (None, 0.0)


def test_match_against_plain_rule(spark, monkeypatch):
    from tracelode.functions.text import STOP_WORDS
    monkeypatch.setattr(matching, "STOP", set(STOP_WORDS), raising=False)
    texts = ["show postgres logs", "Run the migrations!", "unknownword show show logs", "qqq zzz", "", "check"]
    for text, (entry, confidence) in zip(texts, best(spark, *texts)):
        name, score = python_best(text)
        assert entry == name and abs(confidence - abs(score)) < 1e-12 and 0 <= confidence <= 1 + 1e-12


def test_unknown_words_do_not_lower_confidence(spark):
    (a, x), (b, y) = best(spark, "show logs", "show logs xyzzy plugh frobnicate")
    assert (a, x) == (b, y)


def test_no_known_word(spark):
    assert best(spark, "é quux") == [(None, 0.0)]


def test_a_catalogue_in_parts(spark, monkeypatch):
    """Several passes over the texts give the same result as one."""
    texts = [*["show logs"] * 20, "stop everything", "é quux", "database", ""]
    expected = best(spark, *texts)
    monkeypatch.setattr(matching, "ENTRIES_PER_PASS", 3)
    assert best(spark, *texts) == expected


def test_route(spark):
    df = spark.createDataFrame([("a", 0.7), ("a", 0.69), (None, 0.0)], "entry string, confidence double")
    assert [r.source for r in matching.intent_route(df).collect()] == ["embeddings", "embeddings", "unmatched"]
    assert [r.source for r in matching.intent_route(df, second_opinion=True).collect()] == ["embeddings", "llm", "llm"]


def test_slots(spark):
    spec = spark.createDataFrame([("c", "service", "string"), ("c", "detached", "bool"), ("d", "removeVolumes", "bool")],
                                 "command string, param string, type string")
    rows = [("c", "JAEGER and Postgres in Background"), ("d", "run -d -v postgres"), ("c", "nothing"), (None, "postgres")]
    out = matching.extract_slots(spark.createDataFrame(rows, "entry string, text string"), spec).collect()
    assert {(r.entry, r.service, r.detached, r.remove_volumes) for r in out} == {
        ("c", "postgres", True, None), ("d", None, None, True), ("c", None, None, None), (None, None, None, None)}


@pytest.mark.parametrize("text,ns", [
    ("2m0s", 120 * 10**9), ("1h2m3.5s", 3723500000000), ("-1.5h", -5400 * 10**9), ("300ms", 300_000_000), (".5s", 500_000_000),
    ("0", 0), ("45", None), ("", None), ("1x", None), ("s", None), ("2µs", 2000), ("1.s", 10**9), (None, None)])
def test_durations(spark, text, ns):
    assert spark.createDataFrame([(text,)], "t string").select(duration_ns(F.col("t"))).first()[0] == ns


@pytest.mark.parametrize("kind,text,normal", [
    ("int", "7", "7"), ("int", "7.9", "7"), ("int", "-7.9", "-7"), ("int", "x", None), ("bool", "True", "true"), ("bool", "1", None),
    ("string", "", None), ("string", "a", "a"), ("[]string", '["a","b"]', '["a","b"]'), ("[]string", "[]", None),
    ("duration", "1s", "1000000000")])
def test_typed(spark, kind, text, normal):
    df = spark.createDataFrame([(kind, text)], "k string, t string")
    assert df.select(typed_text(F.col("k"), F.col("t"))).first()[0] == normal


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])],
                               "a array<float>, b array<float>")
    rows = df.select(F.round(cosine(F.col("a"), F.col("b")), 9)).collect()
    assert [r[0] for r in rows] == [0.0, 1.0, 0.0, 0.0]
    assert abs(df.select(l2(F.col("a"), F.col("b"))).first()[0] - math.sqrt(5)) < 1e-12


def test_validate(spark):
    rows = [(1, "db.query", "sql", "select 1"), (2, "db.query", None, None), (3, "infra.start", None, None),
            (4, "infra.start", "timeout", "5s"), (5, "infra.start", "timeout", "soon"), (6, "nope", "x", "1"),
            (7, "db.ping", None, None), (8, "db.query", "sql", "")]
    df = spark.createDataFrame(rows, "invocation_id int, command string, param string, param_value string")
    out = calls.validate_invocations(df, calls.parameter_spec(spark)).collect()
    got = {(r.invocation_id, r.param): (r.status, r.typed_value) for r in out}
    assert got[(1, "sql")] == ("given", "select 1") and got[(2, "sql")] == ("missing", None)
    assert got[(3, "timeout")] == ("default", "120000000000") and got[(4, "timeout")] == ("given", "5000000000")
    assert got[(5, "timeout")] == ("given", "120000000000")      # the wrong type gives the default
    assert got[(6, None)] == ("unknown_command", None) and got[(7, None)] == ("known", None)
    assert got[(8, "sql")] == ("given", None)                    # present, so not missing


def test_call_groups(spark):
    df = spark.createDataFrame([("db.query",), ("db.ping",), ("db.ping",), ("alone",)], "command string")
    assert {(r.command, r.calls, r.group_calls) for r in calls.call_groups(df).collect()} == {
        ("db.query", 1, 3), ("db.ping", 2, 3), ("alone", 1, 1)}


def test_a_vocabulary_that_is_joined(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "show logs logs of postgres"), (2, "unknown"), (3, None), (None, "logs")], "id int, text string")
    catalogue = spark.createDataFrame([("a", "show logs"), ("b", "postgres status")], "entry string, text string")
    rows = lambda: sorted((str(r.id), r.token, r.n, round(r.weight, 9)) for r in matching.term_vectors(texts, catalogue, "id").collect())
    expected = rows()
    monkeypatch.setattr(matching, "VOCABULARY", 2)
    assert rows() == expected and len(expected) == 4


def test_tokens_of_a_batch_are_counted_in_pieces():
    """Memory follows the tokens of a piece, not those of a batch; no row is lost or cut."""
    lists = [["a"] * n for n in (3, 0, 9, 1)] + [None] + [["b"]] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(lists, pa.list_(pa.string()))], names=["id", "tokens"])
    pieces = list(matching._pieces([batch.slice(0, 5), batch.slice(5), batch.slice(0, 0)], most=4))
    assert [p.column("id").to_pylist() for p in pieces] == [[0, 1], [2], [3, 4], [5, 6, 7, 8], [9, 10, 11]]


def test_token_counts_over_pieces(spark, monkeypatch):
    """Counts do not depend on where a batch is cut."""
    monkeypatch.setattr(matching._pieces, "__defaults__", (5,))
    texts = [(i, " ".join(f"w{(i * j) % 7}" for j in range(i % 13))) for i in range(100)] + [(100, None), (101, "")]
    df = spark.createDataFrame(texts, "id int, text string").coalesce(1)
    got = sorted((r.id, r.token, r.n) for r in matching.token_counts(df, "id").collect())
    assert got == sorted((i, w, t.split().count(w)) for i, t in texts if t for w in set(t.split()))
