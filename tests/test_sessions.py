import random
from datetime import datetime, timedelta

from tracelode.operators import sessions

START = datetime(2024, 1, 1)


def messages(spark, rows):
    """rows: (session, seconds, event)"""
    full = [(i, s, START + timedelta(seconds=t), e) for i, (s, t, e) in enumerate(rows)]
    return spark.createDataFrame(full, "event_id bigint, session_id string, ts timestamp_ntz, event string")


def test_deadline_edges(spark):
    a, r, u = sessions.ANSWER, sessions.RESULT, sessions.UPDATE
    df = messages(spark, [("on", 5, a), ("on", 13, r), ("on", 5, u), ("late", 5, a), ("late", 13.001, r), ("late", 4.9, u),
                          ("other", 6, r), ("none", 0, a)])
    got = {x.session_id: (x.result_in_time, x.update_in_time, x.status) for x in sessions.answer_deadline(df).collect()}
    assert got == {"on": (True, True, "complete"), "late": (False, False, "late_or_absent"), "none": (False, False, "late_or_absent")}


def test_deadline_against_brute_force(spark):
    rng = random.Random(4)
    kinds = [sessions.ANSWER, sessions.RESULT, sessions.UPDATE]
    rows = [(rng.choice(["hot", "hot", "b"]), rng.randrange(0, 400_000) / 1000, rng.choice(kinds)) for _ in range(300)]
    got = {x.answer_id: (x.result_in_time, x.update_in_time) for x in sessions.answer_deadline(messages(spark, rows)).collect()}
    for i, (s, t, e) in enumerate(rows):
        if e == sessions.ANSWER:
            def seen(kind):
                return any(s2 == s and e2 == kind and t <= t2 <= t + 8 for s2, t2, e2 in rows)
            assert got[i] == (seen(sessions.RESULT), seen(sessions.UPDATE))


def test_funnel(spark):
    full = [("full", i, e) for i, e in enumerate(sessions.STAGES)]
    df = messages(spark, [*full, ("swap", 0, "server.connected"), ("swap", 1, "client.connect"), ("none", 0, "kc.question")])
    got = {r.session_id: (r.stages_reached, r.first_missing) for r in sessions.session_funnel(df).collect()}
    assert got == {"full": (6, None), "swap": (1, "server.connected"), "none": (0, "client.connect")}


def test_funnel_takes_the_next_message_of_a_stage(spark):
    """An early question must not hide the one that follows the request."""
    events = ["client.connect", "server.connected", "kc.question", "kc.request.next", "kc.question", "kc.answer.submit", "kc.answer.result"]
    stages = ["client.connect", "server.connected", "kc.request.next", "kc.question", "kc.answer.submit", "kc.answer.result"]
    rows = [("s", datetime(2024, 1, 1, 0, 0, i), e) for i, e in enumerate(events)]
    rows += [("early", datetime(2024, 1, 1, 0, 0, i), e) for i, e in enumerate(events[:3] + events[3:4])]
    df = spark.createDataFrame(rows, "session_id string, ts timestamp, event string")
    got = {r.session_id: (r.stages_reached, r.first_missing) for r in sessions.session_funnel(df, stages).collect()}
    assert got == {"s": (6, None), "early": (3, "kc.question")}


def test_envelopes(spark):
    raw = ['{"event":"client.connect","data":{"token":"x"},"meta":{"timestamp":1700000000123,"user_id":"u"}}',
           '{"event":"nope","data":{},"meta":{}}', '{"event":"client.connect","data":3,"meta":{}}', '{"event":"client.conn', "",
           '{"event":"","data":{}}', None]
    df = spark.createDataFrame(list(enumerate(raw)), "id int, raw string")
    rows = sessions.parse_envelopes(df).orderBy("id").collect()
    assert [r.error_code for r in rows] == [None, "protocol.unknown_event", "protocol.invalid_payload", "protocol.invalid_envelope",
                                            "protocol.invalid_envelope", "protocol.invalid_envelope", "protocol.invalid_envelope"]
    assert rows[0].sent_at.microsecond == 123000 and rows[0].meta_user_id == "u" and rows[0].data == '{"token":"x"}'


def test_widgets(spark):
    raw = '{"widget":{"type":"mcq","id":"w","props":{"question_id":"q","question":"Why?","options":["a","b"]}},"difficulty":3,"concepts":["c"]}'
    row = sessions.parse_widgets(spark.createDataFrame([(raw,)], "payload string")).first()
    assert (row.widget_type, row.asked_id, row.question, row.first_option, row.difficulty, row.concepts) == ("mcq", "q", "Why?", "a", 3, ["c"])


def test_funnel_against_a_slow_walk(spark):
    """Hot sessions over many Arrow batches, equal times, null sessions and times, sessions of no stage."""
    import random
    rng, start = random.Random(2), datetime(2024, 1, 1)
    stages = sessions.STAGES
    rows = [(rng.choice(["hot", "hot", "hot", "b", "c", None]), start + timedelta(seconds=rng.randrange(60)) if rng.random() < 0.95 else None,
             rng.choice([*stages, "other"])) for _ in range(400)] + [("only", start, "other"), ("nothing", None, None)]
    expected = {}
    for session in {r[0] for r in rows}:
        own, at, n = [r for r in rows if r[0] == session and r[1] is not None], datetime.min, 0
        while n < len(stages) and (times := [t for _, t, e in own if e == stages[n] and t >= at]):
            at, n = min(times), n + 1
        expected[session] = (n, stages[n] if n < len(stages) else None)
    df = spark.createDataFrame(rows, "session_id string, ts timestamp, event string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = sessions.session_funnel(df).collect()
        assert sessions.session_funnel(df.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.session_id: (r.stages_reached, r.first_missing) for r in found} == expected and len(found) == len(expected)
