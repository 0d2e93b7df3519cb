import pytest
from pyspark.sql import functions as F

from tracelode.operators import checks, errors, graph, learning
from tracelode.plans import sql
from tracelode.sources import sinks


def levels(spark, edges, **kw):
    out = graph.dependency_levels(spark.createDataFrame(edges, "node string, dep string"), **kw)
    return {r.node: r.level for r in out.collect()}


def test_levels_of_a_stack(spark):
    edges = [("collector", "traces"), ("collector", "metrics"), ("agent", "collector"), ("agent", "metrics")]
    got = levels(spark, edges)
    assert got == {"traces": 0, "metrics": 0, "collector": 1, "agent": 2}
    assert all(got[n] > got[d] for n, d in edges)


def test_cycle_gets_one_last_level(spark):
    got = levels(spark, [("b", "a"), ("x", "y"), ("y", "x"), ("z", "x"), ("x", "b")])
    assert got == {"a": 0, "b": 1, "x": 2, "y": 2, "z": 2}


def test_long_chain(spark):
    chain = [(f"{i + 1}", f"{i}") for i in range(70)]
    assert levels(spark, chain) == {str(i): i for i in range(71)}
    assert levels(spark, chain[:9] + [("9", "3")]) == {str(i): i for i in range(10)}


def test_lone_nodes_have_a_level(spark):
    assert levels(spark, [("a", "b"), ("lone", None), ("b", None), (None, "x")]) == {"a": 1, "b": 0, "lone": 0}
    assert levels(spark, [("a", "b"), ("a", "c"), ("lone", None), ("c", "b")]) == {"a": 2, "b": 0, "c": 1, "lone": 0}
    assert levels(spark, [("x", "y"), ("y", "x"), ("lone", None)]) == {"lone": 0, "x": 1, "y": 1}
    assert levels(spark, []) == {}


def test_spans_delivered_twice(spark):
    rows = [("t", str(i), str(i - 1) if i else None) for i in range(8)] * 2
    got = graph.span_depth(spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string")).collect()
    assert sorted((int(r.span_id), r.depth) for r in got) == [(i, i) for i in range(8)]


def test_span_depth(spark):
    rows = [("t", str(i), str(i - 1) if i else None) for i in range(12)]
    rows += [("t", "x", "y"), ("t", "y", "x"), ("t", "z", "y"), ("t", "lost", "nowhere"), ("u", "1", "0")]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string")
    got = {(r.trace_id, r.span_id): r.depth for r in graph.span_depth(df).collect()}
    assert [got[("t", str(i))] for i in range(12)] == list(range(12))
    assert got[("t", "x")] is None and got[("t", "z")] is None
    assert got[("t", "lost")] == 0 and got[("u", "1")] == 0 and len(got) == len(rows)


def test_row_rules(spark):
    rows = [(1, 0, ["a"], [1.0, 2.0], "e"), (2, 6, ["a"], None, "e"), (3, 3, [], [1.0], None), (4, 5, ["b"], [1.0, 2.0], "e")]
    df = spark.createDataFrame(rows, "id int, difficulty int, concepts array<string>, v array<float>, email string")
    rules = [checks.in_range("difficulty", 1, 5), checks.not_empty("concepts"), checks.vector_length("v", 2), checks.not_null("email")]
    broken = checks.check_rows(df, ["id"], rules)
    assert {(r.id, r.rule) for r in broken.collect()} == {
        (1, "difficulty_range"), (2, "difficulty_range"), (3, "concepts_not_empty"), (3, "v_length"), (3, "email_not_null")}
    clean = df.join(broken, "id", "left_anti")
    assert checks.check_rows(clean, ["id"], rules).count() == 0


def test_repeated_keys(spark):
    df = spark.createDataFrame([("u", "a"), ("u", "a"), ("u", "b"), (None, "a")], "user_id string, concept string")
    assert [tuple(r) for r in checks.check_unique(df, ["user_id", "concept"]).collect()] == [("u", "a", 2)]


def test_pending_versions(spark):
    def pending(*names):
        files = spark.createDataFrame([(n,) for n in names], "file_name string")
        return [r.version for r in checks.pending_versions(files, spark.createDataFrame([(1,)], "version int")).collect()]
    assert pending("10_y.sql", "001_init.sql", "002_x.sql") == [2, 10]
    with pytest.raises(Exception, match="invalid file name: x.sql"):
        pending("002_x.sql", "x.sql")


def test_readiness(spark):
    rows = [(1, "2024-01-01 00:00:00", "a", "exited", "none"), (2, "2024-01-01 00:00:01", "a", "running", "none"),
            (3, "2024-01-01 00:00:00", "b", "running", "healthy")]
    df = spark.createDataFrame(rows, "event_id int, ts string, service string, state string, health string").withColumn("fleet", F.lit("f"))
    assert checks.service_readiness(df, ["fleet"], 2).first().ready
    assert not checks.service_readiness(df, ["fleet"], 3).first().ready
    starting = df.withColumn("health", F.lit("starting"))
    assert not checks.service_readiness(starting, ["fleet"], 2).first().ready


def test_report(spark):
    one = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 00:00:02",)], "t string").withColumn("t", F.to_timestamp("t"))
    good = checks.check("p", "a", one, F.count("*") == 2, F.min("t"), F.max("t"))
    bad = checks.check("q", "b", one, F.count("*") == 3, F.min("t"), F.max("t"))
    rows = {r.phase: r for r in checks.check_report(good, bad).collect()}
    assert rows["p"].success and not rows["q"].success and not rows["p"].run_success and rows["p"].duration_us == 2_000_000
    assert checks.check_report(good).first().run_success


def test_concept_filters(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, ["c"])], "id int, concepts array<string>")
    def ids(concepts, match):
        return [r.id for r in learning.filter_concepts(df, concepts, match).collect()]
    assert ids([], "all") == [1, 2, 3] and ids(["a", "b"], "all") == [1] and ids(["a", "b"], "any") == [1, 2]


@pytest.mark.parametrize("parts", [1, 6])
def test_context_size_of_one_huge_conversation(spark, parts):
    rows = [(1 if i % 3 else 2, i, "word " * (i % 7)) for i in range(120)]
    out = learning.context_size(spark.createDataFrame(rows, "conv_id int, turn int, text string"), parts).collect()
    for r in out:
        assert r.context_tokens == sum(i % 7 for c, i, _ in rows if c == r.conv_id and i <= r.turn)


def test_error_text(spark):
    df = spark.createDataFrame([("db.x", "m", "c"), ("db.x", "m", None), ("a.y", "m", None)], "code string, message string, cause string")
    assert sorted(r.error_text for r in errors.error_is(df, "db.x").collect()) == ["[db.x] m", "[db.x] m: c"]
    families = {(r.family, r.code): r.errors for r in errors.error_families(df).collect()}
    assert families == {("db", "db.x"): 2, ("db", None): 2, ("a", "a.y"): 1, ("a", None): 1, (None, None): 3}


def test_sql_with_arguments(spark):
    view = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    out = sql.sql_query(spark, "select name from things where id = :id", {"id": 2}, {"things": view})
    assert out.columns == ["name"] and [tuple(r) for r in out.collect()] == [("b",)]
    assert sql.rows_affected(out).first().rows_affected == 1


def test_signals_are_partitioned(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 10:00:00", 1), ("2024-01-02 10:00:00", 2)], "t string, v int").withColumn("ts", F.to_timestamp("t"))
    for _ in range(2):   # a rerun replaces
        sinks.write_signals({"logs": (df, "ts")}, str(tmp_path / "out"))
    back = sinks.read_signal(spark, str(tmp_path / "out"), "logs")
    assert back.count() == 2 and back.where("day = '2024-01-02'").first().v == 2
    assert "PartitionFilters: [isnotnull(day" in back.where("day = '2024-01-02'")._jdf.queryExecution().toString()


def test_a_run_that_is_stopped_leaves_the_old_state(spark, tmp_path):
    path = str(tmp_path / "out")
    make = lambda v: spark.createDataFrame([("2024-01-01 10:00:00", v)], "t string, v int").withColumn("ts", F.to_timestamp("t"))
    read = lambda name: sinks.read_signal(spark, path, name).first().v
    sinks.write_signals({"logs": (make(1), "ts"), "traces": (make(1), "ts")}, path)
    broken = make(2).withColumn("v", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_signals({"logs": (make(2), "ts"), "traces": (broken, "ts")}, path)
    assert (read("logs"), read("traces")) == (1, 1)
    sinks.write_signals({"logs": (make(3), "ts")}, path)
    assert (read("logs"), read("traces")) == (3, 1)
    for v in (4, 5, 6):
        sinks.write_signals({"logs": (make(v), "ts"), "traces": (make(v), "ts")}, path)
    assert (read("logs"), read("traces")) == (6, 6)
    assert len([f for f in (tmp_path / "out").iterdir() if f.name.startswith("run-")]) == 2
    with pytest.raises(FileNotFoundError):
        read("metrics")


def slow_levels(edges):
    nodes = {n for n, _ in edges} | {d for _, d in edges if d is not None}
    deps, level = {n: {d for m, d in edges if m == n and d is not None} for n in nodes}, {}
    while ready := [n for n in nodes - set(level) if all(d in level for d in deps[n])]:
        level |= {n: 1 + max((level[d] for d in deps[n]), default=-1) for n in ready}
    last = 1 + max(level.values(), default=-1)
    return {n: level.get(n, last) for n in nodes}


@pytest.mark.parametrize("seed", range(6))
def test_levels_of_random_graphs(spark, seed):
    """Chains, branches, reconvergence, cycles, repeated and lone rows."""
    import random
    rng = random.Random(seed)
    edges = [(i, rng.randrange(max(0, i - 6), i)) for i in range(1, 60) for _ in range(rng.choice([1, 1, 1, 2]))] + [(100, None), (5, 4), (5, 4)]
    if seed % 2:
        edges += [(70, 71), (71, 72), (72, 70), (73, 72), (73, 3), (74, 73)]
    if seed == 5:
        edges += [(0, 59)]
    out = graph.dependency_levels(spark.createDataFrame(edges, "node int, dep int")).collect()
    assert {r.node: r.level for r in out} == slow_levels(edges) and len(out) == len(slow_levels(edges))


def test_a_deep_chain_with_one_branch_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "written", lambda df, name, write=graph.written: rounds.append(name) or write(df, name))
    n = 10_000
    edges = spark.range(1, n).select(F.col("id").alias("node"), (F.col("id") - 1).alias("dep")).union(spark.createDataFrame([(n // 2, 17)], "node bigint, dep bigint"))
    out = graph.dependency_levels(edges)
    assert out.where("level <> node").isEmpty() and out.count() == n
    assert rounds.count("ready") <= 30 and rounds.count("links") <= 60


def test_rounds_move_what_they_place(spark, monkeypatch):
    """Without chains of links no edge is written anew; a round writes the open nodes, and of others only those it touches."""
    sizes = []

    def write(df, name, write=graph.written):
        out = write(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(graph, "written", write)
    n = 2000
    key = F.col("id")
    edges = spark.range(1, n + 1).select(key.alias("node"), F.explode(F.array(F.expr("id div 2"), F.expr("id div 3"))).alias("dep"))
    out = graph.dependency_levels(edges.select("node", F.when(F.col("dep") > 0, F.col("dep")).alias("dep"))).collect()
    assert {r.node: r.level for r in out} == {i: i.bit_length() - 1 for i in range(1, n + 1)}
    assert not {"links", "many", "open"} & {name for name, _ in sizes}
    assert sum(c for name, c in sizes if name == "ready") == n and sum(c for name, c in sizes if name in ("bases", "single")) <= 3 * n


def test_ladder_and_cycles_of_two_dependencies(spark):
    """Nodes that become links when their second dependency is placed are led on; with nothing to place all get one level."""
    ladder = [(i, d) for i in range(2, 40) for d in {i - 1, 0}] + [(1, 0)]
    assert levels(spark, [(str(a), str(b)) for a, b in ladder]) == {str(i): i for i in range(40)}
    assert levels(spark, [(a, b) for a in "xyz" for b in "xyz" if a != b]) == {"x": 0, "y": 0, "z": 0}


def test_depth_below_what_one_query_reaches(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHALLOW", 2)
    rows = [("t", i, i - 1 if i else None) for i in range(9)] + [("t", 20, 3), ("t", 30, 31), ("t", 31, 30), ("t", 32, 31), ("u", 1, 0), (None, 1, 0), (None, 2, 1)]
    out = graph.span_depth(spark.createDataFrame(rows, "trace_id string, span_id int, parent_span_id int")).collect()
    expected = {("t", i): i for i in range(9)} | {("t", 20): 4, ("t", 30): None, ("t", 31): None, ("t", 32): None, ("u", 1): 0, (None, 1): 0, (None, 2): 0}
    assert {(r.trace_id, r.span_id): r.depth for r in out} == expected and len(out) == len(expected)


@pytest.mark.parametrize("match", ["any", "all"])
def test_index_on_concepts(spark, tmp_path, match):
    rows = [(i, [f"c{j}" for j in range(7) if (i >> j) & 1]) for i in range(100)] + [(200, None), (201, ["c1", None, "c1"])]
    df = spark.createDataFrame(rows, "question_id bigint, concepts array<string>")
    postings = learning.write_postings(df, str(tmp_path / "p"), 8)
    for wanted in (["c1"], ["c1", "c4"], ["c0", "c1", "none"], ["c2", "c2"]):
        found = learning.filter_concepts_indexed(df, postings, wanted, match, 8)
        assert sorted(r.question_id for r in found.collect()) == sorted(r.question_id for r in learning.filter_concepts(df, wanted, match).collect())
    assert learning.filter_concepts_indexed(df, postings, [], match, 8).count() == 102
    plan = learning.posted_questions(postings, ["c1"], match, 8)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters: ")[1][:80]


def test_a_run_ends_at_its_first_failure(spark):
    good, bad = (spark.createDataFrame([(v,)], "ok boolean") for v in (True, False))
    make = lambda *frames: [tuple(r) for r in checks.in_turn(*[checks.step("p", str(i), f, F.bool_and("ok"), F.count("*").cast("string")) for i, f in enumerate(frames)]).orderBy("number").collect()]
    assert [r[3:5] + r[6:] for r in make(good, good)] == [(True, True, True), (True, True, True)]
    assert [r[3:5] + r[6:] for r in make(good, bad, good)] == [(True, True, False), (False, True, False), (True, False, False)]
    assert [r[3:5] + r[6:] for r in make(good.limit(0), good)] == [(False, True, False), (True, False, False)]


def test_mastery(spark):
    progress = spark.createDataFrame([(1, 10, True, 5), (1, 10, False, 1), (1, 11, False, 4), (2, 11, True, 2), (2, 99, True, 1)],
                                     "user_id int, question_id int, correct boolean, difficulty int")
    questions = spark.createDataFrame([(10, ["a", "b", "a"]), (11, ["b", None]), (12, None)], "question_id int, concepts array<string>")
    found = {(r.user_id, r.concept): (r.answers, round(r.mastery_score, 6)) for r in learning.concept_mastery(progress, questions).collect()}
    assert found == {(1, "a"): (2, round(5 / 6, 6)), (1, "b"): (3, 0.5), (2, "b"): (1, 1.0)}


def test_nearest_concepts(spark):
    concepts = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.0, 3.0])], "concept string, embedding array<double>")
    found = {(r.concept, r["rank"]): (r.near, r.distance) for r in learning.nearest_concepts(concepts, 2, 2).collect()}
    assert found == {("a", 1): ("b", 1.0), ("a", 2): ("c", 3.0), ("b", 1): ("a", 1.0), ("b", 2): ("c", 2.0), ("c", 1): ("b", 2.0), ("c", 2): ("a", 3.0)}


def test_slices_follow_the_size_of_rows(spark, monkeypatch, tmp_path):
    from tracelode.operators import ordered
    path = str(tmp_path / "t")
    spark.range(20_000).selectExpr("id", "uuid() as text").write.parquet(path)
    rows = spark.read.parquet(path)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ordered.slice_count(rows) == least
    monkeypatch.setattr(ordered, "SLICE_BYTES", 10_000)
    assert ordered.slice_count(rows) > 20 > least
