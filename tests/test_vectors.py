import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tracelode.operators import vectors


def frames(spark, rows=300, queries=7, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    v, q = rng.normal(size=(rows, dim)), rng.normal(size=(queries, dim))
    store = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(q)], "query_id bigint, query array<double>")
    return v, q, store, asked


def brute(v, q, k, metric):
    if metric == "l2":
        d = np.linalg.norm(q[:, None] - v[None], axis=2)
    else:
        d = 1 - (q @ v.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(v, axis=1)[None]
    return {(i, rank + 1): int(j) for i in range(len(q)) for rank, j in enumerate(np.argsort(d[i], kind="stable")[:k])}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("chunk", [1024, 3])
def test_exact(spark, monkeypatch, metric, chunk):
    """With one scan and in blocks, and batches far smaller than a task's rows."""
    for name, value in (("QUERIES_PER_SCAN", chunk), ("VECTOR_BLOCK", 100), ("QUERY_BLOCK", 4), ("STEP", 13)):
        monkeypatch.setattr(vectors, name, value)
    v, q, store, asked = frames(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = getattr(vectors, f"knn_{metric}")(store, asked, 5, 8).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.query_id, r["rank"]): r.vec_id for r in out} == brute(v, q, 5, metric)


def test_ties_nulls_and_wrong_lengths(spark):
    rows = [(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, 0.0, 5.0, 2.0]), (7, [-1.0, 0.0])]
    store = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0])], "query_id bigint, query array<double>")
    found = {}
    for r in vectors.knn_cosine(store, asked, 9, 2).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.distance))
    assert found[0] == [(1, 0.0), (2, 0.0), (3, 1.0), (4, 1.0), (6, 1.0), (7, 2.0)]
    assert found[1] == [(i, 1.0) for i in (1, 2, 3, 4, 6, 7)]
    assert vectors.knn_cosine(store, asked.limit(0), 3, 2).count() == 0
    with pytest.raises(Exception, match="must have 2 values"):
        vectors.knn_l2(store, asked.where("query_id = 0"), 3, 2).collect()
    with pytest.raises(Exception, match="must have 2 values"):
        vectors.assign_lists(store, np.zeros((1, 2))).collect()
    good = store.where("embedding is null or size(embedding) = 2")
    assert [r.vec_id for r in vectors.knn_l2(good, asked.where("query_id = 0"), 9, 2).orderBy("rank").collect()] == [1, 2, 4, 7]
    assert sorted(r.vec_id for r in vectors.assign_lists(good, np.zeros((1, 2))).collect()) == [1, 2, 4, 7]


def test_written_lists_are_pruned(spark, tmp_path):
    v, q, store, asked = frames(spark)
    listed = vectors.write_lists(store, v[:6], str(tmp_path / "lists"))
    out = vectors.knn_ivf(listed, asked.where("query_id = 0"), v[:6], 5, 2)
    plan = out._jdf.queryExecution().toString()
    assert "PartitionFilters: [list_id" in plan or "list_id#" in plan.split("PartitionFilters", 1)[1][:200]
    many = vectors.knn_ivf(listed, asked, v[:6], 5, 6)
    assert vectors.recall(many, vectors.knn_l2(store, asked, 5, 8)).first().recall == 1.0


def test_lists(spark):
    v, q, store, asked = frames(spark, rows=400)
    centres = vectors.train_lists(store, lists=10)
    listed = vectors.assign_lists(store, centres)
    assert listed.where("list_id is null or list_id not between 0 and 9").count() == 0
    exact = vectors.knn_l2(store, asked, 5, 8)
    assert vectors.recall(vectors.knn_ivf(listed, asked, centres, 5, 10), exact).first().recall == 1.0
    some = vectors.recall(vectors.knn_ivf(listed, asked, centres, 5, 4), exact).first().recall
    assert 0.3 < some <= 1.0


def test_split_lists_and_queries(spark, monkeypatch):
    """Blocks of lists and of queries far smaller than both give what whole lists give; one list holds most vectors."""
    v, q, store, asked = frames(spark, rows=300, queries=30)
    centres = np.vstack([np.zeros(8), np.eye(8)[:2] * 3])
    listed = vectors.assign_lists(store, centres)
    whole = sorted(map(tuple, vectors.knn_ivf(listed, asked, centres, 5, 2).collect()))
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 17)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    assert sorted(map(tuple, vectors.knn_ivf(listed, asked, centres, 5, 2).collect())) == whole and len(whole) == 150
    assert vectors.knn_ivf(listed, asked.limit(0), centres, 5, 2).count() == 0
    assert vectors.knn_ivf(listed.limit(0), asked, centres, 5, 2).count() == 0


def test_codes(spark, tmp_path):
    v, q, store, asked = frames(spark, rows=600, queries=20, dim=16)
    store = store.union(spark.createDataFrame([(10_000, None)], store.schema))
    centres, books = vectors.train_lists(store.where("embedding is not null"), lists=6), vectors.train_codes(store, 16, 8)
    assert books.shape == (8, 256, 2)
    listed = vectors.write_lists(store, centres, str(tmp_path / "vectors"))
    codes = vectors.write_codes(listed, books, str(tmp_path / "codes"))
    assert codes.count() == 600 and {len(r.code) for r in codes.collect()} == {8}
    exact = vectors.knn_l2(store, asked, 5, 16)
    # All compared: exact. A few: nearly.
    assert {(r.query_id, r["rank"]): r.vec_id for r in vectors.knn_ivf_codes(codes, listed, asked, centres, books, 5, 6, 600).collect()} == brute(v, q, 5, "l2")
    assert vectors.recall(vectors.knn_ivf_codes(codes, listed, asked, centres, books, 5, 6, 40), exact).first().recall >= 0.95
    with pytest.raises(ValueError):
        vectors.train_codes(store, 16, 5)
    with pytest.raises(ValueError):
        vectors.train_codes(store.limit(0), 16, 8)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_codes_find_nine_tenths(spark, sf):
    assert tuple(queries()["knn_ivf_recall"](spark, f"/root/testdata/{sf}").first()) == (True, True)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_of_rows_that_are_no_centres(spark, sf):
    assert queries()["knn_ivf_rows_recall"](spark, f"/root/testdata/{sf}").first().recall >= 0.9


def test_mean_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 3.0]), (0, [3.0, 5.0]), (1, [1.0, 1.0])], "label int, embedding array<float>")
    assert {r.label: r.query for r in vectors.mean_vectors(df, "label").collect()} == {0: [2.0, 4.0], 1: [1.0, 1.0]}


def test_documents_of_neighbours(spark):
    near = spark.createDataFrame([(0, 1, 7)], "query_id bigint, rank int, vec_id bigint")
    docs = spark.createDataFrame([(7, "text"), (8, "no")], "doc_id bigint, text string")
    assert [r.text for r in vectors.retrieve_documents(near, docs, "doc_id").collect()] == ["text"]
