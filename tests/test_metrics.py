from tracelode.operators import metrics
from tracelode.sources import metrics as texts


def lines(spark, payload):
    return texts.split_payload(spark.createDataFrame([(payload,)], "payload string"))


def test_line_count(spark):
    def count(payload):
        return metrics.metric_line_count(lines(spark, payload)).first().metric_lines
    assert count("# TYPE a gauge\na 1\n\n \nb 2") == 3     # a blank-only line counts, no final newline needed
    assert count("a 1\n") == 1
    assert count("x 1\n" * 5000) == 5000                   # the whole payload, however long


def test_exposition(spark):
    text = '# HELP a\na 1\nb{job="x",path="a\\"b"} 2.5e3 1700\n \n\nws:c NaN\nbroken'
    rows = {r.name: r for r in texts.exposition_load(lines(spark, text)).collect()}
    assert rows["a"].value == 1 and rows["a"].labels == {}
    assert rows["b"].value == 2500 and rows["b"].labels == {"job": "x", "path": 'a\\"b'}
    assert set(rows) == {"a", "b", "ws:c"}
    twice = texts.exposition_load(lines(spark, 'm{a="1",b="2",a="3"} 4')).first()
    assert twice.labels == {"a": "1", "b": "2"} and twice.value == 4


def test_query_result(spark):
    good = '{"status":"success","data":{"resultType":"vector","result":[{"metric":{"a":"b"},"value":[1.5,"2"]},{"metric":{},"value":[1,"x"]}]}}'
    df = spark.createDataFrame([(good,), ('{"status":"error"}',), ("{broken",), (None,)], "payload string")
    rows = [(r.labels, r.ts, r.value) for r in texts.metric_json_load(df).collect()]
    assert rows == [({"a": "b"}, 1.5, 2.0), ({}, 1.0, None)]


def test_labels(spark):
    df = spark.createDataFrame([({"job": "a", "x": "1"},), ({"job": "a"},), ({},)], "labels map<string,string>")
    assert metrics.match_labels(df, {"job": "a"}).count() == 2
    assert metrics.match_labels(df, {"job": "a", "x": "1"}).count() == 1
    assert metrics.match_labels(df, {}).count() == 3
