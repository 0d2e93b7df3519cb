"""Growing files: every whole line once."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tracelode.sources import logs, tail
from tracelode.streaming.run import append_table


class Files:
    """Files below a folder, and a stream over them that goes on where it stopped."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options = spark, folder, options

    def put(self, name, *texts, mode="a", end="\n"):
        path = self.folder / "logs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        with open(path, mode, newline="") as file:
            file.write("".join(text + end for text in texts))
        return path

    def read(self):
        rows = tail.tail_lines(self.spark, f"{self.folder}/logs/*/*.log*", **self.options)
        append_table(rows, f"{self.folder}/out", f"{self.folder}/checkpoint", {"availableNow": True}).awaitTermination()
        found = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/out")
        return sorted((os.path.basename(os.path.dirname(r.file_path)), r.value) for r in found.collect())


@pytest.fixture
def files(spark, tmp_path):
    return Files(spark, tmp_path, part_bytes=16)


def test_appended_lines_come_once(files):
    files.put("a/x.log", "one", "two")
    assert files.read() == [("a", "one"), ("a", "two")]
    files.put("a/x.log", "three")
    files.put("b/x.log", "é" * 40, "")
    assert files.read() == [("a", "one"), ("a", "three"), ("a", "two"), ("b", ""), ("b", "é" * 40)]
    assert len(files.read()) == 5


def test_a_line_waits_for_its_end(files):
    files.put("a/x.log", "one", "ha", end="\n")
    files.put("a/x.log", "lf a li", end="")
    assert [v for _, v in files.read()] == ["ha", "one"]
    files.put("a/x.log", "ne", "last\r")
    assert [v for _, v in files.read()] == ["ha", "last", "lf a line", "one"]
    files.put("b/x.log", "never ends", end="")
    assert len(files.read()) == 4


def test_rotation(files):
    """What was written before the rename is read under the new name, the new file from its start."""
    path = files.put("a/x.log", "1", "2")
    files.read()
    files.put("a/x.log", "3")
    os.rename(path, f"{path}.1")
    files.put("a/x.log", "4", "5")
    assert [v for _, v in files.read()] == ["1", "2", "3", "4", "5"]
    files.put("a/x.log.1", "late")
    os.rename(path, f"{path}.2")
    assert [v for _, v in files.read()] == ["1", "2", "3", "4", "5", "late"]


def test_truncation(files):
    """Cut back and written anew: shorter, longer, with the same first line and another one."""
    files.put("a/x.log", "first", "second", "third")
    files.read()
    files.put("a/x.log", "new first", mode="w")
    assert ("a", "new first") in files.read()
    files.put("a/x.log", "other", *map(str, range(9)), mode="w")
    assert len(files.read()) == 3 + 1 + 10
    files.put("a/x.log", "other", "x", mode="w")
    found = [v for _, v in files.read()]
    assert found.count("other") == 2 and "x" in found and len(found) == 16


def test_parts_of_a_large_file_hold_every_line_once(spark, tmp_path):
    files = Files(spark, tmp_path, part_bytes=1000)
    lines = [f"{i} " + "x" * (i * 37 % 400) for i in range(500)]
    files.put("a/x.log", *lines)
    assert [v for _, v in files.read()] == sorted(lines)


def test_a_first_line_longer_than_the_head(files):
    files.put("a/x.log", "y" * 3000, end="")
    assert files.read() == []
    files.put("a/x.log", "z", "next")
    assert [len(v) for _, v in files.read()] == [4, 3001]


def test_empty_folder_and_removed_files(files):
    assert files.put("a/x.log").exists() and tail.whole_lines(str(files.folder / "logs/a/x.log")) == 0
    os.remove(files.put("b/x.log", "gone"))
    files.put("b/y.log", "stays")
    assert files.read() == [("b", "stays")]


def test_a_planned_file_that_was_renamed_is_found(spark, tmp_path):
    files = Files(spark, tmp_path)
    path = files.put("a/x.log", "one")
    reader = tail.TailReader({"path": f"{tmp_path}/logs/*/*.log*"})
    part, = reader.partitions({}, reader.latestOffset())
    os.rename(path, f"{path}.1")
    files.put("a/x.log", "another")
    assert [v for batch in reader.read(part) for v in batch.column("value").to_pylist()] == ["one"]
    os.remove(f"{path}.1")
    with pytest.raises(FileNotFoundError):
        list(reader.read(part))


def test_records_of_growing_files(spark, tmp_path):
    files = Files(spark, tmp_path)
    files.put("web/x.log", json.dumps({"log": "a\n", "stream": "stdout", "time": "2024-01-01T00:00:01.5Z"}), "no json")
    records = logs.log_tail_follow(spark, f"{tmp_path}/logs/*/*.log*")
    append_table(records, f"{tmp_path}/o", f"{tmp_path}/c", {"availableNow": True}).awaitTermination()
    found = spark.read.schema(records.schema).parquet(f"{tmp_path}/o").orderBy("line_start").collect()
    assert [(r.container_id, r.log, r.source) for r in found] == [("web", "a\n", "docker"), ("web", None, "docker")]
    assert str(found[0].ts) == "2024-01-01 00:00:01.500000"


def test_age_of_rotated_files(spark):
    paths = ["/l/c/app.log", "/l/c/app.log.2", "/l/c/app.log.10", "/l/c/app.log.3.gz", "/l/c/v1.2.log"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", logs.file_age(F.col("p")).alias("age")).orderBy("age")
    assert [r.p for r in df.collect()][:3] == ["/l/c/app.log.10", "/l/c/app.log.3.gz", "/l/c/app.log.2"]
