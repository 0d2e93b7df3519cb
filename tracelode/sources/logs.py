"""Container log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracelode.functions.once import with_once
from tracelode.sources.tail import tail_lines

LINE = "log string, stream string, time string"


def parse_time(text: Column) -> Column:
    """Time of a log line; the fraction may have any number of digits, a final Z is allowed."""
    return F.regexp_replace(text, "Z$", "").try_cast("timestamp_ntz").cast("timestamp")


def parse_container_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """JSON container lines to ``log``, ``stream`` and ``ts``; the original time text is kept."""
    parsed = with_once(df, "_l", F.from_json(F.col(line), LINE))
    return parsed.select(*[c for c in df.columns if c != line], F.col("_l.log").alias("log"),
                         F.col("_l.stream").alias("stream"), F.col("_l.time").alias("time"),
                         parse_time(F.col("_l.time")).alias("ts"))


# Columns that put the lines of a container in the order they were written. Closed files are ordered by the number that
# rotation gave them, the highest being the oldest and the file without one the newest. A followed file has no rank among
# the files of its container, as rotation renames it; there the time of a line comes first.
LINE_ORDER = ["file_age", "file_path", "block_start", "line_id"]
STREAM_ORDER = ["file_id", "line_start"]


def file_age(path: Column) -> Column:
    """Minus the number at the end of a rotated file's name (``app.log.3``), 0 for the open file."""
    # A failed cast costs an exception a row, so a path without a number is not cast at all.
    number = F.nullif(F.regexp_extract(path, r"\.([0-9]{1,9})(?:\.[a-z]+)?$", 1), F.lit(""))
    return -F.coalesce(number.cast("int"), F.lit(0))


def folder_name(path: Column) -> Column:
    """Name of the folder that a file is in. The anchor keeps the search from starting anew at every letter of a long path."""
    return F.regexp_extract(path, "(?s)^(?:.*/)?([^/]+)/[^/]+$", 1)


def _records(lines: DataFrame, columns: dict[str, Column]) -> DataFrame:
    named = {"container_id": folder_name(F.col("file_path")), **columns}
    return parse_container_lines(lines.withColumns(named)).withColumn("source", F.lit("docker"))


def log_tail_load(spark: SparkSession, path: str) -> DataFrame:
    """(I) Container log files (JSON per line) to records.

    The path may hold wildcards. Adds ``source``, the container (the file's folder) and the
    columns that order its lines.
    """
    lines = spark.read.text(path).withColumn("file_path", F.col("_metadata.file_path"))
    return _records(lines, {"file_age": file_age(F.col("file_path")), "block_start": F.col("_metadata.file_block_start"),
                            "line_id": F.monotonically_increasing_id()})


def log_tail_follow(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """(I) The same records as a stream over files that grow: lines appended later, rotated and cut back files included.

    See ``sources.tail`` for the rules and options.
    """
    return _records(tail_lines(spark, path, **options), {})
