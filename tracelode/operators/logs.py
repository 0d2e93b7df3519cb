"""Log records: enrichment, filters, scans, joins to traces."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tracelode.functions import severity
from tracelode.functions.once import with_once
from tracelode.operators.ordered import SLICE, slice_count
from tracelode.session import run_folder, small_batches

# Texts that mark a failing exporter. They look like patterns but are
# searched as plain text, so the second one matches only its literal spelling.
EXPORT_ERRORS = [
    "connection refused",
    "dial tcp.*failed",
    "TLS handshake",
    "authentication handshake failed",
    "no such host",
    "connection error",
    "Exporting failed",
    "failed to export",
    "error sending spans",
]


def detect_level(df: DataFrame, level: str = "level", log: str = "log") -> DataFrame:
    """(I) Adds ``severity_text`` and ``severity_number``."""
    named = with_once(df, "severity_text", severity.severity_text(F.col(level), F.col(log)))
    return named.withColumn("severity_number", severity.severity_number(F.col("severity_text")))


def merge_json_log(df: DataFrame, fields: list[str], log: str = "log") -> DataFrame:
    """(I) Fields of a JSON text in ``log`` join the record, the text stays.

    ``fields`` become columns (the parsed value wins over an existing one, our reading);
    all parsed pairs are kept in the map ``log_fields``. Other text leaves the row as it was.
    """
    looks_json = F.ltrim(F.col(log)).startswith("{")
    out = with_once(df, "log_fields", F.when(looks_json, F.from_json(F.col(log), "map<string,string>")))
    for field in fields:
        parsed = F.col("log_fields")[field]
        out = out.withColumn(field, F.coalesce(parsed, F.col(field)) if field in df.columns else parsed)
    return out


def extract_level_word(df: DataFrame, log: str = "log") -> DataFrame:
    """(I) First level word of the text as ``level_word``."""
    return df.withColumn("level_word", severity.level_word(F.col(log)))


def keep_severe(df: DataFrame) -> DataFrame:
    """(I) Rows whose severity text holds an error, warning or fatal word."""
    return df.where(F.col("severity_text").rlike(severity.SEVERE))


def drop_below_warn(df: DataFrame, least: int = 13) -> DataFrame:
    """(I) Drops severity numbers under WARN; a missing number counts as 0 (our reading)."""
    return df.where(F.coalesce(F.col("severity_number"), F.lit(0)) >= least)


def severity_band(df: DataFrame) -> DataFrame:
    """(I) Band name of the severity number."""
    return df.withColumn("severity_band", severity.severity_band(F.col("severity_number")))


def _with_default(df: DataFrame, name: str, default: Column) -> DataFrame:
    return df.withColumn(name, F.coalesce(F.col(name), default) if name in df.columns else default)


def modify_fields(df: DataFrame, environment: str = "development") -> DataFrame:
    """(I) ``container_name`` becomes ``service_name``, ``environment`` is added; existing values win."""
    named = _with_default(df, "service_name", F.col("container_name")).drop("container_name")
    return _with_default(named, "environment", F.lit(environment))


def log_transform(df: DataFrame, unknown: str = "unknown-service") -> DataFrame:
    """(I) Service name, operation and body of a log record; an operation it has is kept."""
    given = [F.col(c) for c in ("service_name", "container_name") if c in df.columns]
    out = df.withColumn("service_name", F.coalesce(*given, F.lit(unknown)))
    out = _with_default(out, "operation", F.coalesce(F.concat(F.lit("log."), F.col("severity_text")), F.lit("log.unknown")))
    return _with_default(out, "body", F.col("log"))


def tag_for_trace_ui(df: DataFrame, environment: str = "development") -> DataFrame:
    """(I) Copies service and operation to the tags of the trace UI; sets the environment always."""
    return df.withColumns({
        "jaeger_service": F.col("service_name"),
        "jaeger_operation": F.col("operation"),
        "environment": F.lit(environment),
    })


def drop_long_lines(df: DataFrame, limit: int, log: str = "log") -> DataFrame:
    """(I) Drops lines longer than ``limit`` bytes; a row without text is kept."""
    return df.where(F.coalesce(F.octet_length(log), F.lit(0)) <= limit)


def union_receivers(*receivers: DataFrame) -> DataFrame:
    """(I) Logs of several receivers as one frame; a column one of them lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), receivers)


def severe_logs(df: DataFrame) -> DataFrame:
    """(I) The whole way of a record: parse, level, filter, names, transform, filter, tags."""
    return (
        df.transform(merge_json_log, ["level", "msg"])
        .transform(detect_level)
        .transform(keep_severe)
        .transform(modify_fields)
        .transform(log_transform)
        .transform(drop_below_warn)
        .transform(tag_for_trace_ui)
    )


def error_pattern_scan(df: DataFrame, order: list[str], patterns: list[str] = EXPORT_ERRORS,
                       log: str = "log") -> DataFrame:
    """(I) Per pattern the first line holding it (any letter case) and the number of lines.

    One pass with one partial aggregate per pattern; no join, nothing but one row per
    pattern and partition is shuffled. Patterns without a line are left out.
    """
    body = F.lower(F.col(log))
    hits = [body.contains(p.lower()) for p in patterns]
    first = [F.min(F.when(hit, F.struct(*order, F.col(log).alias("_line")))) for hit in hits]
    count = [F.count_if(hit) for hit in hits]
    one = df.agg(F.array(*[
        F.struct(F.lit(p).alias("pattern"), f["_line"].alias("first_line"), n.alias("n_lines"))
        for p, f, n in zip(patterns, first, count)
    ]).alias("found"))
    return one.select(F.inline("found")).where("n_lines > 0")


#: Patterns of one automaton. More are searched by as many scans as it takes.
PATTERNS_PER_SCAN = 100_000


def pattern_table_scan(df: DataFrame, patterns: DataFrame, order: list[str], log: str = "log") -> DataFrame:
    """(I) The scan of ``error_pattern_scan`` for a table of patterns (column ``pattern``): pattern, first_line, n_lines.

    Patterns are made an automaton once, which finds all of them in one pass over a line, so a line costs as much for ten
    thousand as for ten. What leaves a batch is one row per pattern found in it: its count and its first line. Patterns
    without a line, empty and null ones are left out; two that differ in letter case alone are found alike.
    """
    spark = df.sparkSession
    wanted = patterns.select(F.col("pattern").cast("string").alias("pattern"), F.lower("pattern").alias("text")).where("text <> ''").distinct()
    count = max(1, math.ceil(wanted.count() / PATTERNS_PER_SCAN))
    lines = df.select(*order, F.col(log).alias("_line"), F.lower(F.col(log)).alias("_low")).where("_line is not null")
    kinds = {f.name: f.dataType for f in lines.schema}
    found_schema = T.StructType([T.StructField("_p", T.LongType()), T.StructField("_n", T.LongType()), *[T.StructField(c, kinds[c]) for c in (*order, "_line")]])
    keys = [(c, "ascending") for c in order]
    scans = []
    for number in range(count):
        part = wanted.where(F.pmod(F.xxhash64("text"), F.lit(count)) == number)
        texts = sorted({r.text for r in part.select("text").collect()})
        shared = spark.sparkContext.broadcast(texts)

        def scan(batches, shared=shared):
            import ahocorasick

            finder = ahocorasick.Automaton()
            for i, text in enumerate(shared.value):
                finder.add_word(text, i)
            if not shared.value:
                return
            finder.make_automaton()
            for batch in batches:
                # Rows in order: the first hit of a pattern is its first line.
                batch = batch.take(pc.sort_indices(batch.select([*order, "_line"]), sort_keys=[*keys, ("_line", "ascending")], null_placement="at_start"))
                first, total = {}, {}
                for row, text in enumerate(batch.column("_low").to_pylist()):
                    for i in {i for _, i in finder.iter(text)}:
                        first.setdefault(i, row)
                        total[i] = total.get(i, 0) + 1
                rows = batch.select([*order, "_line"]).take(pa.array([first[i] for i in total], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64()), *rows.columns],
                                                 names=["_p", "_n", *order, "_line"])

        hits = lines.mapInArrow(scan, found_schema).groupBy("_p").agg(F.sum("_n").alias("n_lines"), F.min(F.struct(*order, "_line")).alias("_first"))
        names = spark.createDataFrame(list(enumerate(texts)), "_p bigint, text string")
        scans.append(hits.join(names, "_p").select("text", "n_lines", F.col("_first._line").alias("first_line")))
    return reduce(DataFrame.unionByName, scans).join(wanted, "text").select("pattern", "first_line", "n_lines")


def receiver_seen(df: DataFrame, log: str = "log") -> DataFrame:
    """(I) Whether a line names the receiver, all upper or all lower case."""
    named = F.col(log).contains("OTLP") | F.col(log).contains("otlp")
    return df.agg(F.coalesce(F.bool_or(named), F.lit(False)).alias("seen"))


def _differs(column: pa.Array) -> np.ndarray:
    """Of every value but the first, whether it is another one than the value before; nulls are equal, and so are NaNs."""
    now, then = column.slice(1), column.slice(0, len(column) - 1)
    same = pc.or_(pc.fill_null(pc.equal(now, then), False), pc.and_(pc.is_null(now), pc.is_null(then)))
    if pa.types.is_floating(column.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(now), pc.is_nan(then)), False))
    return ~same.to_numpy(zero_copy_only=False)


def _micros(column: pa.Array, missing: int) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), missing).to_numpy(zero_copy_only=False)


def _times(micros: np.ndarray, missing: int, kind: pa.DataType) -> pa.Array:
    return pa.array(micros, pa.int64(), mask=micros == missing).cast(kind)


_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _folded(lines: pa.RecordBatch, begins: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of groups of rows that begin at `begins`: the texts joined, the least start, the greatest time."""
    offsets = pa.array(np.append(begins, len(lines)), pa.int32())
    texts = pc.binary_join(pa.ListArray.from_arrays(offsets, pc.fill_null(lines.column("log"), "")), "")
    return (texts, np.minimum.reduceat(_micros(lines.column("_started"), _MOST), begins),
            np.maximum.reduceat(_micros(lines.column("ts"), _LEAST), begins))


def _line_joiner(keys: list[str], flush_seconds: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Joins the ordered rows of a slice, batch by batch; holds one batch and the one line that is open at its end.

    Only the first line of a slice can go on with one of an earlier slice, and only the last one can go on in a later slice.
    They carry 0 and 1 in ``_edge`` (0 if there is but one), with the times of their first and last row and whether that ended
    the line. ``_more`` tells that another line of the same key follows in this slice.
    """
    def rows(head: pa.RecordBatch, begins, texts, started, ended_at, more, edge=None, first=None, last=None, ended=None) -> pa.RecordBatch:
        at, n, kind = pa.array(begins, pa.int64()), len(begins), head.schema.field("ts").type
        time = lambda v: pa.nulls(n, kind) if v is None else v
        columns = {**{k: head.column(k).take(at) for k in (*keys, SLICE)}, "_started": _times(started, _MOST, kind), "ts": _times(ended_at, _LEAST, kind),
                   "log": texts, "_more": pa.array(more, pa.bool_()), "_edge": pa.array([edge] * n, pa.int32()),
                   "_first": time(first), "_last": time(last), "_ended": pa.array([ended] * n, pa.bool_())}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = last = None
        texts, started, until, edge = [], _MOST, _LEAST, 0

        def close(edge: int | None, more: bool) -> pa.RecordBatch:
            return rows(head, [0], pa.array(["".join(texts)], pa.string()), np.array([started]), np.array([until]), [more], edge,
                        head.column("ts"), last.column("ts"), bool(pc.fill_null(pc.ends_with(last.column("log"), "\n"), False)[0].as_py()))

        for batch in batches:
            if not len(batch):
                continue
            both = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            other = np.zeros(len(both) - 1, bool)
            for key in keys:
                other |= _differs(both.column(key))
            time, timed = _micros(both.column("ts"), 0), pc.is_valid(both.column("ts")).to_numpy(zero_copy_only=False)
            late = timed[1:] & timed[:-1] & (time[1:] > time[:-1] + flush_seconds * 1_000_000)
            ended = pc.fill_null(pc.ends_with(both.column("log"), "\n"), False).to_numpy(zero_copy_only=False)
            starts = other | late | ended[:-1]
            if last is None:
                # The first row goes on with the open line, which is the empty one, so that the first line is kept apart.
                head, starts, other = batch.slice(0, 1), np.append(False, starts), np.append(False, other)
            begins = np.flatnonzero(starts)
            upto = int(begins[0]) if len(begins) else len(batch)
            if upto:
                text, low, high = _folded(batch.slice(0, upto), np.array([0]))
                texts.append(text[0].as_py())
                started, until, last = min(started, int(low[0])), max(until, int(high[0])), batch.slice(upto - 1, 1)
            if len(begins):
                yield close(edge, not other[upto])
                text, low, high = _folded(batch.slice(upto), begins - upto)
                if len(begins) > 1:
                    yield rows(batch, begins[:-1], text.slice(0, len(begins) - 1), low[:-1], high[:-1], ~other[begins[1:]])
                head, texts, started, until, edge = batch.slice(int(begins[-1]), 1), [text[-1].as_py()], int(low[-1]), int(high[-1]), None
            last = batch.slice(len(batch) - 1, 1)
        if last is not None:
            yield close(0 if edge == 0 else 1, False)

    return join


def joined_parts(df: DataFrame, keys: list[str], order: list[str], flush_seconds: int, folder: str, parts: int | None = None) -> DataFrame:
    """(I) Lines put together of their parts: (keys, _started, ts, log, final); see ``reassemble`` for the rule.

    Rows have keys, order, ``_started``, ``ts`` and ``log``. They are sorted into slices of (keys, order) by one shuffle, and one
    pass joins what lies within a slice. Written to `folder` are whole lines and at most two a slice that may
    go on beyond it; those alone are put together in a second step. ``final`` marks the last line of a key.
    """
    small_batches(df.sparkSession)
    columns = [*keys, "_started", "ts", "log"]
    cut = df.select(*keys, *order, "_started", "ts", "log").repartitionByRange(parts or slice_count(df), *keys, *order)
    # Rows of one place stand in the order of their texts, as in a sorted list of them.
    cut = cut.sortWithinPartitions(*keys, *order, "log").select(*columns, F.spark_partition_id().alias(SLICE))
    kinds = {f.name: f.dataType for f in cut.schema}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in (*keys, SLICE, "_started", "ts", "log")] + [
        T.StructField("_more", T.BooleanType()), T.StructField("_edge", T.IntegerType()), T.StructField("_first", kinds["ts"]),
        T.StructField("_last", kinds["ts"]), T.StructField("_ended", T.BooleanType())])
    # Both readers must see the same cut, of which the bounds are sampled.
    cut.mapInArrow(_line_joiner(keys, flush_seconds), schema).write.mode("overwrite").parquet(folder)
    made = df.sparkSession.read.schema(schema).parquet(folder)
    whole = made.where("_edge is null").select(*columns, (~F.col("_more")).alias("final"))
    ordered = Window.partitionBy(*keys).orderBy(SLICE, "_edge")
    edges = made.where("_edge is not null").withColumn("_before", F.lag(F.struct("_ended", "_last")).over(ordered))
    late = F.col("_first") > F.timestamp_add("SECOND", F.lit(flush_seconds), F.col("_before._last"))
    starts = F.coalesce((F.col("_edge") == 1) | F.col("_before").isNull() | F.col("_before._ended") | late, F.lit(False))
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    numbered = edges.withColumn("_line", F.sum(starts.cast("int")).over(upto)).withColumn("_lines", F.max("_line").over(Window.partitionBy(*keys)))
    pieces = F.sort_array(F.collect_list(F.struct(SLICE, "_edge", "log")))
    over = numbered.groupBy(*keys, "_line").agg(F.min("_started").alias("_started"), F.max("ts").alias("ts"), pieces.alias("_pieces"),
                                                ((F.max("_lines") == F.col("_line")) & ~F.bool_or("_more")).alias("final"))
    return whole.unionByName(over.select(*keys, "_started", "ts", F.array_join(F.transform("_pieces", lambda p: p["log"]), "").alias("log"), "final"))


def reassemble(df: DataFrame, keys: list[str], order: list[str], flush_seconds: int = 5, log: str = "log",
               parts: int | None = None) -> DataFrame:
    """(I) Joins lines that the container runtime split: (keys, ts, log), one row per line.

    A part without a final newline is continued by the next line of the container, unless
    that comes more than ``flush_seconds`` later (our reading of the flush time). A null text
    is an empty part, a part without a time is never late.
    """
    lines = df.select(*keys, *order, F.col("ts"), F.col(log).alias("log"), F.col("ts").alias("_started"))
    joined = joined_parts(lines, keys, order, flush_seconds, run_folder(df.sparkSession, "joined-lines"), parts)
    return joined.select(*keys, F.col("_started").alias("ts"), "log")


def log_tail(df: DataFrame, keys: list[str], order: list[str], lines: int = 100) -> DataFrame:
    """(I) The last ``lines`` rows per key. The rank filter prunes before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= lines)


#: Spans up to this many microseconds (as a power of two) share one level.
LEAST_LEVEL = 20


def _cell(micros: Column, level: Column) -> Column:
    return F.floor(micros / F.pow(F.lit(2.0), level)).cast("bigint")


def log_trace_join(logs: DataFrame, spans: DataFrame, key: list[str], log_time: str = "ts") -> DataFrame:
    """(D) Log rows (unique by ``key``) with the span they were written in.

    A row that names its span joins by trace and span id, if written while it ran. A row
    with a trace id only gets the innermost span that ran then: the last to start, of those
    the shortest, then by id. For that, time is cut into cells of 2^level microseconds, and a span lies in the cells of the
    least level at which a cell is as long as it: two rows at most, however long it ran. A log row looks into the one cell
    that it lies in of every level that spans have, of which there are at most 64.
    """
    end = F.timestamp_add("MICROSECOND", F.col("duration_us"), F.col("start_ts"))
    wide = spans.select("trace_id", F.col("span_id").alias("_span"), "operation", "start_ts", "duration_us", end.alias("_end"))
    inside = F.col(log_time).between(F.col("start_ts"), F.col("_end"))
    named = logs.where("span_id is not null").join(wide, (logs["trace_id"] == wide["trace_id"]) & (F.col("span_id") == F.col("_span"))).where(inside)
    named = named.drop(wide["trace_id"]).drop("_span", "start_ts", "duration_us", "_end")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    level = F.greatest(F.lit(LEAST_LEVEL), F.ceil(F.log2(F.col("duration_us") + 1.0))).cast("int")
    levelled = wide.where("duration_us >= 0").withColumn("_level", level)
    levels = sorted(r._level for r in levelled.select("_level").distinct().collect())
    cells = levelled.withColumn("_cell", F.explode(F.sequence(_cell(micros("start_ts"), F.col("_level")), _cell(micros("_end"), F.col("_level")))))
    rest = logs.where("span_id is null and trace_id is not null")
    asked = rest.withColumn("_level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    asked = asked.withColumn("_cell", _cell(micros(log_time), F.col("_level")))
    candidates = asked.join(cells, ["trace_id", "_level", "_cell"]).where(inside)
    order = F.struct(F.unix_micros(F.col("start_ts").cast("timestamp")) * -1, "duration_us", "_span")
    innermost = candidates.groupBy(*key).agg(F.min_by(F.struct("_span", "operation"), order).alias("_s"))
    found = rest.drop("span_id").join(innermost, key).select(
        *[F.col("_s._span").alias("span_id") if c == "span_id" else F.col(c) for c in logs.columns], F.col("_s.operation").alias("operation"))
    return named.select(*logs.columns, "operation").unionByName(found)
