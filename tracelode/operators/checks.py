"""Checks that the table definitions ask for, the batch ledger, and reports of checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def not_null(column: str) -> tuple[str, Column]:
    return f"{column}_not_null", F.col(column).isNull()


def in_range(column: str, low: int, high: int) -> tuple[str, Column]:
    return f"{column}_range", ~F.col(column).between(low, high)


def not_empty(column: str) -> tuple[str, Column]:
    return f"{column}_not_empty", F.size(column) == 0


def vector_length(column: str, length: int) -> tuple[str, Column]:
    """A missing vector is allowed."""
    return f"{column}_length", F.size(column) != length


def check_rows(df: DataFrame, key: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """(S) One row per broken rule and row, in a single pass."""
    broken = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules])
    return df.select(*key, F.explode(F.filter(broken, lambda b: b.isNotNull())).alias("rule"))


def check_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """(S) Keys that are present more than once, with their number of rows."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def apply_defaults(df: DataFrame, columns: list[str], run_time: Column) -> DataFrame:
    """(S) Missing timestamps get the time of the run."""
    return df.withColumns({c: F.coalesce(F.col(c), run_time) for c in columns})


def pending_versions(files: DataFrame, ledger: DataFrame, name: str = "file_name", suffix: str = "sql") -> DataFrame:
    """(I) Numbered input files not in the ledger, lowest number first. A bad name is an error."""
    pattern = rf"^(\d+)_?.*\.{suffix}$"
    number = F.regexp_extract(name, pattern, 1)
    bad = F.raise_error(F.concat(F.lit("invalid file name: "), name))
    version = F.when(number == "", bad.cast("bigint")).otherwise(number.cast("bigint"))
    numbered = files.withColumn("version", version)
    return numbered.join(ledger.select("version"), "version", "left_anti").orderBy("version")


def service_readiness(snapshots: DataFrame, fleet: list[str], expected: int) -> DataFrame:
    """(I) Per fleet: newest state of each service; ready when all expected are running and well."""
    newest = F.max_by(F.struct("state", "health"), F.struct("ts", "event_id")).alias("now")
    now = snapshots.groupBy(*fleet, "service").agg(newest)
    flags = now.groupBy(*fleet).agg(
        F.count("*").alias("found"), F.bool_and(F.col("now.state") == "running").alias("all_running"),
        F.bool_and(F.col("now.health").isin("none", "healthy")).alias("all_healthy"))
    ready = F.col("all_running") & F.col("all_healthy") & (F.col("found") == expected)
    return flags.withColumn("ready", ready)


def check(phase: str, step: str, result: DataFrame, success: Column, started: Column, ended: Column) -> DataFrame:
    """One step of a report from a frame: a single aggregated row."""
    return result.agg(
        F.lit(phase).alias("phase"), F.lit(step).alias("step"), F.coalesce(success, F.lit(False)).alias("success"),
        started.alias("started"), ended.alias("ended"))


def check_report(*checks: DataFrame) -> DataFrame:
    """(I) Steps of a run by phase: number, passed, success, duration, and success of the whole run.

    Success and durations are computed here, from the steps.
    """
    steps = reduce(DataFrame.unionByName, checks)
    phases = steps.groupBy("phase").agg(
        F.count("*").alias("steps"), F.count_if("success").alias("passed"), F.bool_and("success").alias("success"),
        F.timestamp_diff("MICROSECOND", F.min("started"), F.max("ended")).alias("duration_us"),
        F.sort_array(F.collect_list(F.struct("step", "success"))).alias("results"))
    whole = phases.agg(F.bool_and("success").alias("run_success"))
    return phases.withColumn("run_success", whole.scalar())


STEP = "phase string, step string, success boolean, detail string"


def step(phase: str, name: str, result: DataFrame, success: Column, detail: Column) -> DataFrame:
    """One step of a verification from a frame: a single row, failed if the frame is empty."""
    return result.agg(F.lit(phase).alias("phase"), F.lit(name).alias("step"), F.coalesce(success, F.lit(False)).alias("success"), detail.alias("detail"))


def in_turn(*steps: DataFrame) -> DataFrame:
    """(I) Steps of one verification, in the order given: number, phase, step, success, whether the run reached it, detail, and the
    success of the run. A run ends at the first step that fails; later ones count as not reached, whatever they would say."""
    numbered = reduce(DataFrame.unionByName, [s.withColumn("number", F.lit(i)) for i, s in enumerate(steps)])
    first = numbered.where(~F.col("success")).agg(F.coalesce(F.min("number"), F.lit(len(steps))).alias("n"))
    ends = first.scalar()
    return numbered.select("number", "phase", "step", "success", (F.col("number") <= ends).alias("reached"), "detail", (ends == len(steps)).alias("run_success"))


def verify_run(readiness: DataFrame, found: DataFrame, series: DataFrame, snapshot: DataFrame, lines: DataFrame, patterns: DataFrame) -> DataFrame:
    """(I) A whole verification: the fleet is ready, every id set's trace is there and whole, the metric has a series, the
    snapshot of event counters is not empty, and no log line says that an export failed.

    Takes the results of ``service_readiness``, ``trace_check``, ``series_up``, ``events.stats_snapshot`` and
    ``logs.error_pattern_scan``, and the log lines themselves, of which there must be one.
    """
    text = lambda *parts: F.concat_ws(" ", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    named = F.col("event_name").isNotNull()
    return in_turn(
        step("infrastructure", "services are ready", readiness, F.bool_and("ready"), text(F.count_if("ready"), "of", F.count("*"), "ready")),
        step("data flow", "traces are whole", found, F.bool_and("success"), text(F.count_if("success"), "of", F.count("*"), "id sets")),
        step("data flow", "metric is up", series, F.bool_and("success"), text(F.sum("series"), "series")),
        step("data flow", "snapshot is not empty", snapshot, F.count_if(named) > 0,
             text("active", F.coalesce(F.max("active"), F.lit(0)), "total", F.coalesce(F.max("total"), F.lit(0)), "events", F.count_if(named))),
        step("logs", "lines are there", lines, F.count("*") > 0, text(F.count("*"), "lines")),
        step("logs", "no export failed", patterns, F.count("*") == 0, text(F.coalesce(F.sum("n_lines"), F.lit(0)), "lines")),
    )
