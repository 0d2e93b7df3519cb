"""Tool calls: validation against the parameter specification, counts per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracelode.functions.typed import typed_text
from tracelode.operators.matching import COMMANDS

# Parameters (command, name, type, required, default).
PARAMETERS = [
    ("db.query", "sql", "string", True, None),
    ("infra.start", "timeout", "duration", False, "2m0s"),
    ("infra.logs", "service", "string", False, None),
    ("obs.metrics", "query", "string", False, None),
    ("lint.check", "path", "string", False, "./..."),
    ("fmt.check", "path", "string", False, "."),
    ("fmt.fix", "path", "string", False, "."),
]
SPEC = "command string, param string, type string, required boolean, default_value string"


def parameter_spec(spark: SparkSession) -> DataFrame:
    """The fixed parameters, and a row without parameter for each command."""
    return spark.createDataFrame([(name, None, None, False, None) for name, _, _ in COMMANDS] + PARAMETERS, SPEC)


def validate_invocations(calls: DataFrame, spec: DataFrame) -> DataFrame:
    """(I) Calls against the specification, one row per call and parameter.

    ``calls`` is long: (invocation_id, command, param, param_value), ``param`` null for a
    call without parameters. A default fills only an absent key. ``status`` is ``given``,
    ``default``, ``missing`` (required and absent) or, on the row without parameter,
    ``known`` / ``unknown_command``. ``typed_value`` is the value in the normal form of its
    type; a value of the wrong type gives the default.

    Given and expected parameters are stacked and grouped once, so there is one shuffle and
    no list is collected per call.
    """
    key = ["invocation_id", "command", "param"]
    given = calls.where("param is not null").select(*key, "param_value", F.lit(True).alias("is_given"))
    # The specification is a literal list of this size, so the hint is bounded.
    expected = calls.select("invocation_id", "command").join(
        F.broadcast(spec.withColumn("is_known", F.lit(True))), "command", "left")
    stacked = given.unionByName(expected, allowMissingColumns=True)
    merged = stacked.groupBy(*key).agg(
        F.max("param_value").alias("param_value"), F.bool_or("is_given").alias("is_given"),
        F.max("type").alias("type"), F.bool_or("required").alias("required"),
        F.max("default_value").alias("default_value"), F.bool_or("is_known").alias("is_known"))
    status = (
        F.when(F.col("param").isNull(), F.when(F.col("is_known"), "known").otherwise("unknown_command"))
        .when(F.col("is_given"), "given")
        .when(F.col("default_value").isNotNull(), "default")
        .when(F.col("required"), "missing")
    )
    kind = F.coalesce("type", F.lit("string"))
    value = F.when(F.col("is_given"), F.col("param_value")).otherwise(F.col("default_value"))
    typed = F.coalesce(typed_text(kind, value), typed_text(kind, F.col("default_value")))
    return merged.select(*key, status.alias("status"), value.alias("value"), typed.alias("typed_value")).where(
        "status is not null")


def call_groups(calls: DataFrame) -> DataFrame:
    """(D) Calls per command and per group (the name before the dot)."""
    per_command = calls.groupBy("command").agg(F.count("*").alias("calls"))
    group = F.split_part("command", F.lit("."), F.lit(1))
    grouped = per_command.withColumn("command_group", group)
    return grouped.withColumn("group_calls", F.sum("calls").over(Window.partitionBy("command_group")))
