"""Running values over ordered groups of any size.

A window partitioned by the group key sends a whole group to one task. Here rows are
range-partitioned by key *and* order, so a large group is cut into slices over many
tasks, and what one slice owes to the earlier ones is carried over. A slice can only
continue the one group that is open at its start, so there is at most one carried row
per slice: the carried table is bounded by the partition count and safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracelode.session import cut_lineage

SLICE = "_slice"


#: Bytes of a slice, about, by what the optimizer expects of the rows.
SLICE_BYTES = 128 << 20


def slice_count(df: DataFrame) -> int:
    """Slices for a frame: as many as shuffles have partitions, more if the rows are expected to be large."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Frames of unknown size are expected to be larger than anything there is.
    return least if expected >= 1 << 60 else max(least, -(-expected // SLICE_BYTES))


def slices(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Range partitions of (keys, order), numbered in order and frozen by a checkpoint.

    The checkpoint matters: slice numbers are read twice (rows and carried values) and
    range bounds are sampled, so both readers must see the same cut. Their number follows the size of the rows.
    """
    cut = df.repartitionByRange(parts or slice_count(df), *keys, *order)
    return cut_lineage(cut.withColumn(SLICE, F.spark_partition_id()))


def _carried(per_slice: DataFrame, keys: list[str], value: Column) -> DataFrame:
    carried = per_slice.select(SLICE, *keys, value.alias("_carry")).where(F.col("_carry").isNotNull())
    return carried.select(F.col(SLICE).alias("_s"), *[F.col(k).alias(f"_k_{k}") for k in keys], "_carry")


def _join_carried(df: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    same = F.col(SLICE) == F.col("_s")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return df.join(F.broadcast(carried), same, "left").drop("_s", *[f"_k_{k}" for k in keys])


def running_sum(sliced: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over all rows of the group up to and including this one."""
    here = Window.partitionBy(SLICE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(SLICE, *keys).agg(F.sum(value).alias("_total"))
    carried = _carried(totals, keys, F.sum("_total").over(earlier))
    out = _join_carried(sliced.withColumn(name, F.sum(value).over(here)), carried, keys)
    return out.withColumn(name, F.col(name) + F.coalesce(F.col("_carry"), F.lit(0))).drop("_carry")


def previous(sliced: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``value`` of the row before this one in its group; null on the first row."""
    boxed = F.struct(value.alias("v"))
    here = Window.partitionBy(SLICE, *keys).orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy(SLICE)
    last = sliced.groupBy(SLICE, *keys).agg(F.max_by(boxed, F.struct(*order)).alias("_last"))
    carried = _carried(last, keys, F.lag("_last").over(earlier))
    out = _join_carried(sliced.withColumn(name, F.lag(boxed).over(here)), carried, keys)
    return out.withColumn(name, F.coalesce(F.col(name), F.col("_carry"))["v"]).drop("_carry")


def previous_in_time(df: DataFrame, keys: list[str], time: str, tie: str, value: Column, name: str,
                     step: str = "hour") -> DataFrame:
    """As ``previous``, for data spread in time: slices are whole time steps, no checkpoint.

    One shuffle by (keys, step) for the rows; the carried values are aggregates per
    (keys, step) and join on the same partitioning.
    """
    rows = df.withColumn(SLICE, F.date_trunc(step, F.col(time)))
    boxed = F.struct(value.alias("v"))
    part = [SLICE, *keys]
    here = Window.partitionBy(*part).orderBy(time, tie)
    earlier = Window.partitionBy(*keys).orderBy(SLICE)
    last = rows.groupBy(*part).agg(F.max_by(boxed, F.struct(time, tie)).alias("_last"))
    carried = last.select(*part, F.lag("_last").over(earlier).alias("_carry"))
    out = rows.withColumn(name, F.lag(boxed).over(here)).join(carried, part, "left")
    return out.withColumn(name, F.coalesce(F.col(name), F.col("_carry"))["v"]).drop(SLICE, "_carry")
