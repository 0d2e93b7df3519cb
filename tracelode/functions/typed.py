"""Text parameters read as the type their specification names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Duration units in nanoseconds.
UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000, "s": 1_000_000_000,
         "m": 60_000_000_000, "h": 3_600_000_000_000}
PART = r"([0-9]+\.?[0-9]*|\.[0-9]+)(ns|us|µs|μs|ms|s|m|h)"


def duration_ns(text: Column) -> Column:
    """Nanoseconds of a text such as ``1h2m3.5s``; null when it is no duration. A bare ``0`` is one."""
    numbers = F.regexp_extract_all(text, F.lit(PART), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(PART), F.lit(2))
    sizes = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    parts = F.zip_with(numbers, units, lambda n, u: F.floor(n.cast("decimal(28,9)") * sizes[u]).cast("bigint"))
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, b: a + b)
    sign = F.when(text.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    return (F.when(text.rlike(r"^[-+]?0$"), F.lit(0).cast("bigint"))
            .when(text.rlike(rf"^[-+]?({PART})+$"), total * sign))


def typed_text(kind: Column, value: Column) -> Column:
    """The value in the normal form of its type, as text; null when it does not fit.

    Numbers lose their fraction, durations become nanoseconds, a list keeps its text items.
    """
    number = F.when(value.rlike(r"^[-+]?[0-9]+$"), value.try_cast("bigint")).otherwise(
        value.try_cast("double").cast("bigint"))
    flag = F.lower(value)
    items = F.filter(F.from_json(value, "array<string>"), lambda i: i.isNotNull())
    return (
        F.when(kind == "int", number.cast("string"))
        .when(kind == "duration", duration_ns(value).cast("string"))
        .when(kind == "bool", F.when(flag.isin("true", "false"), flag))
        .when(kind == "[]string", F.when(F.size(items) > 0, F.to_json(items)))
        .otherwise(F.nullif(value, F.lit("")))
    )
