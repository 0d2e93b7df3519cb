"""Severity of log records as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Level field words, then words searched in the text, in test order.
FIELD_LEVELS = [
    ("ERROR", ["error", "err"]),
    ("WARN", ["warn", "warning"]),
    ("FATAL", ["fatal", "critical"]),
    ("INFO", ["info"]),
    ("DEBUG", ["debug", "trace"]),
]
TEXT_LEVELS = [
    ("ERROR", ["error", "exception", "failed", "failure", "panic"]),
    ("WARN", ["warn", "warning", "deprecated"]),
    ("FATAL", ["fatal", "critical"]),
]
NUMBERS = {"DEBUG": 5, "INFO": 9, "WARN": 13, "ERROR": 17, "FATAL": 21}
BANDS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
LEVEL_WORD = "(ERROR|WARN|WARNING|INFO|DEBUG|FATAL|error|warn|warning|info|debug|fatal)"
SEVERE = "(ERROR|WARN|WARNING|FATAL|error|warn|warning|fatal)"
LOGGER_LEVELS = {"debug": "debug", "info": "info", "warn": "warn", "warning": "warn", "error": "error"}


def severity_text(level: Column, text: Column) -> Column:
    """Level field first, then words in the text (ERROR before WARN before FATAL), else INFO."""
    field = F.lower(F.coalesce(level, F.lit("")))
    body = F.lower(F.coalesce(text, F.lit("")))
    tests = [(field.isin(words), name) for name, words in FIELD_LEVELS]
    tests += [(reduce(Column.__or__, [body.contains(w) for w in words]), name) for name, words in TEXT_LEVELS]
    return F.coalesce(*[F.when(test, name) for test, name in tests], F.lit("INFO"))


def severity_number(name: Column) -> Column:
    """Number of a severity name."""
    return F.coalesce(*[F.when(name == text, F.lit(number)) for text, number in NUMBERS.items()])


def severity_band(number: Column) -> Column:
    """Name of the band of four a severity number falls in; null outside 1..24."""
    names = F.array(*[F.lit(b) for b in BANDS])
    return F.when(number.between(1, 24), F.element_at(names, F.floor((number - 1) / 4).cast("int") + 1))


def level_word(text: Column) -> Column:
    """First level word of a text in all upper or all lower case."""
    return F.nullif(F.regexp_extract(text, LEVEL_WORD, 1), F.lit(""))


def logger_level(name: Column) -> Column:
    """Logger level of a configured name; anything unknown is info."""
    lowered = F.lower(name)
    return F.coalesce(*[F.when(lowered == k, v) for k, v in LOGGER_LEVELS.items()], F.lit("info"))
