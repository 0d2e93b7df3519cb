"""Tokens of short texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Words that carry no meaning for matching.
STOP_WORDS = (
    "the a an and or to for of in on is are it this that me my i please can you want need would like"
).split()
BETWEEN_TOKENS = r"[^\p{L}\p{Nd}]+"


def _is_token(word: Column) -> Column:
    return (F.octet_length(word) > 1) & ~word.isin(STOP_WORDS)


def _words(text: Column) -> Column:
    return F.split(F.lower(text), BETWEEN_TOKENS)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, without stop words and tokens of one byte."""
    return F.filter(_words(text), _is_token)


def token_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row (key, token) per token; as a row filter this is faster than over an array."""
    rows = df.select(key, F.explode(_words(F.col(text))).alias("token"))
    return rows.where(_is_token(F.col("token")))
