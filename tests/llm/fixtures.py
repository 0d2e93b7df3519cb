"""Small tables for the training-data operators: nulls, empty and long texts, repeated rows, clashing extra columns."""

import random

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ("row", "size", "full", "parts", "node", "key", "whole", "component", "cluster_id", "bucket", "guest", "taken", "target", "spans", "host", "asked", "test",
            "rejected", "hash", "sequence_id", "length")


def words(seed: int, n: int, letters: str = "abcdefghijklmnopqrst") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def corpus(seed: int = 0, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared passages, and the awkward rows."""
    rng = random.Random(seed)
    passage = words(999, 70)
    rows = []
    for i in range(n):
        text = words(seed * 1000 + i, rng.randint(1, 160))
        if i % 5 == 1 and rows:
            text = rng.choice(rows)[1] or "x"
        elif i % 5 == 2:
            at = rng.randint(0, 3)
            parts = text.split()
            text = " ".join(parts[:at] + passage.split() + parts[at:])
        elif i % 5 == 3 and rows:
            parts = (rows[-1][1] or "x").split()
            parts[len(parts) // 2] = f"changed{i}"
            text = ("\n" if i % 2 else " ").join(parts)
        rows.append((i, text, rng.choice(["aa", "bb"]), f"s{i % 4}", len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "aa", "s1", 0), (n + 2, " \n\t ", "bb", None, 4), (n + 3, "one", "aa", "s2", 3),
             (n + 4, "é" * 150, "aa", "s3", 150), (n + 5, words(5, 30_000), "bb", "s3", 0), (None, words(7, 80), "aa", "s1", 0),
             (n + 6, words(8, 90), "aa", "s1", 1), (n + 6, words(8, 90), "aa", "s1", 1)]
    return rows


def frame(spark: SparkSession, rows: list[tuple], extra: bool = True) -> DataFrame:
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING}) if extra else df
