"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

Each paragraph (a line with something in it) is hashed to a wide vector, and the vectors of a text are summed lane by lane
modulo powers of two. Order does not matter, a paragraph is inserted by adding its vector and deleted by subtracting it.
The vector has two parts: uniform 64-bit lanes (modulo 2**64), by which multisets are told apart, and 32-bit lanes (modulo
2**32) that hold +1 or -1 for each three words of the paragraph in the lane of their hash. The squared length of a difference
of the latter estimates how many word triples two texts do not share, which gives a likeness.

Defined results: a null text is empty; texts without paragraphs have the zero vector and likeness 1 to each other; equal
texts, and texts with the same lines in another order, have equal fingerprints; extra columns are not read. Of rows that
share a doc_id the next one is found by a hash of the text; a null id comes before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracelode.llm.columns import Rolling, Texts, byte_values, mix, texts_of, words_of

LANES = 16
SKETCH = 128
SHINGLE = 3

_LANES = mix(np.arange(1, LANES + 1, dtype=np.uint64))
_NEWLINE = 0x0A


class Vectors(NamedTuple):
    """One row per text."""

    wide: np.ndarray
    sketch: np.ndarray

    def __add__(self, other: Vectors) -> Vectors:  # type: ignore[override]
        return Vectors(self.wide + other.wide, self.sketch + other.sketch)

    def __sub__(self, other: Vectors) -> Vectors:
        return Vectors(self.wide - other.wide, self.sketch - other.sketch)

    def hex(self) -> list[str]:
        raw = np.concatenate([self.wide.astype("<u8").view(np.uint8), self.sketch.astype("<u4").view(np.uint8)], axis=1)
        return [row.tobytes().hex() for row in raw]

    @staticmethod
    def of_hex(values: list[str]) -> Vectors:
        raw = np.frombuffer(bytes.fromhex("".join(values)), dtype=np.uint8).reshape(len(values), -1)
        return Vectors(raw[:, : 8 * LANES].copy().view("<u8").astype(np.uint64), raw[:, 8 * LANES :].copy().view("<u4").astype(np.uint32))


def vectors(texts: Texts) -> Vectors:
    """The summed vectors of several texts."""
    data, starts = texts
    count = len(starts) - 1
    line_end = data == _NEWLINE
    begins = np.unique(np.concatenate([[0], np.flatnonzero(line_end) + 1, starts[:-1]])) if len(data) else np.zeros(0, np.int64)
    begins = begins[begins < len(data)]
    ends = np.append(begins[1:], len(data))
    ends = ends - ((ends > begins) & line_end[np.maximum(ends - 1, 0)]) if len(begins) else ends
    filled = ends > begins
    begins, ends = begins[filled], ends[filled]
    owner = np.searchsorted(starts, begins, side="right") - 1
    paragraph = Rolling(byte_values(data)).ranges(begins, ends)
    wide = np.zeros((count, LANES), dtype=np.uint64)
    np.add.at(wide, owner, mix(paragraph[:, None] ^ _LANES[None, :]))
    words = words_of(texts)
    line = np.searchsorted(begins, words.start, side="right") - 1
    n = max(len(words.hash) - SHINGLE + 1, 0)
    whole = line[SHINGLE - 1 :][:n] == line[:n]
    grams = mix(sum(words.hash[i : i + n] * np.uint64(2 * i + 3) for i in range(SHINGLE)))[whole] if n else np.zeros(0, np.uint64)
    in_line = np.bincount(line[:n][whole], minlength=len(begins)) if n else np.zeros(len(begins), np.int64)
    short = np.flatnonzero(in_line == 0)
    grams = np.concatenate([grams, paragraph[short]])
    rows = np.concatenate([owner[line[:n][whole]] if n else np.zeros(0, np.int64), owner[short]])
    sign = np.where(grams >> np.uint64(63), 1.0, -1.0)
    sketch = np.bincount(rows * SKETCH + (grams % np.uint64(SKETCH)).astype(np.int64), weights=sign, minlength=count * SKETCH)
    return Vectors(wide, sketch.astype(np.int64).astype(np.uint32).reshape(count, SKETCH))


def likeness(a: Vectors, b: Vectors) -> np.ndarray:
    """Estimated share of word triples in common, 0 to 1; 1 for equal fingerprints."""
    square = lambda x: (x.astype(np.int32).astype(np.float64) ** 2).sum(axis=1)
    both = square(a.sketch) + square(b.sketch)
    near = np.clip(1 - square(a.sketch - b.sketch) / np.maximum(both, 1), 0, 1)
    return np.where((a.wide == b.wide).all(axis=1) & (a.sketch == b.sketch).all(axis=1), 1.0, near)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every text."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(vectors(texts_of(batch.column("text"))).hex(), pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(hashed, f"doc_id {kind}, fingerprint string")


def changed(fingerprints: pd.Series, added: pd.Series, removed: pd.Series) -> pd.Series:
    """Fingerprints after paragraphs are added and removed, without the rest of the texts."""
    plus, minus = (vectors(texts_of(pa.array(x, pa.string()))) for x in (added, removed))
    return pd.Series((Vectors.of_hex(list(fingerprints)) + plus - minus).hex())


def update(fingerprints: DataFrame, changes: DataFrame) -> DataFrame:
    """Fingerprints (doc_id, fingerprint) after changes (doc_id, added, removed: texts of whole lines), one change a document."""
    change = F.pandas_udf(changed, "string")
    joined = fingerprints.join(changes.select("doc_id", "added", "removed"), "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("added").isNull() & F.col("removed").isNull(), F.col("fingerprint"))
                         .otherwise(change("fingerprint", F.coalesce("added", F.lit("")), F.coalesce("removed", F.lit("")))).alias("fingerprint"))


def edited_text(text: str, following: str) -> str:
    """The last half of a text (rounded down) replaced by as many characters of the next one, or all that it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


EDITED = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text and bucket, dealt by ranges of doc_id and sorted; the first row of a bucket also ends the bucket before it
    (of the last bucket: the first row of all), marked as guest."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 10 * buckets).alias("cuts")).first()["cuts"]
    cuts = np.unique(np.array(cuts or [], dtype=np.int64)) if buckets > 1 else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def bucket_of(values: pd.Series) -> pd.Series:
        return pd.Series(np.where(values.isna(), 0, np.searchsorted(cuts, values.fillna(0).to_numpy().astype(np.int64), side="right")))

    firsts = sorted((r["bucket"], r["low"], r["nulls"]) for r in ids.groupBy(bucket_of("doc_id").alias("bucket")).agg(
        F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect())
    guests = [(None if nulls else low, firsts[i - 1][0]) for i, (_, low, nulls) in enumerate(firsts)]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).withColumn("bucket", bucket_of(F.col("doc_id").cast("bigint")))
    guest = docs.sparkSession.createDataFrame(guests, "first_id bigint, bucket int")
    again = rows.drop("bucket").join(F.broadcast(guest), F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "text", "bucket", F.lit(True).alias("guest"))
    dealt = rows.withColumn("guest", F.lit(False)).unionByName(again)
    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "guest", "doc_id", F.xxhash64("text"))


def edited(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Every text's fingerprint beside that of its edited text (see edited_text) and its likeness to the next document."""
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "guest"))))
            for start in range(0, len(rows), 256):
                part = ([waiting] if waiting else []) + rows[start : start + 256]
                waiting = part[-1]
                pairs = [i for i in range(len(part) - 1) if not part[i][3] and part[i][2] == part[i + 1][2]]
                if pairs:
                    texts = [row[1] or "" for row in part]
                    new = [edited_text(texts[i], texts[i + 1]) for i in pairs]
                    all_ = vectors(texts_of(pa.array(texts + new, pa.string())))
                    pick = lambda at: Vectors(all_.wide[at], all_.sketch[at])
                    at = np.array(pairs)
                    own, after, made = pick(at), pick(at + 1), pick(len(texts) + np.arange(len(pairs)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([part[i][0] for i in pairs], pa.int64()), pa.array([len(texts[i]) for i in pairs], pa.int64()),
                        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]), pa.array(own.hex()), pa.array(made.hex()),
                        pa.array(likeness(own, made)), pa.array(likeness(own, after))],
                        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs, buckets).mapInArrow(compare, EDITED)
