"""Suffix-array dedup: removes every byte covered by a string of `width` bytes that also starts anywhere else.

Suffixes are compared by their first `width` bytes. The anchors of windows.py thin them out first: only blocks whose anchor
string occurs twice are looked at, blocks equal as a whole are settled by counting, and of the rest each different one is
fetched once. Their suffixes are range-partitioned by the leading bytes at the anchor, by splitters that Spark samples; a
bucket sorts its suffixes by multikey quicksort on eight bytes at a time, so that only ties are read further, and equal
neighbours are repeats. A leading string with more suffixes than a bucket may hold (windows.PART) is cut into several by the
suffixes' distance to the anchor, which equal suffixes share, so that no repeat lies across a boundary. Only where one distance
alone is too large (more than windows.SPREAD different blocks of one string) are suffixes compared across all buckets by the
hash of their `width` bytes.

Defined results: a null text is empty; texts shorter than `width` bytes lose nothing; rows that repeat, with equal ids or not,
remove each other wholly; strings are judged on the input; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracelode.llm.columns import Rolling, Texts, blocks_of, byte_values, slices, texts_of
from tracelode.llm.stored import stored
from tracelode.llm.windows import contested, covered, fetched, in_groups, parted, ranges, refine, repeated_blocks, runs, seeds, spread, verdicts

WIDTH = 200
#: Bytes of an anchor. Longer ones give more blocks but fewer that differ.
ANCHOR = 64


def cut_bytes(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    values = byte_values(texts.data)
    for begin, end in zip(texts.starts.tolist(), texts.starts[1:].tolist()):
        yield values[begin:end], np.arange(begin, end), np.arange(begin + 1, end + 1)


def keyed(docs: DataFrame) -> DataFrame:
    """row (a hash of id and text) and text."""
    return docs.select(F.xxhash64(F.col("doc_id"), "text").alias("row"), F.col("text").alias("text"))


def sorted_repeats(key: np.ndarray, before: np.ndarray, content: list[bytes], width: int) -> list[tuple[int, int, int]]:
    """(block, first offset, last offset) of the suffixes whose first `width` bytes occur in two of the blocks."""
    length = np.array([len(c) for c in content])
    block, offset, group = seeds(key, before, length - width + 1)
    data = np.frombuffer(b"".join(content) + b"\0" * 8, dtype=np.uint8).astype(np.uint64)
    n = len(data) - 7
    eight = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        eight |= data[i : i + n] << np.uint64(56 - 8 * i)
    place = (np.cumsum(length) - length)[block] + offset
    step = [*range(0, width - 7, 8)] + ([width - 8] if width % 8 else [])
    index, _ = refine(group, [lambda at, s=s: eight[place[at] + s] for s in step])
    index.sort()
    return ranges(block[index], offset[index])


PART = "row bigint, whole bigint, first int, last int"


def shared_suffixes(blocks: DataFrame, width: int, anchor: int) -> DataFrame:
    """row, whole, first, last: which suffixes of a block (mark: its text's row, for blocks of one text, else null) occur in
    another block of its key."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in runs(batches, "group"):
            found = sorted_repeats(piece.column("key").to_numpy(), piece.column("before").to_numpy(), piece.column("content").to_pylist(), width)
            mark, whole, shift = (piece.column(c).to_pylist() for c in ("mark", "whole", "shift"))
            found = [(mark[b], whole[b], first + shift[b], last + shift[b]) for b, first, last in found if mark[b] is not None]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                                             ["row", "whole", "first", "last"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "content"):
                texts = texts_of(part.column("content"))
                rows, offsets, hashes = [], [], []
                for i, (values, _, _) in enumerate(cut_bytes(texts)):
                    found = Rolling(values).windows(width)
                    rows.append(np.full(len(found), i))
                    offsets.append(np.arange(len(found), dtype=np.int32))
                    hashes.append(found.view(np.int64))
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("key", "mark", "whole")), pa.array(np.concatenate(offsets)), pa.array(np.concatenate(hashes))],
                                                 ["key", "row", "whole", "first", "hash"])

    near = in_groups(parted(blocks.where(~spread(F.col("different"))), cut_bytes, width, anchor))
    near = near.select("group", "key", "before", "shift", "content", "mark", "whole").mapInArrow(local, PART)
    apart = blocks.where(spread(F.col("different"))).select("key", "mark", "whole", "content").mapInArrow(
        hashed, "key bigint, row bigint, whole bigint, first int, hash bigint")
    twice = stored(apart.groupBy("key", "hash").agg(F.count("*").alias("n")).where("n > 1").select("key", "hash"), "suffixes")
    across = apart.where("row is not null").join(twice, ["key", "hash"]).select("row", "whole", "first", F.col("first").alias("last"))
    return near.union(across)


def repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """row, full and parts: which blocks of a text are repeated; see windows.covered. Texts without repeats have no row."""
    texts = keyed(docs)
    blocks = repeated_blocks(texts, cut_bytes, width, anchor)
    kinds = stored(blocks.groupBy("key", "whole").agg(F.count("*").alias("n"), F.min("row").alias("row")), "kinds")
    wanted = contested(kinds).select("row", "key", "whole", F.when(F.col("n") == 1, F.col("row")).alias("mark"), "different")
    content = stored(fetched(texts, wanted, "row", cut_bytes, width, anchor), "content")
    full = blocks.join(kinds.where("n > 1").select("key", "whole"), ["key", "whole"]).select("row", "whole")
    return verdicts(full, shared_suffixes(content, width, anchor), "row")


DIGEST = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _masks(part: pa.RecordBatch, width: int, anchor: int, full_: str = "full", parts_: str = "parts") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and what of them goes, for each row."""
    texts = texts_of(part.column("text"))
    for i, (values, full, parts) in enumerate(zip(cut_bytes(texts), part.column(full_).to_pylist(), part.column(parts_).to_pylist())):
        data = texts.data[texts.starts[i] : texts.starts[i + 1]]
        gone = covered(len(data), blocks_of(values[0], width, anchor), width, full, parts) if full or parts else np.zeros(len(data), dtype=bool)
        yield data, gone


def removed(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is kept, for every row."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [(len(data), int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1]) + bool(len(gone) and gone[0])), hashlib.sha256(data[~gone].tobytes()).hexdigest())
                        for data, gone in _masks(part, width, anchor)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string())))],
                                                 [c.split()[0] for c in DIGEST.split(", ")])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").alias("text"))
    return rows.join(repeats(docs, width, anchor), "row", "left").select("doc_id", "text", "full", "parts").mapInArrow(digest, DIGEST)


def without_repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """The rows, all columns, with the repeated bytes of the text cut out (a character that is cut in part goes wholly) and
    n_chars after it; rows that nothing is left of go."""
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts, keep = [], []
                for data, gone in _masks(part, width, anchor, "__full", "__parts"):
                    texts.append(data[~gone].tobytes().decode("utf-8", "ignore") if gone.any() else None)
                    keep.append(not gone.all() or not len(data))
                out = part.select(names)
                columns = dict(zip(names, out.columns))
                columns["text"] = pa.array([old if new is None else new for old, new in zip(out.column("text").to_pylist(), texts)], out.schema.field("text").type)
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([old if new is None else len(new) for old, new in zip(out.column("n_chars").to_pylist(), texts)], out.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], schema=out.schema).filter(pa.array(keep))

    keyed_ = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    marks = repeats(docs, width, anchor).withColumnRenamed("row", "__row").withColumnsRenamed({"full": "__full", "parts": "__parts"})
    return keyed_.join(marks, "__row", "left").drop("__row").mapInArrow(cut, docs.schema)
