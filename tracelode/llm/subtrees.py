"""Substring dedup: removes every word covered by a window of `width` words whose word sequence also starts in a document of
smaller doc_id.

Suffixes (of words, read to `width`) fall into groups by a prefix of variable length. The usual prefix is the anchor of
windows.py: only prefixes that occur twice are looked at, blocks equal as a whole are settled by the least doc_id of each,
and of the rest each different one is fetched once. A prefix with more suffixes than a task may hold (windows.PART) is
lengthened to the left, by the words before the anchor: its suffixes of different lengths of that fall into groups of their own.
One that is too large for a single length still (more than windows.SPREAD different blocks) is lengthened to the whole
window, where a group is one word sequence and needs only its least doc_id. Every other group fits in memory: its suffix tree
is built from the top down, a node's suffixes being split by the next words until they are alone. What is
left at depth `width` are the deep inner nodes, each a maximal repeat with all its places; the least doc_id beneath a node
decides which of its suffixes go.

Defined results: a null text has no words; a document without an id neither removes nor loses anything; of rows that share
an id none is smaller than the other; windows are judged on the input; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracelode.llm.columns import Rolling, Texts, blocks_of, slices, texts_of, words_of
from tracelode.llm.stored import stored
from tracelode.llm.windows import contested, covered, fetched, in_groups, parted, ranges, refine, repeated_blocks, runs, seeds, spread, verdicts

WIDTH = 50
#: Words of an anchor.
ANCHOR = 8
#: Words by which a branch of a tree goes deeper.
BRANCH = 5


def cut_words(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    words = words_of(texts)
    for a, b in zip(words.first.tolist(), words.first[1:].tolist()):
        yield words.hash[a:b], words.start[a:b], words.end[a:b]


def earlier_repeats(key: np.ndarray, before: np.ndarray, mark: np.ndarray, content: pa.Array, width: int) -> list[tuple[int, int, int]]:
    """(block, first offset, last offset) of the suffixes whose first `width` words occur in a block of smaller mark."""
    words = [values for values, _, _ in cut_words(texts_of(content))]
    length = np.array([len(w) for w in words])
    block, offset, group = seeds(key, before, length - width + 1)
    rolling = Rolling(np.concatenate(words))
    place = (np.cumsum(length) - length)[block] + offset
    depths = [*range(0, width, BRANCH)]
    levels = [lambda at, d=d: rolling.ranges(place[at] + d, place[at] + min(d + BRANCH, width)) for d in depths]
    index, node = refine(group, levels)
    if not len(index):
        return []
    marks = mark[block[index]]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    least = np.repeat(np.minimum.reduceat(marks, first), np.diff(np.append(first, len(node))))
    index = np.sort(index[marks > least])
    return ranges(block[index], offset[index])


PART = "doc_id bigint, whole bigint, first int, last int"


def earlier_suffixes(blocks: DataFrame, width: int, anchor: int) -> DataFrame:
    """doc_id, whole, first, last: which windows of a block (mark: its least doc_id) start in a block of smaller mark."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in runs(batches, "group"):
            mark, whole, shift = piece.column("mark").to_numpy(), *(piece.column(c).to_pylist() for c in ("whole", "shift"))
            found = [(int(mark[b]), whole[b], first + shift[b], last + shift[b])
                     for b, first, last in earlier_repeats(piece.column("key").to_numpy(), piece.column("before").to_numpy(), mark, piece.column("content"), width)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                                             ["doc_id", "whole", "first", "last"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "content"):
                rows, offsets, hashes = [], [], []
                for i, (values, _, _) in enumerate(cut_words(texts_of(part.column("content")))):
                    found = Rolling(values).windows(width)
                    rows.append(np.full(len(found), i))
                    offsets.append(np.arange(len(found), dtype=np.int32))
                    hashes.append(found.view(np.int64))
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("key", "mark", "whole")), pa.array(np.concatenate(offsets)), pa.array(np.concatenate(hashes))],
                                                 ["key", "doc_id", "whole", "first", "hash"])

    near = in_groups(parted(blocks.where(~spread(F.col("different"))), cut_words, width, anchor))
    near = near.select("group", "key", "before", "shift", "mark", "whole", "content").mapInArrow(local, PART)
    apart = blocks.where(spread(F.col("different"))).select("key", "mark", "whole", "content").mapInArrow(
        hashed, "key bigint, doc_id bigint, whole bigint, first int, hash bigint")
    least = stored(apart.groupBy("key", "hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"), "suffixes")
    across = apart.join(least, ["key", "hash"]).where("doc_id > least").select("doc_id", "whole", "first", F.col("first").alias("last"))
    return near.union(across)


def repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, full and parts: which blocks of a document are repeated; see windows.covered."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).where("doc_id is not null")
    blocks = repeated_blocks(texts, cut_words, width, anchor)
    kinds = stored(blocks.groupBy("key", "whole").agg(F.min("doc_id").alias("mark"), F.max("doc_id").alias("most")), "kinds")
    wanted = contested(kinds).select("key", "whole", "mark", "different", F.col("mark").alias("doc_id"))
    content = stored(fetched(texts, wanted, "doc_id", cut_words, width, anchor), "content")
    full = blocks.join(kinds.where("mark < most").select("key", "whole", "mark"), ["key", "whole"]).where("doc_id > mark").select("doc_id", "whole")
    return verdicts(full, earlier_suffixes(content, width, anchor), "doc_id")


DIGEST = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def removed(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the words kept, for every row."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for data, starts, ends, gone in _masks(part, width, anchor):
                    kept = b" ".join(data[a:b].tobytes() for a, b in kept_runs(data, starts, ends, gone))
                    rows.append((len(gone), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string())))],
                                                 [c.split()[0] for c in DIGEST.split(", ")])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    return rows.join(repeats(docs, width, anchor), "doc_id", "left").select("doc_id", "text", "full", "parts").mapInArrow(digest, DIGEST)


def kept_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of what is kept, cut wherever words do not stand one plain space apart."""
    starts, ends = starts[~gone], ends[~gone]
    if not len(starts):
        return []
    joined = (starts[1:] == ends[:-1] + 1) & (data[np.minimum(ends[:-1], len(data) - 1)] == 0x20)
    cut = np.flatnonzero(~joined) + 1
    return list(zip(starts[np.concatenate([[0], cut])].tolist(), ends[np.concatenate([cut, [len(ends)]]) - 1].tolist()))


def _masks(part: pa.RecordBatch, width: int, anchor: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, the words' begins and ends, and which words go, for each row; bytes are the whole slice's."""
    texts = texts_of(part.column("text"))
    for (values, starts, ends), full, parts in zip(cut_words(texts), part.column("full").to_pylist(), part.column("parts").to_pylist()):
        gone = covered(len(values), blocks_of(values, width, anchor), width, full, parts) if full or parts else np.zeros(len(values), dtype=bool)
        yield texts.data, starts, ends, gone
