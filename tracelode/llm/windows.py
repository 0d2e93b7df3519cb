"""What the two operators on repeated passages share: which windows of a fixed width have an equal elsewhere.

The windows of a text are cut into blocks by their anchor (columns.blocks_of), so equal windows of any two texts lie in blocks
of equal key, equally far before the anchor. That leaves three steps:

1. Only keys that occur twice anywhere matter. They are found by a count of keys.
2. Blocks equal as a whole are settled by a count of (key, whole).
3. Different blocks of one key may share some windows. Each such block is fetched once, whatever number of texts hold it.

The third step differs by operator: see suffixes and subtrees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracelode.llm.columns import Blocks, Texts, blocks_of, slices, texts_of
from tracelode.llm.stored import stored

#: Windows that are compared in a task at once, about: a bound of its memory. The windows of a key are cut into parts of so many
#: by their distance to the anchor, as only windows of equal distance can be equal.
PART = 1 << 18
#: A key with more different blocks than this has more windows than a part may hold even of one distance; they are compared by
#: hash, over all tasks.
SPREAD = PART

#: For each text of a slice: its values, and where each value begins and ends in the slice's bytes.
Cut = Callable[[Texts], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def block_rows(docs: DataFrame, cut: Cut, width: int, k: int) -> DataFrame:
    """key, whole and the columns of `docs` but its text, for every block of every text."""
    names = [c for c in docs.columns if c != "text"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [blocks_of(values, width, k) for values, _, _ in cut(texts_of(part.column("text")))]
                rows = pa.array(np.repeat(np.arange(len(found)), [len(b.key) for b in found]))
                key, whole = (np.concatenate([getattr(b, c) for b in found]).view(np.int64) for c in ("key", "whole"))
                yield pa.RecordBatch.from_arrays([part.column(c).take(rows) for c in names] + [pa.array(key), pa.array(whole)], [*names, "key", "whole"])

    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in names)
    return docs.mapInArrow(read, f"{kinds}key bigint, whole bigint")


def repeated_blocks(docs: DataFrame, cut: Cut, width: int, k: int) -> DataFrame:
    """The block rows whose key occurs more than once."""
    blocks = block_rows(docs, cut, width, k)
    keys = stored(blocks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    return stored(blocks.join(keys, "key"), "blocks")


def contested(kinds: DataFrame) -> DataFrame:
    """Of one row per (key, whole), those whose key has several, with their number as `different`."""
    keys = stored(kinds.groupBy("key").agg(F.count("*").alias("different")).where("different > 1"), "contested")
    return kinds.join(keys, "key")


CONTENT = "key bigint, whole bigint, mark bigint, different bigint, before int, lead binary, content binary"


def fetched(docs: DataFrame, wanted: DataFrame, on: str, cut: Cut, width: int, k: int) -> DataFrame:
    """The content of blocks (key, whole, mark, different, and the column `on` of a text that holds it): the bytes that its
    windows cover, how many values lie before the anchor, and the anchor's own bytes as `lead`."""
    asked = wanted.groupBy(on).agg(F.collect_list(F.struct("whole", "mark", "different")).alias("asked"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts, rows = texts_of(part.column("text")), []
                for (values, start, end), asked_ in zip(cut(texts), part.column("asked").to_pylist()):
                    blocks, kinds = blocks_of(values, width, k), {a["whole"]: a for a in asked_}
                    for i in np.flatnonzero(np.isin(blocks.whole.view(np.int64), list(kinds))).tolist():
                        a = kinds.pop(int(blocks.whole[i].astype(np.int64)), None)
                        if a:
                            first, last, anchor = int(blocks.first[i]), int(blocks.last[i]) + width, int(blocks.anchor[i])
                            rows.append((int(blocks.key[i].astype(np.int64)), a["whole"], a["mark"], a["different"], anchor - first,
                                         texts.data[start[anchor] : end[anchor + k - 1]].tobytes(), texts.data[start[first] : end[last - 1]].tobytes()))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], [c.split()[0] for c in CONTENT.split(", ")])

    return docs.select(on, "text").join(asked, on).select("text", "asked").mapInArrow(read, CONTENT)


def parted(content: DataFrame, cut: Cut, width: int, k: int) -> DataFrame:
    """The content rows by parts of their key (`part`): of each block the stretch whose windows lie in a part, `shift` being the
    first of them. A key of one part keeps its rows as they are."""
    span = width - k + 1
    parts = F.least(F.lit(span), F.ceil(F.col("different") * span / PART)).cast("int")
    rows = content.withColumn("parts", parts)
    columns = ["key", "whole", "mark", "lead"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "content"):
                texts = texts_of(piece.column("content"))
                taken, out = [], ([], [], [], [])
                for row, (number, before, (values, start, end)) in enumerate(zip(piece.column("parts").to_pylist(), piece.column("before").to_pylist(), cut(texts))):
                    count = len(values) - width + 1
                    for part in range(number):
                        # Distances [low, high) are offsets before - high + 1 .. before - low.
                        low, high = part * span // number, (part + 1) * span // number
                        first, last = max(0, before - high + 1), min(count - 1, before - low)
                        if first <= last:
                            taken.append(row)
                            for column, value in zip(out, (part, before - first, first, texts.data[start[first] : end[last + width - 1]].tobytes())):
                                column.append(value)
                at = pa.array(taken, pa.int64())
                yield pa.RecordBatch.from_arrays([*(piece.column(c).take(at) for c in columns), *(pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.int32(), pa.binary())))],
                                                 [*columns, "part", "before", "shift", "content"])

    return rows.mapInArrow(read, "key bigint, whole bigint, mark bigint, lead binary, part int, before int, shift int, content binary")


def in_groups(content: DataFrame) -> DataFrame:
    """Content rows in range partitions by anchor and part, by splitters that Spark samples, in order of them. Rows of one
    anchor and part share `group`."""
    rows = content.withColumn("group", F.xxhash64("key", "part"))
    return rows.repartitionByRange("lead", "part").sortWithinPartitions("lead", "key", "part")


def runs(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 11) -> Iterator[pa.RecordBatch]:
    """Regroups sorted rows so that rows equal in `column` stay together, in pieces of about `most` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            held.append(batch.slice(at, most))
            if sum(b.num_rows for b in held) < most:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            values = whole.column(column).to_numpy()
            other = np.flatnonzero(values != values[-1])
            end = int(other[-1]) + 1 if len(other) else 0
            if end:
                yield whole.slice(0, end)
            held = [whole.slice(end)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def refine(group: np.ndarray, levels: Iterable[Callable[[np.ndarray], np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Splits groups by one key after the other; members that are alone are dropped at once, so only ties go deeper. Returns
    the members that are left, sorted, and their groups."""
    index = np.arange(len(group))
    for level in levels:
        if not len(index):
            break
        keys = level(index)
        order = np.lexsort((keys, group))
        keys, group = keys[order], group[order]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (group[1:] != group[:-1]) | (keys[1:] != keys[:-1])
        start = np.flatnonzero(fresh)
        size = np.diff(np.append(start, len(order)))
        shared = np.repeat(size > 1, size)
        index, group = index[order][shared], np.repeat(start, size)[shared]
    return index, group


def seeds(key: np.ndarray, before: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of several blocks: block number, offset in the block, and a first group by key and distance to the anchor."""
    block = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    _, named = np.unique(key, return_inverse=True)
    distance = before[block] - offset
    return block, offset, named[block] * (int(before.max(initial=0)) + 1) + distance


def ranges(block: np.ndarray, offset: np.ndarray) -> list[tuple[int, int, int]]:
    """(block, first offset, last offset) of runs of offsets; both sorted by block, then offset."""
    if not len(block):
        return []
    cut = np.flatnonzero((np.diff(block) != 0) | (np.diff(offset) != 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(block)]]) - 1
    return list(zip(block[first].tolist(), offset[first].tolist(), offset[last].tolist()))


def covered(count: int, blocks: Blocks, width: int, full: list[int] | None, parts: list[dict] | None) -> np.ndarray:
    """Which of a text's values lie in a window that is repeated: all windows of `full` blocks, some of `parts`."""
    change = np.zeros(count + 1, dtype=np.int64)
    whole = blocks.whole.view(np.int64)
    if full and len(whole):
        hit = np.isin(whole, np.array(full, dtype=np.int64))
        np.add.at(change, blocks.first[hit], 1)
        np.add.at(change, blocks.last[hit] + width, -1)
    for part in parts or ():
        for first in blocks.first[whole == part["whole"]].tolist():
            change[first + part["first"]] += 1
            change[first + part["last"] + width] -= 1
    return np.cumsum(change[:-1]) > 0


def verdicts(full: DataFrame, parts: DataFrame, on: str) -> DataFrame:
    """One row per text: the blocks that go wholly, and parts of others."""
    a = full.groupBy(on).agg(F.collect_set("whole").alias("full"))
    b = parts.groupBy(on).agg(F.collect_list(F.struct("whole", "first", "last")).alias("parts"))
    return a.join(b, on, "full_outer")


def spread(different: Column) -> Column:
    return different > SPREAD
