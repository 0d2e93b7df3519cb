"""Periodic runs of words: Lyndon roots by Baier grouping, extended to runs by longest common extensions.

A run is a stretch with smallest period q that no neighbour extends. Under one of two opposite orders of the words, every run
holds a place whose longest Lyndon word has the run's period (the runs theorem), so both orders' Lyndon arrays name all roots.
`lyndon_array` is the first phase of Baier's suffix sorting: groups of suffixes start as the distinct words and are taken from
the highest down; a group's members pass their common Lyndon word to the nearest place on their left that is still open, and
places that were given equally many copies leave their group for a new one right above it. A group's length when its turn
comes is the Lyndon array's value at its members.

Only stretches covered by GRAM words that occur twice in their text reach that phase: a run of LEAST words or more, at least
two periods long, is covered by such, and so is all that could extend it. Stretches of many texts are laid behind each other,
parted by symbols that occur once.

Equal words, and equal stretches of 2^k words, carry equal numbers (no hashes), so extensions are exact.

Defined results: a null text has no words; repeated rows are worked on each; a null id is kept; a text is one task's work, in
memory of about 300 bytes a word of the stretches that repeat; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracelode.llm.columns import mix, slices

#: Words of the shortest run.
LEAST = 12
#: Half of it: what a run repeats without a break, at least.
GRAM = LEAST // 2
_ODD = 0x9E3779B97F4A7C15


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word at every place; ranks are 0.. without gaps."""
    n, kinds = len(ranks), max(ranks, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(kinds)]
    for place, rank in enumerate(ranks):
        members[rank].append(place)
    group, length, size = list(ranks), [1] * kinds, [len(m) for m in members]
    below, above = list(range(-1, kinds - 1)), list(range(1, kinds + 1))
    # left[i + 1] leads to the nearest open place at or left of i, 0 if there is none.
    left, result = list(range(n + 1)), [0] * n
    top = kinds - 1
    while top >= 0:
        own, word = members[top], length[top]
        if len(own) != size[top]:
            own = [i for i in own if group[i] == top]
        for i in own:
            result[i] = word
            left[i + 1] = i
        given: dict[int, int] = {}
        for i in own:
            at = i
            while left[at] != at:
                left[at] = left[left[at]]
                at = left[at]
            if at:
                given[at - 1] = given.get(at - 1, 0) + 1
        parts: dict[int, dict[int, list[int]]] = {}
        for place, copies in given.items():
            parts.setdefault(group[place], {}).setdefault(copies, []).append(place)
        for old, by_copies in parts.items():
            if len(by_copies) == 1:
                (copies, places), = by_copies.items()
                if len(places) == size[old]:
                    length[old] += copies * word
                    continue
            base, higher = old, above[old]
            for copies in sorted(by_copies):
                places = by_copies[copies]
                new = len(length)
                length.append(length[old] + copies * word)
                size.append(len(places))
                members.append(places)
                for place in places:
                    group[place] = new
                size[old] -= len(places)
                below.append(base)
                above.append(higher)
                above[base] = new
                base = new
            # `top` itself may be the higher neighbour: what is new comes next.
            if higher < len(below):
                below[higher] = base
        top = below[top]
    return result


def names_of(symbols: np.ndarray, longest: int) -> list[np.ndarray]:
    """For k = 0, 1, ..: a number for the 2^k symbols at every place, equal where they are, up to `longest` symbols or until
    all differ."""
    levels, width = [symbols], 1
    while 2 * width <= longest:
        now = levels[-1].astype(np.int64)
        if len(now) <= width:
            break
        kinds = int(now.max()) + 1
        _, names = np.unique(now[:-width] * kinds + now[width:], return_inverse=True)
        if len(names) == int(names.max()) + 1:
            break
        levels.append(names.astype(np.int32))
        width *= 2
    return levels


def extended(levels: list[np.ndarray], at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretch around each place of `at` in which symbols `period` apart are equal."""
    n = len(levels[0])
    right, left = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        names, width = levels[k], 1 << k
        here, there = at + right, at + right + period
        fits = np.flatnonzero(there + width <= n)
        right[fits[names[here[fits]] == names[there[fits]]]] += width
        here = at - left - width
        fits = np.flatnonzero(here >= 0)
        left[fits[names[here[fits]] == names[here[fits] + period[fits]]]] += width
    return at - left, at + period + right


def all_runs(symbols: np.ndarray, longest: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of every run of `least` symbols or more, by start, then period. No run is over `longest` long."""
    if not len(symbols):
        return (np.zeros(0, dtype=np.int64),) * 3
    _, ranks = np.unique(symbols, return_inverse=True)
    ranks = ranks.astype(np.int32)
    levels = names_of(ranks, longest)
    found = []
    for order in (ranks, int(ranks.max()) - ranks):
        period = np.array(lyndon_array(order.tolist()), dtype=np.int64)
        at = np.flatnonzero(2 * period <= longest)
        period = period[at]
        start, end = extended(levels, at, period)
        keep = end - start >= np.maximum(2 * period, least)
        found.append(np.stack([start[keep], period[keep], end[keep]], axis=1))
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[:, 0], runs[:, 2], runs[:, 1]


def repeating(texts: list[np.ndarray], gram: int = GRAM) -> list[tuple[int, int, int]]:
    """(text, start, end) of the longest stretches that are covered by `gram` words which occur twice in the text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    if starts[-1] < gram:
        return []
    values = np.concatenate(texts).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    values = mix(values + np.uint64(1) + (owner.astype(np.uint64) << np.uint64(32)))
    n = len(values) - gram + 1
    hashes = np.zeros(n, dtype=np.uint64)
    for k in range(gram):
        hashes = hashes * np.uint64(_ODD) + values[k : k + n]
    hashes[owner[:n] != owner[gram - 1 :]] = 0
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    same = np.zeros(n, dtype=bool)
    equal = ordered[1:] == ordered[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    twice = order[same & (ordered != 0)]
    change = np.zeros(len(values) + 1, dtype=np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + gram, -1)
    covered = np.cumsum(change[:-1]) > 0
    edge = np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = []
    for begin, end in zip(begins.tolist(), ends.tolist()):
        # A stretch may go on from one text to the next.
        text = int(owner[begin])
        while begin < end:
            stop = min(end, int(starts[text + 1]))
            if stop > begin:
                out.append((text, begin - int(starts[text]), stop - int(starts[text])))
            begin, text = stop, text + 1
    return out


def runs_of_texts(texts: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """For each text, given as word numbers, its runs as rows (start, length, period), by start, then period."""
    pieces = [(t, s, e) for t, s, e in repeating(texts, least // 2) if e - s >= least]
    found: list[list[np.ndarray]] = [[] for _ in texts]
    if pieces:
        parts, owners, shifts = [], [], []
        base, separator = 0, -1
        for text, start, end in pieces:
            words = texts[text][start:end].astype(np.int64)
            parts += [words + base, np.array([separator])]
            base, separator = base + int(words.max()) + 1, separator - 1
            owners.append(text)
            shifts.append(start)
        sizes = np.array([len(p) for p in parts]).reshape(-1, 2).sum(axis=1)
        firsts = np.concatenate([[0], np.cumsum(sizes)])
        start, end, period = all_runs(np.concatenate(parts), int(sizes.max()) - 1, least)
        piece = np.searchsorted(firsts, start, side="right") - 1
        rows = np.stack([start - firsts[piece] + np.array(shifts)[piece], end - start, period], axis=1)
        cuts = np.searchsorted(piece, np.arange(len(pieces) + 1))
        for k, text in enumerate(owners):
            if cuts[k + 1] > cuts[k]:
                found[text].append(rows[cuts[k] : cuts[k + 1]])
    return [np.concatenate(f) if f else np.zeros((0, 3), dtype=np.int64) for f in found]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when every run is cut to its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of all texts, by the crc32 of their id, with a tail that repeats: each word from place a on becomes the one
    p places before. A text without id is left alone."""
    h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    period = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (period * ((n - a) // len(period) + 1))[: n - a]


RUNS = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def periodic_runs(docs: DataFrame, least: int = LEAST, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed: the words without what runs repeat, joined by one space.
    `edit` changes the words of a text beforehand."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("doc_id").to_pylist()
        words = [(text or b"").split() for text in batch.column("text").to_pylist()]
        if edit:
            words = [edit(i, w) for i, w in zip(ids, words)]
        numbered = []
        for own in words:
            seen: dict[bytes, int] = {}
            numbered.append(np.array([seen.setdefault(w, len(seen)) for w in own], dtype=np.int64))
        found = runs_of_texts(numbered, least)
        collapsed = []
        for own, runs in zip(words, found):
            if len(runs):
                own = [own[i] for i in np.flatnonzero(kept_words(len(own), runs)).tolist()]
            collapsed.append(b" ".join(own))
        rows = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array(rows[:, j].copy(), pa.int64()) for j in range(3)], names=["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(offsets), structs).cast(kind)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), lists,
                                           pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                yield part(piece)

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(every, RUNS)


def digests(found: DataFrame) -> DataFrame:
    """One row a document: how many runs, the longest (the first of the shortest period if equal), digests of all runs and of
    the collapsed text."""
    longest = "array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))"
    rows = found.withColumn("longest", F.expr(longest))
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    return rows.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("longest.start")).alias("start"),
                       F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
                       F.expr("longest.length * 1000 div -longest.period").alias("exponent_milli"),
                       F.sha2(F.expr(lines), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
