"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source gets a target in words: its weight's share of all words, at most `most` times its size, what is above reshared
by weight. The words of a source lie in shards, and in a shard in blocks of equally many words that cross document limits; only
sources too small for BLOCK_WORDS have shorter blocks, which changes no other source's.
Blocks are allotted by highest quotients (target divided by the odd numbers), first to the sources of a block length, then within a source to
its shards, so each shard has a whole number of blocks. Which blocks a shard gives is drawn by a seeded hash; a quota above
the number of blocks takes all of them once or twice first.

Defined results: a null text has no words; a null source is one source, after all others; sources without words get target
0; equal quotients go to the earlier source or shard; rows that repeat count each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracelode.llm.columns import mix, slices, texts_of, words_of

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 20
#: Words of a shard, about, and the most shards a source gets; with more words than both allow, shards grow.
SHARD_WORDS = 1 << 19
SHARDS = 4096
#: Words of a block: the second for every source of FULL such blocks or more (by its size and its target); a smaller source
#: has blocks of its own length, a FULL-th of it, but of the first at least.
BLOCK_WORDS = (8, 256)
FULL = 64
#: Stands for a null source among keys; names begin with "=".
NO_SOURCE = "~"


def size_of(text: Column) -> Column:
    """Words of a text: longest runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def capped_targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of sum(sizes) by weight; none above most * size, the excess reshared by weight among the rest."""
    targets = [0.0] * len(sizes)
    open_, left = [i for i, size in enumerate(sizes) if size > 0], float(sum(sizes))
    while open_:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / whole >= most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / whole
            break
        for i in full:
            targets[i] = float(most * sizes[i])
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def sainte_lague(shares: np.ndarray, seats: int, limits: np.ndarray) -> np.ndarray:
    """Seats by highest quotients share / (2 * got + 1), none above its limit; equal quotients go to the earlier party.

    A divisor that gives about all seats is found by halving; the few seats left are dealt one by one."""
    shares, limits = np.asarray(shares, dtype=float), np.asarray(limits, dtype=np.int64)
    seats = int(min(seats, limits[shares > 0].sum())) if len(shares) else 0
    got = np.zeros(len(shares), dtype=np.int64)
    if seats <= 0:
        return got
    given = lambda d: np.where(shares > 0, np.minimum(np.floor(shares / d + 0.5), limits), 0).astype(np.int64)
    low, high = shares[shares > 0].min() / (2.0 * seats + 4), 2.0 * shares.sum() + 1
    while given(low).sum() < seats:
        low /= 2
    for _ in range(200):
        middle = (low + high) / 2
        if given(middle).sum() > seats:
            low = middle
        else:
            high = middle
    got = given(high)
    while got.sum() < seats:
        quotient = np.where((got < limits) & (shares > 0), shares / (2 * got + 1), -1.0)
        got[int(np.argmax(quotient))] += 1
    return got


def source_plan(sized: DataFrame, weights: tuple[float, ...], most: int, block_words: tuple[int, int]) -> list[tuple]:
    """(key, size, target, shards, blocks, words of a block) of each source. One entry per source name is held here."""
    rows = [(r["__key"], int(r["words"])) for r in sized.groupBy("__key").agg(F.sum("size").alias("words")).collect()]
    rows.sort(key=lambda x: (x[0] == NO_SOURCE, x[0]))
    sizes = [n for _, n in rows]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], most)
    shares, limits = np.array(targets), np.array(sizes, dtype=np.int64)
    lengths = np.clip(np.minimum(shares, limits) // FULL, *block_words).astype(np.int64)
    blocks = np.zeros(len(rows), dtype=np.int64)
    for length in np.unique(lengths):
        of = lengths == length
        blocks[of] = sainte_lague(shares[of], round(shares[of].sum() / length), most * -(-limits[of] // length))
    return [(key, n, t, int(np.clip(-(-n // SHARD_WORDS), 1, SHARDS)), int(b), int(w)) for (key, n), t, b, w in zip(rows, targets, blocks, lengths)]


def chosen(words: int, block: int, quota: int, seed: int, name: str) -> np.ndarray:
    """How often each block of a shard is taken: whole rounds, and the rest by lowest seeded hash."""
    blocks = -(-words // block)
    times = np.full(blocks, quota // max(blocks, 1), dtype=np.int64)
    rest = quota - int(times.sum())
    if rest > 0:
        order = mix(np.arange(blocks, dtype=np.uint64) + mix(np.array([seed << 32 | zlib.crc32(name.encode())], dtype=np.uint64)))
        times[np.argsort(order, kind="stable")[:rest]] += 1
    return times


def spans_of(begin: int, end: int, block: int, times: np.ndarray) -> list[list[int]]:
    """(first word, end word, times) of a document that holds words begin..end of its shard, without what is not taken."""
    spans: list[list[int]] = []
    for b in range(begin // block, -(-end // block)) if end > begin else ():
        n, first, last = int(times[b]), max(begin, b * block) - begin, min(end, (b + 1) * block) - begin
        if spans and spans[-1][2] == n:
            spans[-1][1] = last
        else:
            spans.append([first, last, n])
    return [s for s in spans if s[2]]


def mix_spans(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED,
              block_words: tuple[int, int] = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, text_hash, and spans: what is taken of each row of `docs`."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(NO_SOURCE))
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("__key"), size_of(F.col("text")).alias("size"),
                        F.xxhash64(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), "text").alias("text_hash"))
    plan = source_plan(sized, weights, most, block_words)
    sources = docs.sparkSession.createDataFrame(plan, "__key string, source_size bigint, target double, shards bigint, blocks bigint, block bigint")
    keyed = sized.join(sources, "__key").withColumn("__shard", F.pmod(F.xxhash64(F.lit(seed), "text_hash"), "shards"))
    shards = keyed.groupBy("__key", "__shard").agg(F.sum("size").alias("shard_words"), F.first("blocks").alias("blocks"), F.first("block").alias("block"))

    def quotas(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__shard", kind="stable")
        words = frame["shard_words"].to_numpy()
        quota = sainte_lague(words, int(frame["blocks"].iloc[0]), most * -(-words // int(frame["block"].iloc[0])))
        return frame.assign(quota=quota)[["__key", "__shard", "quota"]]

    quota = shards.groupBy("__key").applyInPandas(quotas, "__key string, __shard bigint, quota bigint")

    def take(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "text_hash"], kind="stable")
        sizes = frame["size"].to_numpy()
        ends, block = np.cumsum(sizes), int(frame["block"].iloc[0])
        times = chosen(int(ends[-1]), block, int(frame["quota"].iloc[0]), seed, f"{group[0]} {group[1]}")
        before = np.concatenate([[0], np.cumsum(times)]) * block

        def taken_up_to(at: np.ndarray) -> np.ndarray:
            return before[at // block] + np.append(times, 0)[at // block] * (at % block)

        spans = [spans_of(b, e, block, times) for b, e in zip((ends - sizes).tolist(), ends.tolist())]
        source = None if group[0] == NO_SOURCE else group[0][1:]
        return frame.assign(source=source, taken=taken_up_to(ends) - taken_up_to(ends - sizes), spans=spans, doc_id=frame["doc_id"].astype("Int64"))[
            ["doc_id", "source", "size", "source_size", "target", "taken", "text_hash", "spans"]]

    return keyed.join(quota, ["__key", "__shard"]).groupBy("__key", "__shard").applyInPandas(
        take, "doc_id bigint, source string, size bigint, source_size bigint, target double, taken bigint, text_hash bigint, spans array<array<bigint>>")


def mix_sources(docs: DataFrame, **settings) -> DataFrame:
    """The words the mix takes of every document; see mix_spans."""
    return mix_spans(docs, **settings).drop("spans", "text_hash")


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray, spans: list[list[int]], times: int) -> bytes:
    """The words that are taken `times` times or more, each run with its own white space, runs joined by a newline."""
    runs: list[list[int]] = []
    for first, last, n in spans:
        if n >= times:
            if runs and runs[-1][1] == first:
                runs[-1][1] = last
            else:
                runs.append([first, last])
    return b"\n".join(data[start[a] : end[b - 1]].tobytes() for a, b in runs)


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of `docs`: a document of which some words are taken n times gives n rows, the first
    with all words taken once or more, the next with those taken twice or more. A row that holds all words keeps its text as
    it is; in a shorter one n_chars follows the text. Rows equal in doc_id, source and text are read as one document held several
    times."""
    names = docs.columns
    spans = mix_spans(docs, **settings).where("taken > 0").select(F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans"))
    once = docs.withColumn("__hash", F.xxhash64(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), "text")).dropDuplicates(["__hash"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part.column("text"))
                words = words_of(texts)
                rows, cut = [], []
                for i, spans_ in enumerate(part.column("__spans").to_pylist()):
                    start, end = (x[words.first[i] : words.first[i + 1]] for x in (words.start, words.end))
                    for times in range(1, max(s[2] for s in spans_) + 1):
                        covered = sum(s[1] - s[0] for s in spans_ if s[2] >= times)
                        rows.append(i)
                        cut.append(None if covered == len(start) else _cut(texts.data, start, end, spans_, times).decode("utf-8", "replace"))
                out = part.select(names).take(pa.array(rows, pa.int64()))
                columns = dict(zip(names, out.columns))
                whole = out.column("text").to_pylist()
                columns["text"] = pa.array([w if c is None else c for w, c in zip(whole, cut)], out.schema.field("text").type)
                if "n_chars" in columns:
                    kept = out.column("n_chars").to_pylist()
                    columns["n_chars"] = pa.array([k if c is None else len(c) for k, c in zip(kept, cut)], out.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], schema=out.schema)

    return once.join(spans, "__hash").drop("__hash").mapInArrow(emit, docs.schema)
