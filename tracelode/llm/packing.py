"""Packing: tokenised documents into fixed windows by best-fit decreasing.

A document longer than a window is first cut into full windows; what is left of it, and every shorter document, is one
piece. Pieces are dealt to groups of a few thousand by a hash of their document, and each group is packed by itself: longest
piece first, each into the fullest window that still has room. A segment tree over the remaining capacities finds that window.

Defined results: null and empty texts hold the end token only; rows with a null id are packed under a null id; repeated rows
are packed each; equal lengths are taken by (doc_id, start); an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tracelode.llm.columns import slices

WINDOW = 2048
END_ID = 1
#: Pieces of one group, about; bounds the memory of a packing task.
GROUP = 4096
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PACKED = f"{PIECES}, sequence_id bigint, offset bigint, sequence_tokens bigint"

#: Bytes of text whose words are looked up together.
SLICE = 1 << 22
#: Behind letters, a run of these is one token of the vocabulary's splitter. The apostrophe is not: 's and the like are cut off.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_AT_END = f"(?P<tail>[{''.join(chr(92) + c for c in _TAIL)}]*)$"
#: Letters up to here are lower-cased one by one.
_PLAIN = r"^[\x{0}-\x{24F}]*$"


class Pool(NamedTuple):
    """Ids of several strings behind each other, and how many each has."""

    ids: np.ndarray
    length: np.ndarray


class WordIds:
    """Token ids of texts, made once for each different word of a slice.

    The vocabulary's splitter never joins what white space separates, so a text's ids are those of its words. A word of
    plain letters and a tail of ASCII punctuation is made of two parts; all letter parts are encoded together.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        ends = np.zeros(max(vocabulary.values()) + 3, dtype=bool)
        ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        if not ends.any():
            raise ValueError(f"{path} marks no ends of words")
        self._ends = ends

    def _each(self, words: list[str]) -> Pool:
        found = [e.ids for e in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return Pool(np.fromiter(chain.from_iterable(found), dtype="<u4"), np.array([len(f) for f in found], dtype=np.int64))

    def _together(self, words: list[str]) -> Pool:
        """Of words of letters: one text holds them all, and ids that end a word part them."""
        ids = np.array(self._tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self._ends[ids]) + 1
        whole = len(cuts) == len(words) and (not len(cuts) or cuts[-1] == len(ids))
        return Pool(ids, np.diff(cuts, prepend=0)) if whole else self._each(words)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, and where each text begins and the last one ends; null is empty."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        words = lists.flatten().dictionary_encode()
        kinds, which = words.dictionary, words.indices.to_numpy()
        plain = pc.utf8_rtrim(kinds, _TAIL)
        ascii_ = pc.string_is_ascii(plain)
        simple = pc.and_(pc.utf8_is_alpha(plain), pc.or_(ascii_, pc.match_substring_regex(plain, _PLAIN)))
        letters = pc.if_else(ascii_, pc.ascii_lower(plain), plain).filter(simple).dictionary_encode()
        tails = pc.struct_field(pc.extract_regex(kinds.filter(simple), _AT_END), "tail").dictionary_encode()
        pools = [self._together(letters.dictionary.to_pylist()), self._each(tails.dictionary.to_pylist()), self._each(kinds.filter(pc.invert(simple)).to_pylist())]
        ids, length = np.concatenate([p.ids for p in pools]), np.concatenate([*(p.length for p in pools), [0]])
        first = np.cumsum(length) - length
        # Each word is two parts: letters and tail, or itself and nothing.
        is_simple = simple.to_numpy(zero_copy_only=False)
        parts = np.full((len(kinds), 2), len(length) - 1, dtype=np.int64)
        parts[is_simple, 0], parts[is_simple, 1] = letters.indices.to_numpy(), len(pools[0].length) + tails.indices.to_numpy()
        parts[~is_simple, 0] = len(pools[0].length) + len(pools[1].length) + np.arange(len(pools[2].length))
        all_parts = parts[which].ravel()
        sizes = length[all_parts]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        place = np.repeat(first[all_parts] - ends[:-1], sizes) + np.arange(ends[-1])
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return ids[place], ends[2 * offsets]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: full windows, then the rest, with the checksum of their ids. `tokenizer` is a file's path."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows: tuple[list, list, list, list, list] = ([], [], [], [], [])
                found, starts = ids.column(part.column("text"))
                # Every text's ids, and the end id behind them.
                marked = np.empty(len(found) + part.num_rows, dtype="<u4")
                ends = starts[1:] + np.arange(part.num_rows)
                text = np.ones(len(marked), dtype=bool)
                text[ends] = False
                marked[text], marked[ends] = found, end_id
                data, begin = memoryview(marked.tobytes()), 0
                for doc_id, stop in zip(part.column("doc_id").to_pylist(), (ends + 1).tolist()):
                    for at in range(begin, stop, window):
                        piece = data[4 * at : 4 * min(at + window, stop)]
                        for column, value in zip(rows, (doc_id, at - begin, len(piece) // 4, zlib.crc32(piece), stop - begin)):
                            column.append(value)
                    begin = stop
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(cut, PIECES)


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each length, lengths given in falling order.

    Leaf c of the tree counts the open windows with c places left, a node those of its leaves, so the tightest window that
    holds a piece is the first occupied leaf at or after its length."""
    leaves = 1 << window.bit_length()
    count = [0] * (2 * leaves)
    open_windows: list[list[int]] = [[] for _ in range(window + 1)]

    def add(left: int, change: int) -> None:
        node = leaves + left
        while node:
            count[node] += change
            node >>= 1

    def tightest(length: int) -> int:
        node = leaves + length
        if count[node]:
            return length
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < leaves:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - leaves
            node >>= 1
        return -1

    numbers, offsets, windows = [], [], 0
    for length in lengths:
        left = tightest(length)
        if left < 0:
            number, left, windows = windows, window, windows + 1
        else:
            number = open_windows[left].pop()
            add(left, -1)
        numbers.append(number)
        offsets.append(window - left)
        if left > length:
            open_windows[left - length].append(number)
            add(left - length, 1)
    return numbers, offsets


def pack(pieces: DataFrame, groups: int, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id, offset and the sequence's filled length to pieces (columns of PIECES), packed in `groups` groups."""

    def group(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        numbers, offsets = best_fit(frame["length"].tolist(), window)
        frame = frame.assign(sequence_id=np.array(numbers, dtype=np.int64) + (int(key[0]) << 32), offset=np.array(offsets, dtype=np.int64))
        frame["sequence_tokens"] = frame.groupby("sequence_id")["length"].transform("sum")
        return frame[[c.split()[0] for c in PACKED.split(", ")]].astype({"doc_id": "Int64"})

    dealt = F.pmod(F.xxhash64("doc_id", "start", "doc_tokens"), F.lit(groups))
    return pieces.groupBy(dealt.alias("__group")).applyInPandas(group, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """Every document's pieces with their places. The number of groups follows the number of documents."""
    groups = max(1, docs.count() // group)
    return pack(token_pieces(docs, tokenizer, window, end_id), groups, window)
