"""Token counts of whole texts; huge texts in overlapping chunks whose encodings are spliced where they agree.

Texts of one chunk are counted by the library as they are. A longer one is cut into chunks that start every `chunk`
characters and run `overlap` characters into the next; chunks are dealt to tasks by themselves and encoded with offsets.
Neighbours meet in the overlap: a cut there is stable if both encodings hold the same two tokens, one on either side of it, at
the same places, and both or neither split words there. The count is that of all chunks less what lies beyond their cuts.

Why such a cut is one of the whole text's encoding: byte-pair merges go by priority, then place, so until something merges
across the cut, the left side evolves as in the left chunk and the right side as in the right one. What could merge across it
are the symbols of the two tokens next to it; their insides evolve alike in both chunks and in the whole, and in the chunks
they do not merge. Words are found from left to right without regard to what lies before the last one, so a common split is
a true one, and within a word both chunks run to the same end. Special strings are found before words: no cut lies so near an
end of the overlap that one chunk may see a part of such a string only. A character that may be composed with the one before
it is no place for a cut.

Texts with an overlap that agrees nowhere are cut anew with chunks and overlaps twice as long, until one chunk holds all of it.

Defined results: a null text is empty (0 tokens); a null id is kept; repeated rows are counted each; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracelode.llm.columns import slices
from tracelode.llm.stored import stored

#: Characters from one chunk's start to the next, and how far a chunk runs into the next.
CHUNK, OVERLAP = 1 << 15, 1 << 8
#: Tokens that make a document too long.
LIMIT = 2048


class Token(NamedTuple):
    """A token's id, its characters in the text, and whether it goes on in the word of the token before."""

    id: int
    start: int
    end: int
    joined: bool


#: Words whose counts a task keeps: those met lately, and as many of before until they are met again.
KEPT_WORDS = 500_000
#: str.split() splits here; not every splitter of a tokenizer does.
_SEPARATORS = re.compile("[\x1c-\x1f]")


class Library:
    """A file of the tokenizers library.

    Where the file's splitter drops white space and its vocabulary marks the ends of words, nothing reaches over white space, so
    the count of a text is that of its words, and words met before are looked up."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        added = self._tokenizer.get_added_tokens_decoder().values()
        #: Characters on either side of a place that decide whether a special string or a word's short ending covers it.
        self.sight = max([4, *(len(t.content) for t in added)])
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        splitter = form.get("pre_tokenizer") or {}
        splits = [p for p in splitter.get("pretokenizers", [splitter]) if p.get("type") == "Split"]
        dropped = any(p["behavior"] == "Removed" and p["invert"] and "\\s" in p["pattern"].get("Regex", "") and " ?" not in p["pattern"]["Regex"] for p in splits)
        alone = not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added)
        self._by_word = bool(dropped and alone and form["model"].get("end_of_word_suffix"))
        self._known: dict[str, int] = {}
        self._before: dict[str, int] = {}

    def _encoded(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self._by_word:
            return self._encoded(texts)
        split = [None if _SEPARATORS.search(text) else text.split() for text in texts]
        wanted: set[str] = set()
        for words in split:
            wanted.update(words or ())
        if len(self._known) + len(wanted) > KEPT_WORDS:
            self._known, self._before = {}, self._known
        new = wanted.difference(self._known)
        back = new.intersection(self._before)
        self._known.update((word, self._before[word]) for word in back)
        new = list(new - back)
        self._known.update(zip(new, self._encoded(new)))
        count = self._known.__getitem__
        return [self._encoded([text])[0] if words is None else sum(map(count, words)) for text, words in zip(texts, split)]

    def ends(self, text: str, start: int, head: int, tail: int) -> tuple[int, list[Token], list[Token]]:
        """The number of tokens, those that begin before place `head`, and those from the last before place `tail` on. Places
        of the tokens count from `start`."""
        found = self._tokenizer.encode(text, add_special_tokens=False)
        ids, begin = found.ids, lambda k: found.token_to_chars(k)[0]
        indices = range(len(ids))

        def token(k: int) -> Token:
            low, high = found.token_to_chars(k)
            word = found.token_to_word(k)
            return Token(ids[k], low + start, high + start, k > 0 and word is not None and word == found.token_to_word(k - 1))

        first, last = bisect_left(indices, head, key=begin), bisect_left(indices, tail, key=begin)
        return len(ids), [token(k) for k in indices[:first]], [token(k) for k in indices[max(last - 1, 0) :]]


@lru_cache(maxsize=2)
def library(path: str) -> Library:
    return Library(path)


def begins(character: str) -> bool:
    """Whether text before it cannot change what the character is composed to."""
    return unicodedata.category(character)[0] != "M" and not "ᅠ" <= character <= "ᇿ"


def stable_cut(left: list[Token], right: list[Token], letters: str, base: int, sight: int) -> tuple[int, int] | None:
    """How many tokens of the left chunk lie behind the first stable cut, and how many of the right one before it. `letters`
    is the overlap, which starts at place `base` of the text; a cut keeps `sight` characters off both its ends."""
    at = {right[k].start: k for k in range(1, len(right)) if right[k].start >= right[k - 1].end}
    for k in range(1, len(left)):
        before, after = left[k - 1], left[k]
        place = after.start - base
        if place < sight or place + sight > len(letters) or after.start < before.end or after.end == after.start:
            continue
        j = at.get(after.start)
        if j is not None and right[j - 1][:3] == before[:3] and right[j] == after and begins(letters[place]):
            return len(left) - k, j
    return None


TOKENS = "array<struct<id: int, start: bigint, end: bigint, joined: boolean>>"
_TOKENS = pa.list_(pa.struct([("id", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("joined", pa.bool_())]))
CHUNKS = "key bigint, number bigint, start bigint, last boolean, text string"
ENDS = f"key bigint, edge bigint, tokens bigint, head {TOKENS}, tail {TOKENS}, letters string"


def _chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """The chunks of (key, text), in rows of their own."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        for batch in batches:
            for part in slices(batch, "text"):
                for key, text in zip(*(part.column(c).to_pylist() for c in ("key", "text"))):
                    rows, size = [], 0
                    for number, start in enumerate(range(0, max(len(text), 1), chunk)):
                        rows.append((key, number, start, start + chunk >= len(text), text[start : start + chunk + overlap]))
                        size += chunk + overlap
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return texts.select("key", "text").mapInArrow(cut, CHUNKS)


def _ends(chunks: DataFrame, tokenizer: str, chunk: int, overlap: int) -> DataFrame:
    """Two rows a chunk: its count and the tokens that lie in the overlap with the one before (edge: its number), and those in
    the overlap with the one behind."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), _TOKENS, _TOKENS, pa.string())
        names = [c.split()[0] for c in ENDS.split(f" {TOKENS}")[0].split(", ")] + ["tail", "letters"]
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for key, number, start, last, text in zip(*(c.to_pylist() for c in part.columns)):
                    size, head, tail = library(tokenizer).ends(text, start, overlap if number else 0, len(text) if last else chunk)
                    rows.append((key, number, size, [t._asdict() for t in head] if number else None, None, text[:overlap] if number else None))
                    if not last:
                        rows.append((key, number + 1, 0, None, [t._asdict() for t in tail], None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names)

    return chunks.mapInArrow(encode, ENDS)


EDGES = "key bigint, tokens bigint, aligned boolean"


def _edges(ends: DataFrame, tokenizer: str, chunk: int) -> DataFrame:
    """One row an edge: tokens of the chunk that starts there, less those beyond the cut on both sides."""
    met = ends.groupBy("key", "edge").agg(F.sum("tokens").alias("tokens"), *[F.max_by(c, F.col(c).isNotNull()).alias(c) for c in ("head", "tail", "letters")])

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, edge, tokens, head, tail, letters in zip(*(c.to_pylist() for c in batch.columns)):
                if head is None or tail is None:
                    rows.append((key, tokens, edge == 0))
                    continue
                cut = stable_cut([Token(**t) for t in tail], [Token(**t) for t in head], letters, edge * chunk, library(tokenizer).sight)
                rows.append((key, tokens - sum(cut) if cut else 0, cut is not None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int64(), pa.bool_()))],
                                             ["key", "tokens", "aligned"])

    return met.select("key", "edge", "tokens", "head", "tail", "letters").mapInArrow(splice, EDGES)


COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint"


def spliced_counts(texts: DataFrame, tokenizer: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key and n_tokens of (key, text), by chunks; keys differ and texts are no nulls. Runs a job a round."""
    done, longest = None, texts.agg(F.max(F.length("text"))).first()[0] or 0
    while True:
        ends = _ends(_chunks(texts, chunk, overlap).repartition("key", "number"), tokenizer, chunk, overlap)
        counts = stored(_edges(ends, tokenizer, chunk).groupBy("key").agg(F.sum("tokens").alias("n_tokens"), F.every("aligned").alias("aligned")), "spliced")
        good = counts.where("aligned").select("key", "n_tokens")
        done = good if done is None else done.unionByName(good)
        if chunk >= longest or counts.where("not aligned").isEmpty():
            return done
        texts = texts.join(counts.where("not aligned").select("key"), "key", "left_semi")
        chunk, overlap = 2 * chunk, 2 * overlap


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every text. `tokenizer` is the path of its file."""
    if not 0 < overlap <= chunk:
        raise ValueError("an overlap is at most as long as a chunk")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    small = F.length("text") <= chunk + overlap

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = library(tokenizer).counts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    plain = texts.where(small).select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text").mapInArrow(count, COUNTS)
    huge = stored(texts.where(~small).withColumn("key", F.monotonically_increasing_id()), "huge")
    spliced = huge.select("key", "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes")).join(spliced_counts(huge, tokenizer, chunk, overlap), "key")
    counts = plain.unionByName(spliced.select("doc_id", "n_bytes", "n_tokens"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
