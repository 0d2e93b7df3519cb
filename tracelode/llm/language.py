"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is read as its letters in lower case, everything between them as one space. Each language has a model of `ORDER`
characters; all models lie in arrays sorted by n-gram hash, with the probability of each language beside it. The language of
a text is the one with the lowest cross-entropy per character. A text whose best cross-entropy is far above what texts of
that language have is rejected; the limit is set on labelled texts that the counts have not seen.

Defined results: null texts and texts without a letter are `und` with score 0 and rejected; without any labelled text every
text is `und`; equal cross-entropies go to the language first by name; rows with a null id are scored and may not be learned
from; repeated rows are scored each; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracelode.llm.columns import mix, slices

ORDER = 4
#: Labelled texts learned from: about so many of each language, drawn by a hash of their id, none longer than this.
SAMPLE_TEXTS = 1000
SAMPLE_CHARS = 200_000
#: Every fifth sampled text sets the limit of rejection and is not counted.
CALIBRATE = 5
#: Characters that no model has seen share this many places.
UNSEEN = 50_000
#: A text is rejected beyond this many standard deviations, or twice the largest seen on calibration texts.
LIMIT = 8.0
#: Characters whose evidence the score weighs.
EVIDENCE = 40
UNKNOWN = "und"

_START = 1
_FACTORS = mix(np.arange(11, 11 + ORDER, dtype=np.uint64)) | np.uint64(1)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point: its lower case if it is a letter, else a space; the mark of a text's start stays."""
    table = np.full(0x110000, 0x20, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            lower = c.lower()
            table[i] = ord(lower) if len(lower) == 1 else i
    table[_START] = _START
    return table


class Symbols(NamedTuple):
    """Symbols of several texts with ORDER - 1 start marks before each; text i's own are first[i]:first[i + 1] (marks included)."""

    codes: np.ndarray
    first: np.ndarray


def symbols_of(texts: list[str]) -> Symbols:
    mark = chr(_START) * (ORDER - 1)
    whole = mark + mark.join(t.replace(chr(_START), " ") for t in texts)
    codes = _letters()[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    lengths = np.array([len(t) + ORDER - 1 for t in texts], dtype=np.int64)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0x20) | ((codes[:-1] != 0x20) & (codes[:-1] != _START))
    kept = np.concatenate([[0], np.cumsum(keep)])
    return Symbols(codes[keep], kept[np.concatenate([[0], np.cumsum(lengths)])])


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """The hash of the n-gram that ends at each place from order - 1 on."""
    values = mix(codes.astype(np.uint64) + np.uint64(7))
    n = max(len(codes) - order + 1, 0)
    out = np.full(n, order, dtype=np.uint64)
    for back in range(order):
        out += values[order - 1 - back : order - 1 - back + n] * _FACTORS[back]
    return out


class Hashes:
    """Places of 64-bit hashes in a sorted array, found through the array's own leading bits."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self._shift = np.uint64(64 - max(8, min(22, int(len(keys)).bit_length() + 2)))
        self._begin = np.searchsorted(keys >> self._shift, np.arange((1 << int(64 - self._shift)) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if it is not there."""
        if not len(self.keys):
            return np.full(len(wanted), -1, dtype=np.int64)
        bucket = (wanted >> self._shift).astype(np.int64)
        at, end = self._begin[bucket].astype(np.int64), self._begin[bucket + 1]
        found = np.where((at < end) & (self.keys[np.minimum(at, len(self.keys) - 1)] == wanted), at, -1)
        left = np.flatnonzero((found < 0) & (at + 1 < end))
        step = 1
        while len(left):
            place = at[left] + step
            hit = self.keys[place] == wanted[left]
            found[left[hit]] = place[hit]
            step += 1
            left = left[~hit & (at[left] + step < end[left])]
        return found


class Level(NamedTuple):
    """n-grams of one order: hashes, and for each language the discounted probability (0 if unseen there), the weight that
    the n-gram leaves to shorter contexts when it is itself a context (1 if unseen), both by place."""

    hashes: Hashes
    share: np.ndarray
    back: np.ndarray


class Model:
    """The models of all languages."""

    def __init__(self, languages: list[str], counts: list[dict[str, int]]) -> None:
        self.languages = languages
        tables: list[list[dict[str, float]]] = []
        leaves: list[list[dict[str, float]]] = []
        for grams in counts:
            share, back = [{} for _ in range(ORDER + 1)], [{} for _ in range(ORDER + 1)]
            current = grams
            for order in range(ORDER, 0, -1):
                values = np.fromiter(current.values(), dtype=float, count=len(current))
                once, twice = int((values == 1).sum()), int((values == 2).sum())
                discount = once / (once + 2 * twice) if once else 0.5
                total: dict[str, float] = {}
                kinds: dict[str, int] = {}
                for gram, n in current.items():
                    context = gram[:-1]
                    total[context] = total.get(context, 0) + n
                    kinds[context] = kinds.get(context, 0) + 1
                share[order] = {gram: (n - discount) / total[gram[:-1]] for gram, n in current.items()}
                back[order - 1] = {context: discount * kinds[context] / total[context] for context in total}
                shorter: dict[str, int] = {}
                for gram in current:
                    if order > 1:
                        shorter[gram[1:]] = shorter.get(gram[1:], 0) + 1
                current = shorter
            tables.append(share)
            leaves.append(back)
        self.levels: list[Level] = []
        for order in range(ORDER + 1):
            grams = sorted(set().union(*(t[order].keys() | b[order].keys() for t, b in zip(tables, leaves)))) if tables else []
            codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            hashes = gram_hashes(codes, order)[::order] if order and grams else np.zeros(len(grams), dtype=np.uint64)
            rank = np.argsort(hashes, kind="stable")
            share = np.array([[t[order].get(g, 0.0) for t in tables] for g in grams], dtype=float).reshape(len(grams), len(tables))
            back = np.array([[b[order].get(g, 1.0) for b in leaves] for g in grams], dtype=float).reshape(len(grams), len(tables))
            self.levels.append(Level(Hashes(hashes[rank]), share[rank], back[rank]))
        self.floor = 1.0 / UNSEEN
        whole = self.levels[ORDER]
        grams = sorted(set().union(*(t[ORDER].keys() for t in tables))) if tables else []
        codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, ORDER)
        logs = self._interpolated(codes)
        self.logs = np.zeros_like(whole.share, dtype=np.float32)
        if len(grams):
            self.logs[whole.hashes.find(gram_hashes(codes.ravel(), ORDER)[::ORDER])] = logs
        #: Mean cross-entropy, its variance between texts and per character, and the limit, by language.
        self.mean, self.between, self.within = (np.zeros(len(languages)) for _ in range(3))
        self.limit = np.full(len(languages), LIMIT)

    def _interpolated(self, codes: np.ndarray) -> np.ndarray:
        """log2 of the last symbol's probability after the others, rows by n-gram, columns by language."""
        p = np.full((len(codes), len(self.languages)), self.floor)
        for order in range(1, ORDER + 1):
            gram = np.ascontiguousarray(codes[:, ORDER - order :]).ravel()
            place = self.levels[order].hashes.find(gram_hashes(gram, order)[::order])
            if order == 1:
                context = np.zeros(len(codes), dtype=np.int64) if len(self.levels[0].back) else np.full(len(codes), -1)
            else:
                before = np.ascontiguousarray(codes[:, ORDER - order : -1]).ravel()
                context = self.levels[order - 1].hashes.find(gram_hashes(before, order - 1)[:: order - 1])
            share = np.where(place[:, None] >= 0, self.levels[order].share[place], 0.0) if len(self.levels[order].share) else 0.0
            back = np.where(context[:, None] >= 0, self.levels[order - 1].back[context], 1.0) if len(self.levels[order - 1].back) else 1.0
            p = share + back * p
        return np.log2(p)

    def losses(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of each text by language, their squares summed for the best language, and the number of characters read."""
        symbols = symbols_of(texts)
        at = np.flatnonzero(symbols.codes[ORDER - 1 :] != _START)
        hashes = gram_hashes(symbols.codes, ORDER)[at]
        place = self.levels[ORDER].hashes.find(hashes)
        missing = np.flatnonzero(place < 0)
        own = at[missing][:, None] + np.arange(ORDER)[None, :]
        extra = self._interpolated(symbols.codes[own]) if len(missing) else None
        begin = np.searchsorted(at, symbols.first[:-1])
        count = np.diff(np.append(begin, len(at)))
        bits, squares = np.zeros((len(texts), len(self.languages))), np.zeros((len(texts), len(self.languages)))
        filled = np.flatnonzero(count)
        for language in range(len(self.languages)):
            values = self.logs[np.maximum(place, 0), language].astype(np.float64) if len(self.logs) else np.zeros(len(place))
            if extra is not None:
                values[missing] = extra[:, language]
            if len(filled):
                bits[filled, language] = -np.add.reduceat(values, begin[filled])
                squares[filled, language] = np.add.reduceat(values * values, begin[filled])
        return bits, squares, count

    def calibrate(self, texts: list[str], labels: list[int]) -> None:
        """Sets each language's mean, variances and limit from texts that were not counted."""
        bits, squares, count = self.losses(texts)
        for language in range(len(self.languages)):
            rows = [i for i, label in enumerate(labels) if label == language and count[i]]
            n = count[rows].astype(float)
            if not len(n):
                self.mean[language], self.between[language], self.within[language] = np.log2(UNSEEN), 0.0, 0.0
                continue
            entropy = bits[rows, language] / n
            self.mean[language] = bits[rows, language].sum() / n.sum()
            self.within[language] = max(squares[rows, language].sum() / n.sum() - self.mean[language] ** 2, 0.0)
            self.between[language] = max(np.average((entropy - self.mean[language]) ** 2, weights=n), 1e-4)
            self.limit[language] = max(LIMIT, 2 * float(self.deviation(entropy, n, np.full(len(rows), language)).max()))

    def deviation(self, entropy: np.ndarray, count: np.ndarray, language: np.ndarray) -> np.ndarray:
        return (entropy - self.mean[language]) / np.sqrt(self.between[language] + self.within[language] / np.maximum(count, 1))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and whether the text is rejected."""
        bits, _, count = self.losses(texts)
        letters = np.array([count[i] > 0 and any(c.isalpha() for c in t) for i, t in enumerate(texts)], dtype=bool)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), ~letters
        entropy = bits / np.maximum(count, 1)[:, None]
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(len(texts)), best]
        weight = np.minimum(count, EVIDENCE)[:, None]
        score = 1.0 / np.exp2((lowest[:, None] - entropy) * weight).sum(axis=1)
        rejected = ~letters | (self.deviation(lowest, count, best) > self.limit[best])
        return ([self.languages[b] if has else UNKNOWN for b, has in zip(best, letters)], np.where(letters, score, 0.0),
                np.where(letters, lowest, 0.0), rejected)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: every fifth by checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """The models of a table with doc_id, text and lang. What reaches the driver is bounded by the sample."""
    labelled = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        ~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= sample_chars))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], [])
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, sample_texts / sizes[name]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30))
    kept = labelled.where(draw < share[F.col("lang")] * (1 << 30)).withColumn("test", F.pmod(F.xxhash64("doc_id", F.lit("limit")), F.lit(CALIBRATE)) == 0)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in set(batch.column("lang").to_pylist()):
                texts = [t for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()) if lang == name]
                codes = symbols_of(texts).codes
                at = np.flatnonzero(codes[ORDER - 1 :] != _START)
                if not len(at):
                    continue
                _, first, count = np.unique(gram_hashes(codes, ORDER)[at], return_index=True, return_counts=True)
                wide = np.ascontiguousarray(codes[at[first][:, None] + np.arange(ORDER)[None, :]])
                text = wide.tobytes().decode("utf-32-le", "surrogatepass")
                words = [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(words)), pa.array(words), pa.array(count, pa.int64())], ["lang", "gram", "n"])

    counted = kept.where(~F.col("test")).select("lang", "text").mapInArrow(grams, "lang string, gram string, n bigint")
    counts: dict[str, dict[str, int]] = {name: {} for name in languages}
    for row in counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_batches():
        for name, gram, n in zip(*(row.column(c).to_pylist() for c in ("lang", "gram", "n"))):
            counts[name][gram] = n
    model = Model(languages, [counts[name] for name in languages])
    test = kept.where("test").select("lang", "text").toArrow()
    model.calibrate(test.column("text").to_pylist(), [languages.index(x) for x in test.column("lang").to_pylist()])
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy and rejected of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = shared.value.predict([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x) for x in found)],
                                                 ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, all columns, of texts that are not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rejected = shared.value.predict([t or "" for t in part.column("text").to_pylist()])[3]
                yield part.filter(pa.array(~rejected))

    return docs.mapInArrow(keep, docs.schema)
