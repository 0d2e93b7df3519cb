"""Matching of texts to a catalogue by shared words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracelode.functions.once import with_once
from tracelode.functions.text import token_rows, tokens
from tracelode.session import cut_lineage, written

# The command catalogue (name, description, examples).
COMMANDS = [
    ("db.migrate", "Run database migrations",
     ["run migrations", "migrate database", "apply migrations", "update database schema"]),
    ("db.ping", "Check database connectivity",
     ["ping database", "check database connection", "is database running", "test database"]),
    ("db.query", "Execute a SQL query", ["run query", "execute sql", "query database"]),
    ("db.shell", "Start interactive SQL shell (pure Go, no psql required)",
     ["open database shell", "start sql shell", "database console", "psql shell"]),
    ("infra.start", "Start infrastructure services (postgres, jaeger, prometheus, otel-collector)",
     ["start infrastructure", "start the services", "bring up infrastructure", "start postgres and jaeger",
      "spin up the database", "launch the stack"]),
    ("infra.stop", "Stop infrastructure services",
     ["stop infrastructure", "stop the services", "bring down infrastructure", "shut down the stack",
      "stop everything"]),
    ("infra.status", "Show status of infrastructure services",
     ["show infrastructure status", "what services are running", "check service status", "are services healthy",
      "list running services"]),
    ("infra.logs", "Show logs from infrastructure services",
     ["show logs", "show postgres logs", "get jaeger logs", "view service logs"]),
    ("infra.clean", "Remove all infrastructure containers, volumes, and networks",
     ["clean infrastructure", "remove all containers", "destroy infrastructure", "clean up everything"]),
    ("obs.verify", "Verify observability stack is healthy (Jaeger, Prometheus)",
     ["verify observability", "check observability health", "is tracing working", "verify jaeger and prometheus",
      "health check observability"]),
    ("obs.urls", "Show URLs for observability services",
     ["show observability urls", "where is jaeger", "prometheus url", "get service urls"]),
    ("obs.services", "List available services in Jaeger",
     ["list traced services", "show jaeger services", "what services are being traced"]),
    ("obs.metrics", "Query Prometheus metrics", ["query metrics", "get prometheus metrics", "show metrics"]),
    ("lint.check", "Run static analysis checks on Go code (uses go/analysis)",
     ["lint the code", "check for errors", "run linter", "static analysis", "find bugs"]),
    ("fmt.check", "Check if Go code is properly formatted",
     ["check formatting", "is code formatted", "format check"]),
    ("fmt.fix", "Format Go code (pure Go, no gofmt binary required)",
     ["format code", "fix formatting", "gofmt", "format go files"]),
]
# Services and words looked for in a text, in list order.
SERVICES = ["postgres", "jaeger", "prometheus", "otel", "fluent"]
DETACHED_WORDS = ["detach", "background", "-d"]
VOLUME_WORDS = ["volume", "remove volume", "-v"]
# Fixed value: least confidence of a match that needs no second opinion.
THRESHOLD = 0.7


def command_catalogue(spark: SparkSession) -> DataFrame:
    """The fixed catalogue as (entry, text)."""
    rows = [(name, " ".join([name, description, *examples])) for name, description, examples in COMMANDS]
    return spark.createDataFrame(rows, "entry string, text string")


# Catalogue entries scored in one pass over the texts; a larger catalogue takes more passes, so no broadcast grows with it.
ENTRIES_PER_PASS = 4096
# Scores held at a time in a task.
SCORES = 1 << 20
# Tokens counted at a time in a task, about: a batch of long texts has many times as many as one of short texts.
TOKENS = 1 << 18


def tokenize(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(I) One row per token of a text."""
    return token_rows(df, key, text)


def _pieces(batches: Iterable[pa.RecordBatch], most: int = TOKENS) -> Iterator[pa.RecordBatch]:
    """The rows of batches (tokens, a list, among their columns) in pieces of at most `most` tokens, or one row."""
    for batch in batches:
        end = np.cumsum(pc.list_value_length(batch.column("tokens")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def token_counts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, token, n): times each token is in a text; one row of ``df`` is one text.

    Counted where the texts are read, by numbers for the tokens of a piece of a batch, so nothing is
    shuffled. Where several rows make one text, add up n by (key, token) afterwards.
    """
    kind = df.schema[key].dataType.simpleString()

    def count(batches):
        for batch in _pieces(batches):
            column = batch.column("tokens")
            words = column.flatten().dictionary_encode()
            row, kinds = pc.list_parent_indices(column).to_numpy().astype(np.int64), max(len(words.dictionary), 1)
            pairs, n = np.unique(row * kinds + words.indices.to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(pairs // kinds)), words.dictionary.take(pa.array(pairs % kinds)), pa.array(n, pa.int64())],
                                             names=[key, "token", "n"])

    return _with_tokens(df, key, text).mapInArrow(count, f"`{key}` {kind}, token string, n bigint")


def catalogue_index(catalogue: DataFrame) -> DataFrame:
    """(token, entry, n_entry, norm2_entry) of a catalogue (entry, text); norm2_entry is the squared norm of the entry."""
    counts = token_counts(catalogue, "entry").groupBy("entry", "token").agg(F.sum("n").alias("n_entry"))
    square = F.sum(F.col("n_entry") * F.col("n_entry")).over(Window.partitionBy("entry"))
    return counts.withColumn("norm2_entry", square)


class _Words:
    """Token lists of a batch as (row, code, n) over a sorted vocabulary; other tokens are left out."""

    def __init__(self, column: pa.Array, vocabulary: pa.Array) -> None:
        codes = pc.index_in(column.flatten(), value_set=vocabulary)
        row = pc.list_parent_indices(column).to_numpy().astype(np.int64)
        known = codes.is_valid().to_numpy(zero_copy_only=False)
        both = row[known] * len(vocabulary) + codes.drop_null().to_numpy().astype(np.int64)
        pairs, self.n = np.unique(both, return_counts=True)
        self.row, self.code = pairs // max(len(vocabulary), 1), pairs % max(len(vocabulary), 1)
        self.norm2 = np.bincount(self.row, weights=self.n.astype(float) ** 2, minlength=len(column))


def _with_tokens(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.select(key, F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("tokens"))


#: Words of a vocabulary that is broadcast. A larger one is joined.
VOCABULARY = 1 << 20


def term_vectors(texts: DataFrame, catalogue: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(I) Term counts inside the catalogue's vocabulary and their unit-length weights; one row of ``texts`` is one text.

    Every text is weighed inside its row against a vocabulary that is broadcast. One of more than VOCABULARY words is joined
    with the counts instead, and lengths are added up by text.
    """
    known = tokenize(catalogue, "entry").select("token").distinct()
    words = sorted(r.token for r in known.limit(VOCABULARY + 1).collect())
    if len(words) > VOCABULARY:
        counts = token_counts(texts, key, text).join(known, "token")
        squares = counts.groupBy(F.col(key).alias("_k")).agg(F.sum(F.col("n") * F.col("n")).alias("_norm2"))
        weight = (F.col("n") / F.sqrt(F.col("_norm2").cast("double"))).alias("weight")
        return counts.join(squares, F.col(key).eqNullSafe(F.col("_k"))).select(key, "token", "n", weight)
    shared = texts.sparkSession.sparkContext.broadcast(pa.array(words, pa.string()))
    kind = texts.schema[key].dataType.simpleString()

    def weigh(batches):
        for batch in _pieces(batches):
            found = _Words(batch.column("tokens"), shared.value)
            weight = found.n / np.sqrt(found.norm2[found.row])
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(found.row)), shared.value.take(pa.array(found.code)), pa.array(found.n, pa.int64()), pa.array(weight)],
                names=[key, "token", "n", "weight"])

    return _with_tokens(texts, key, text).mapInArrow(weigh, f"`{key}` {kind}, token string, n bigint, weight double")


def _score(tokenised: DataFrame, index: list, key: str, kind: str) -> DataFrame:
    """Best of some entries per text (key, tokens), entries in order of name."""
    entries = sorted({(r.entry, r.norm2_entry) for r in index})
    number = {entry: i for i, (entry, _) in enumerate(entries)}
    words = sorted({r.token for r in index})
    code = {word: i for i, word in enumerate(words)}
    postings = np.array(sorted((code[r.token], number[r.entry], r.n_entry) for r in index), dtype=np.int64).reshape(-1, 3)
    begin = np.searchsorted(postings[:, 0], np.arange(len(words) + 1))
    shared = tokenised.sparkSession.sparkContext.broadcast(
        (pa.array(words, pa.string()), postings, begin, np.array([n for _, n in entries], dtype=float), [e for e, _ in entries]))

    def best(batches):
        vocabulary, rows, first, norms, names = shared.value
        step = max(1, SCORES // max(len(names), 1))
        for whole in _pieces(batches):
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                found = _Words(batch.column("tokens"), vocabulary)
                count = first[found.code + 1] - first[found.code]
                place = np.repeat(first[found.code] - np.cumsum(count) + count, count) + np.arange(count.sum())
                cell = np.repeat(found.row, count) * len(names) + rows[place, 1]
                dot = np.bincount(cell, weights=np.repeat(found.n, count) * rows[place, 2], minlength=batch.num_rows * len(names))
                dot = dot.astype(float).reshape(batch.num_rows, len(names))
                scores = np.divide(dot, np.sqrt(found.norm2[:, None] * norms[None, :]), out=np.zeros_like(dot), where=dot > 0)
                top = scores.argmax(axis=1) if len(names) else np.zeros(batch.num_rows, np.int64)
                score = scores[np.arange(len(top)), top] if len(names) else np.zeros(len(top))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key), pa.array([names[i] if s > 0 else None for i, s in zip(top, score)]), pa.array(score)], names=[key, "entry", "confidence"])

    key_kind = tokenised.schema[key].dataType.simpleString()
    return tokenised.mapInArrow(best, f"`{key}` {key_kind}, entry {kind}, confidence double")


def intent_match(texts: DataFrame, catalogue: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(I) Best catalogue entry per text and its confidence (cosine of term counts); one row of ``texts`` is one text.

    Ties go to the first entry by name; a text without a known word has no entry and
    confidence 0. Texts are scored where they are read, against a bounded part of the
    catalogue at a time; only with several parts are their tokens written, to be cut out once, and the best of them found by
    a group.
    Dot products and norms are whole numbers, so scores do not depend on the order of
    addition.
    """
    index = cut_lineage(catalogue_index(catalogue))
    kind = catalogue.schema["entry"].dataType.simpleString()
    parts = max(1, -(-index.select("entry").distinct().count() // ENTRIES_PER_PASS))
    part = F.pmod(F.xxhash64("entry"), F.lit(parts))
    tokenised = _with_tokens(texts, key, text)
    if parts > 1:
        tokenised = written(tokenised, "tokens")
    found = [_score(tokenised, index.where(part == i).collect(), key, kind) for i in range(parts)]
    if parts == 1:
        return found[0]
    order = F.struct(-F.col("confidence"), F.col("entry").isNull(), "entry")
    return reduce(DataFrame.unionAll, found).groupBy(key).agg(
        F.min_by("entry", order).alias("entry"), F.max("confidence").alias("confidence"))


def intent_route(matches: DataFrame, threshold: float = THRESHOLD, second_opinion: bool = False) -> DataFrame:
    """(I) Where the answer to a text comes from; asking a language model is only marked."""
    known = F.col("entry").isNotNull()
    source = (
        F.when(known & (F.col("confidence") >= threshold), "embeddings")
        .when(F.lit(second_opinion), "llm")
        .when(known, "embeddings")
        .otherwise("unmatched")
    )
    return matches.withColumn("source", source)


def _holds(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def extract_slots(matches: DataFrame, parameters: DataFrame, text: str = "text") -> DataFrame:
    """(I) Parameter values named in a text, only for parameters its command has.

    ``matches`` has ``entry`` and the text, ``parameters`` has (command, param, type).
    """
    def has(name: str, kind: str) -> Column:
        return F.bool_or((F.col("param") == name) & (F.col("type") == kind))

    flags = parameters.groupBy(F.col("command").alias("entry")).agg(
        has("service", "string").alias("has_service"), has("detached", "bool").alias("has_detached"),
        has("removeVolumes", "bool").alias("has_volumes"))
    lowered = F.lower(F.col(text))
    service = F.coalesce(*[F.when(lowered.contains(s), s) for s in SERVICES])
    joined = matches.join(flags, "entry", "left")
    return joined.withColumns({
        "service": F.when(F.col("has_service"), service),
        "detached": F.when(F.col("has_detached") & _holds(lowered, DETACHED_WORDS), True),
        "remove_volumes": F.when(F.col("has_volumes") & _holds(lowered, VOLUME_WORDS), True),
    }).drop("has_service", "has_detached", "has_volumes")
