"""Nearest vectors, exact and by cluster lists."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tracelode.functions.vectors import l2
from tracelode.session import cut_lineage

# Queries that are broadcast to where the vectors are. More are dealt to blocks and meet the vectors there.
QUERIES_PER_SCAN = 1024
# Rows of a block of vectors, and of queries. A task holds one of each.
VECTOR_BLOCK, QUERY_BLOCK = 1 << 16, 1 << 12
# Vectors compared at once within a task.
STEP = 1 << 11
# Rows that lists and codes are fitted on, at most; all rows are assigned and searched.
FIT_ROWS = 20_000
# Fixed value: number of cluster lists.
LISTS = 100
# Scores closer than this are ties, broken by id, so the order does not depend on the
# order in which a processor adds up products.
DIGITS = 9


def _matrix(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of an Arrow list column have ``dim`` values, none of them null, and those rows as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    good = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    rows = column.filter(good).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = good.to_numpy(zero_copy_only=False).astype(bool)
    whole = ~np.isnan(rows).any(axis=1)
    good[good] = whole
    return good, rows[whole]


def _distances(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each query (row) to each vector (column)."""
    dots = queries @ vectors.T
    q2, v2 = (queries ** 2).sum(1)[:, None], (vectors ** 2).sum(1)[None, :]
    if metric == "l2":
        return np.sqrt(np.maximum(q2 - 2 * dots + v2, 0))
    norms = np.sqrt(q2) * np.sqrt(v2)
    return 1 - np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)


class _Best:
    """The k nearest found so far, per query: smallest rounded distance first, then id."""

    def __init__(self, query_ids: np.ndarray, k: int) -> None:
        self.query_ids, self.k = query_ids, k
        self.ids = [np.zeros(0, np.int64) for _ in query_ids]
        self.distances = [np.zeros(0) for _ in query_ids]

    def add(self, ids: np.ndarray, distances: np.ndarray) -> None:
        """Distances by query and vector; infinite ones are no candidates."""
        distances = np.round(distances, DIGITS)
        worst = np.array([d[-1] if len(d) == self.k else np.inf for d in self.distances])
        near = (distances <= worst[:, None]) & np.isfinite(distances)
        for row in np.flatnonzero(near.any(1)):
            own = np.flatnonzero(near[row])
            all_ids = np.concatenate([self.ids[row], ids[own]])
            all_distances = np.concatenate([self.distances[row], distances[row, own]])
            first = np.lexsort((all_ids, all_distances))[: self.k]
            self.ids[row], self.distances[row] = all_ids[first], all_distances[first]

    def rows(self) -> pa.RecordBatch:
        counts = [len(x) for x in self.ids]
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int64)
        distances = np.concatenate(self.distances) if self.distances else np.zeros(0)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.query_ids, counts), pa.int64()), pa.array(ids, pa.int64()), pa.array(distances)],
                                          names=["query_id", "vec_id", "distance"])


TOP = "query_id bigint, vec_id bigint, distance double"


def _ranked(top: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return top.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def _strict(df: DataFrame, column: str, dim: int) -> DataFrame:
    """Rows with a vector; one of another length is an error."""
    wrong = F.raise_error(F.concat(F.lit(f"{column} must have {dim} values, not "), F.size(column).cast("string")))
    kept = df.where(F.col(column).isNotNull())
    return kept.withColumn(column, F.when(F.size(column) == dim, F.col(column)).otherwise(wrong.cast(df.schema[column].dataType)))


def _blocks(df: DataFrame, rows: int) -> int:
    return max(1, math.ceil(df.count() / rows))


def _deal(df: DataFrame, key: str, count: int, name: str) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(count)).cast("int"))


def _everywhere(df: DataFrame, count: int, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def _in_blocks(vectors: DataFrame, queries: DataFrame, keys: list[str], k: int, distances) -> DataFrame:
    """The k nearest within each block of vectors for each block of queries. Blocks meet in one shuffle by `keys`, with which
    both sides are dealt; `distances` takes the Arrow tables of both, the vectors' in steps."""
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        best = _Best(right.column("query_id").to_numpy(), k)
        asked = distances.asked(right) if right.num_rows else None
        for start in range(0, left.num_rows if right.num_rows else 0, STEP):
            step = left.slice(start, STEP).combine_chunks()
            best.add(step.column("vec_id").to_numpy(), distances.between(asked, step))
        return pa.Table.from_batches([best.rows()])

    return vectors.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(search, TOP)


class _Exact:
    """Distances of whole vectors. One of another length has cosine 0, so distance 1."""

    def __init__(self, metric: str, dim: int) -> None:
        self.metric, self.dim = metric, dim

    def matrix(self, rows: list) -> np.ndarray:
        return np.array([r if len(r) == self.dim and None not in r else [0.0] * self.dim for r in rows], dtype=np.float64)

    def asked(self, queries: pa.Table) -> np.ndarray:
        return self.matrix(queries.column("query").to_pylist())

    def between(self, asked: np.ndarray, vectors) -> np.ndarray:
        good, matrix = _matrix(vectors.column("embedding"), self.dim)
        # A query of another length is all zeros here, which has cosine 0 too.
        distances = np.ones((len(asked), len(good)))
        distances[:, good] = _distances(asked, matrix, self.metric)
        return distances


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str, dim: int) -> DataFrame:
    """Exact k nearest of ``vectors`` (vec_id, embedding) for ``queries`` (query_id, query).

    A few queries are sent to where the vectors are: a task keeps a running k best over its batches and sends them once.
    Many are dealt to blocks, vectors too, and each block of one meets each of the other; so any number is one plan.
    """
    vectors, queries = vectors.select("vec_id", "embedding"), queries.select("query_id", "query")
    if metric == "l2":
        vectors, queries = _strict(vectors, "embedding", dim), _strict(queries, "query", dim)
    vectors = vectors.where("embedding is not null and vec_id is not null")
    queries = queries.where("query is not null and query_id is not null")
    exact = _Exact(metric, dim)
    rows = queries.limit(QUERIES_PER_SCAN + 1).collect()
    if len(rows) > QUERIES_PER_SCAN:
        query_blocks, vector_blocks = _blocks(queries, QUERY_BLOCK), _blocks(vectors, VECTOR_BLOCK)
        left = _everywhere(_deal(vectors, "vec_id", vector_blocks, "_v"), query_blocks, "_q")
        right = _everywhere(_deal(queries, "query_id", query_blocks, "_q"), vector_blocks, "_v")
        return _ranked(_in_blocks(left, right, ["_v", "_q"], k, exact), k)
    shared = vectors.sparkSession.sparkContext.broadcast(
        (np.array([r.query_id for r in rows], dtype=np.int64), exact.matrix([r.query for r in rows]).reshape(len(rows), dim)))

    def scan(batches):
        query_ids, asked = shared.value
        best = _Best(query_ids, k)
        for batch in batches:
            best.add(batch.column("vec_id").to_numpy(), exact.between(asked, batch))
        yield best.rows()

    return _ranked(vectors.mapInArrow(scan, TOP) if rows else vectors.sparkSession.createDataFrame([], TOP), k)


def knn_cosine(vectors: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """(S) Exact k nearest by cosine distance: (query_id, rank, vec_id, distance).

    Vectors of another length than ``dim`` have cosine 0, so distance 1; null ones are not found.
    """
    return _nearest(vectors, queries, k, "cosine", dim)


def knn_l2(vectors: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """(S) Exact k nearest by Euclidean distance. A vector of another length is an error; null ones are not found."""
    return _nearest(vectors, queries, k, "l2", dim)


def train_lists(vectors: DataFrame, lists: int = LISTS, seed: int = 42, share: float = 1.0) -> np.ndarray:
    """(S) Centres of the cluster lists. ``share`` below 1 trains on part of the rows; all are searched."""
    points = vectors if share >= 1 else vectors.sample(share, seed=seed)
    features = points.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return np.array(KMeans(k=lists, seed=seed, maxIter=10).fit(features).clusterCenters())


def assign_lists(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds ``list_id``, the nearest centre (the first of equally near ones). Null vectors are left out, one of another
    length is an error. Written partitioned by ``list_id``, a search reads its lists only."""
    dim = centres.shape[1]
    rows = _strict(vectors, "embedding", dim)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([*rows.schema.fields, T.StructField("list_id", T.IntegerType())])

    def assign(batches):
        for batch in batches:
            good, matrix = _matrix(batch.column("embedding"), dim)
            near = np.round(_distances(matrix, shared.value, "l2"), DIGITS).argmin(1) if len(matrix) else np.zeros(0)
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(near, pa.int32())], names=[*batch.schema.names, "list_id"])

    return rows.mapInArrow(assign, schema)


def write_lists(vectors: DataFrame, centres: np.ndarray, path: str) -> DataFrame:
    """The vectors with their lists, written once with a folder per list; searches read the result."""
    assign_lists(vectors, centres).repartition("list_id", F.pmod(F.xxhash64("vec_id"), F.lit(16))).write.partitionBy("list_id").parquet(path)
    return vectors.sparkSession.read.parquet(path)


def _probes(queries: DataFrame, centres: np.ndarray, probe: int) -> DataFrame:
    """(query_id, query, list_id) for the ``probe`` nearest lists of each query."""
    shared = queries.sparkSession.sparkContext.broadcast(centres)

    def nearest(batches):
        for batch in batches:
            good, matrix = _matrix(batch.column("query"), shared.value.shape[1])
            kept = batch.filter(pa.array(good))
            lists = np.round(_distances(matrix, shared.value, "l2"), DIGITS).argsort(axis=1, kind="stable")[:, :probe]
            rows = np.repeat(np.arange(len(matrix)), lists.shape[1])
            taken = kept.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(lists.ravel(), pa.int32())], names=["query_id", "query", "list_id"])

    asked = _strict(queries.select("query_id", "query").where("query_id is not null"), "query", centres.shape[1])
    return asked.mapInArrow(nearest, T.StructType([*asked.schema.fields, T.StructField("list_id", T.IntegerType())]))


def _in_lists(listed: DataFrame, probes: DataFrame, k: int, distances) -> DataFrame:
    """The k nearest of each query within the lists it probes. A list is split by its size, and its queries by their number;
    what is read of the lists is their sizes, one number a list."""
    sizes, asked = ({r.list_id: math.ceil(r.n / block) for r in df.groupBy("list_id").agg(F.count("*").alias("n")).collect()}
                    for df, block in ((listed, VECTOR_BLOCK), (probes, QUERY_BLOCK)))
    grid = {i: (blocks, asked[i]) for i, blocks in sizes.items() if i in asked}
    if not grid:
        return _ranked(listed.sparkSession.createDataFrame([], TOP), k)
    shape = F.create_map(*[F.lit(x) for i, (v, q) in grid.items() for x in (i, f"{v},{q}")])[F.col("list_id")]
    vector_blocks, query_blocks = (F.split_part(shape, F.lit(","), F.lit(n)).cast("int") for n in (1, 2))
    # The lists asked for are named, so only their folders are read.
    wanted = F.col("list_id").isin(list(grid))

    def dealt(df, key, own, other, own_name, other_name):
        return df.where(wanted).withColumns({own_name: F.pmod(F.xxhash64(key), own).cast("int"), other_name: F.explode(F.sequence(F.lit(0), other - 1))})

    left = dealt(listed, "vec_id", vector_blocks, query_blocks, "_v", "_q")
    right = dealt(probes, "query_id", query_blocks, vector_blocks, "_q", "_v")
    return _ranked(_in_blocks(left, right, ["list_id", "_v", "_q"], k, distances), k)


def knn_ivf(listed: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probe: int) -> DataFrame:
    """(S) Approximate k nearest by L2: each query looks only into its ``probe`` nearest lists.

    ``listed`` has vec_id, embedding and list_id; read from ``write_lists``, only the folders of probed lists are read.
    Queries are dealt by the lists they probe and meet those lists there, any number of them in one plan.
    """
    exact = _Exact("l2", centres.shape[1])
    return _in_lists(listed.select("vec_id", "embedding", "list_id"), _probes(queries, centres, probe), k, exact)


def train_codes(vectors: DataFrame, dim: int, parts: int = 16, seed: int = 42) -> np.ndarray:
    """Product quantisation: for each of ``parts`` equal parts of a vector up to 256 means, fitted on FIT_ROWS rows of lowest
    hash. Shape (parts, means, dim / parts)."""
    if dim % parts:
        raise ValueError(f"{dim} values cannot be cut into {parts} equal parts")
    rows = vectors.where(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("embedding").toArrow()
    _, points = _matrix(rows.column("embedding"), dim)
    if not len(points):
        raise ValueError("no vectors to fit codes on")
    random, width, books = np.random.default_rng(seed), dim // parts, []
    for part in range(parts):
        own = np.ascontiguousarray(points[:, part * width : (part + 1) * width])
        means = own[random.choice(len(own), min(256, len(own)), replace=False)]
        for _ in range(8):
            near = _squares(own, means).argmin(1)
            sums, counts = np.zeros_like(means), np.bincount(near, minlength=len(means))
            np.add.at(sums, near, own)
            means = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], means)
        books.append(means)
    return np.array(books)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a ** 2).sum(1)[:, None] - 2 * a @ b.T + (b ** 2).sum(1)[None, :], 0)


class _Coded:
    """Distances of a query to the means that a vector's code names: one table of squares per query, looked up by code."""

    def __init__(self, books: np.ndarray) -> None:
        self.books = books

    def encode(self, matrix: np.ndarray) -> list[bytes]:
        width = self.books.shape[2]
        codes = [_squares(matrix[:, p * width : (p + 1) * width], book).argmin(1).astype(np.uint8) for p, book in enumerate(self.books)]
        return [c.tobytes() for c in np.stack(codes, axis=1)] if len(matrix) else []

    def asked(self, queries: pa.Table) -> np.ndarray:
        dim, width = self.books.shape[0] * self.books.shape[2], self.books.shape[2]
        _, matrix = _matrix(queries.column("query"), dim)
        return np.stack([_squares(matrix[:, p * width : (p + 1) * width], book) for p, book in enumerate(self.books)])

    def between(self, asked: np.ndarray, vectors) -> np.ndarray:
        codes = np.frombuffer(b"".join(vectors.column("code").to_pylist()), dtype=np.uint8).reshape(-1, len(self.books))
        total = np.zeros((asked.shape[1], len(codes)))
        for part in range(len(self.books)):
            total += asked[part][:, codes[:, part]]
        return np.sqrt(total)


def write_codes(listed: DataFrame, books: np.ndarray, path: str) -> DataFrame:
    """(list_id, vec_id, code) of listed vectors, a folder per list: one byte per part instead of the vector."""
    coder = _Coded(books)

    def encode(batches):
        for batch in batches:
            _, matrix = _matrix(batch.column("embedding"), books.shape[0] * books.shape[2])
            yield pa.RecordBatch.from_arrays([batch.column("list_id"), batch.column("vec_id"), pa.array(coder.encode(matrix), pa.binary())],
                                             names=["list_id", "vec_id", "code"])

    codes = listed.select(F.col("list_id").cast("int").alias("list_id"), "vec_id", "embedding").mapInArrow(encode, "list_id int, vec_id bigint, code binary")
    codes.repartition("list_id", F.pmod(F.xxhash64("vec_id"), F.lit(16))).write.partitionBy("list_id").parquet(path)
    return listed.sparkSession.read.schema("vec_id bigint, code binary, list_id int").parquet(path)


def knn_ivf_codes(codes: DataFrame, listed: DataFrame, queries: DataFrame, centres: np.ndarray, books: np.ndarray, k: int, probe: int,
                  compared: int) -> DataFrame:
    """(S) Approximate k nearest by L2: the codes of the probed lists are searched, and only the ``compared`` nearest by code
    are compared as whole vectors.

    Whole vectors meet candidates by (list, id): ``compared`` rows a query, whatever the size of the lists.
    """
    probes = _probes(queries, centres, probe)
    near = _in_lists(codes, probes, compared, _Coded(books)).select("query_id", "vec_id")
    whole = listed.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query"))
    pairs = near.join(whole, "vec_id").join(asked, "query_id")
    return _ranked(pairs.select("query_id", "vec_id", F.round(l2(F.col("embedding"), F.col("query")), DIGITS).alias("distance")), k)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate search found."""
    found = approximate.select("query_id", "vec_id", F.lit(1).alias("found"))
    return exact.join(found, ["query_id", "vec_id"], "left").agg(
        (F.count("found") / F.count("*")).alias("recall"))


def mean_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """Mean vector per key, e.g. one query per label."""
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    return vectors.groupBy(key).agg(vector_to_array(mean).alias("query"))


def retrieve_documents(nearest: DataFrame, documents: DataFrame, doc_id: str) -> DataFrame:
    """(D) Nearest vectors with their documents.

    The search result has k rows per query. It is written once, as the search is the costly
    part; Spark broadcasts it if its size in bytes allows.
    """
    return documents.join(cut_lineage(nearest.withColumnRenamed("vec_id", doc_id)), doc_id)
