"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are dealt to blocks of a bounded number of rows. A block is sorted once per dimension, and these lists are written. All
queries come to a block together. Each walks the lists from the end that adds most to its score: a step moves the list on
whose next values lower its bound most, and the rows met for the first time, by any query, are scored for all queries that
still walk in one matrix product. What a row not yet met can reach at most is the score made of the lists' next values: once
that is below a query's k-th best score, its walk stops. The first block's k-th score is a bound from below that every
query takes along to the other blocks. The best of all blocks are then ranked together. Queries come in blocks too, so nothing grows
beyond a task.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part on either side; only
vectors of equal length are compared; equal scores go to the smaller id; a row with a null id takes no part; rows that share
an id are candidates each, and none of them is its own query's answer; fewer candidates than k give as many rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracelode.llm.stored import stored

K = 10
#: Vectors and queries of a block, about, and queries that walk together.
VECTORS = 8192
QUERIES = 8192
TOGETHER = 512
#: Places that a list moves on; doubled every other step.
STRETCH = 32

BLOCK = "dim int, vb int, ids binary, rows binary, places binary"
RESULT = "query_id bigint, vec_id bigint, score bigint"


def scaled(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, null if the vector takes no part."""
    usable = F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


class Lists:
    """Rows of a block with one order per dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, order: np.ndarray | None = None) -> None:
        if order is None:
            by_id = np.argsort(ids, kind="stable")
            ids, rows = ids[by_id], rows[by_id]
            order = np.argsort(rows, axis=0, kind="stable").astype(np.int32)
        self.ids, self.rows, self.order = ids, rows, order
        self.values = np.take_along_axis(rows, order, axis=0)
        self.top = int(np.abs(rows).max(initial=0))

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best rows, and how many rows were scored."""
        (ids, scores), = (found := self.best_of(np.array([query_id]), query[None, :], k))[0]
        return ids, scores, found[1]

    def best_of(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """Ids and scores of the k best rows of each query, and how many rows were scored. Rows below a query's floor may lack."""
        n, (count, dims) = len(self.ids), queries.shape
        exact = self.top * int(np.abs(queries).sum(axis=1).max(initial=0)) < 1 << 53
        rows, weights = (self.rows.astype(np.float64), queries.astype(np.float64)) if exact else (self.rows, queries)
        floor = np.full(count, np.iinfo(np.int64).min) if floors is None else floors
        places = [np.zeros(0, np.int64) for _ in range(count)]
        scores = [np.zeros(0, np.int64) for _ in range(count)]
        kth = floor.copy()
        full = np.zeros(count, dtype=bool)
        scored, depth = np.zeros(n, dtype=bool), np.zeros((count, dims), dtype=np.int64)
        walking, stretch, step = np.arange(count), STRETCH, 0
        every = np.arange(dims)

        def ahead(at: np.ndarray, q: np.ndarray) -> np.ndarray:
            """What each list's value at a place adds to the score, from the end that adds most."""
            at = np.minimum(at, n - 1)
            return queries[q] * self.values[np.where(queries[q] > 0, n - 1 - at, at), every]

        while len(walking) and not scored.all():
            now = ahead(depth[walking], walking)
            drop = now - ahead(depth[walking] + stretch, walking)
            move = np.where(queries[walking] != 0, drop, -1).argmax(axis=1)
            start = depth[walking, move]
            reach = start[:, None] + np.arange(stretch)[None, :]
            inside = reach < n
            at = np.where(queries[walking, move][:, None] > 0, n - 1 - np.minimum(reach, n - 1), np.minimum(reach, n - 1))
            met = np.zeros(n, dtype=bool)
            met[self.order[at, move[:, None]][inside]] = True
            depth[walking, move] = np.minimum(start + stretch, n)
            new = np.flatnonzero(met & ~scored)
            scored |= met
            if len(new):
                self._add(new, (weights[walking] @ rows[new].T).astype(np.int64), walking, query_ids, places, scores, kth, full, floor, k)
            # A list at its end has shown all rows; a query without weights has met none by any list, so all are scored.
            bound = ahead(depth[walking], walking).sum(axis=1)
            over = (full[walking] | (floor[walking] > np.iinfo(np.int64).min)) & (kth[walking] > bound)
            over |= (depth[walking] >= n).any(axis=1)
            walking = walking[~over]
            step += 1
            if step % 2 == 0:
                stretch = min(2 * stretch, n)
        return [(self.ids[p], s) for p, s in zip(places, scores)], int(scored.sum())

    def _add(self, new: np.ndarray, found: np.ndarray, walking: np.ndarray, query_ids: np.ndarray, places: list, scores: list, kth: np.ndarray,
             full: np.ndarray, floor: np.ndarray, k: int) -> None:
        least = np.partition(found, -k - 1, axis=1)[:, -k - 1] if len(new) > k + 1 else np.full(len(walking), np.iinfo(np.int64).min)
        wanted = found >= np.maximum(least, kth[walking])[:, None]
        for i in np.flatnonzero(wanted.any(axis=1)).tolist():
            q, own = walking[i], np.flatnonzero(wanted[i])
            own = own[self.ids[new[own]] != query_ids[q]]
            p, s = np.concatenate([places[q], new[own]]), np.concatenate([scores[q], found[i, own]])
            keep = np.lexsort((p, -s))[:k]
            places[q], scores[q] = p[keep], s[keep]
            if len(keep) == k:
                full[q] = True
                kth[q] = max(floor[q], s[keep[-1]])


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _found(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    counts = [len(ids) for _, ids, _ in rows]
    none = [np.zeros(0, np.int64)]
    return pa.table({"query_id": pa.array(np.repeat(np.array([q for q, _, _ in rows], dtype=np.int64), counts), pa.int64()),
                     "vec_id": pa.array(np.concatenate(none + [ids for _, ids, _ in rows]), pa.int64()),
                     "score": pa.array(np.concatenate(none + [s for _, _, s in rows]), pa.int64())})


def sorted_blocks(vectors: DataFrame, block: int = VECTORS) -> DataFrame:
    """One row a block (dim, vb): its ids, its rows, and the rows' order in every dimension, written once."""
    count = max(1, -(-vectors.count() // block))

    def sort(key: tuple, rows: pa.Table) -> pa.Table:
        lists = Lists(rows.column("vec_id").to_numpy().astype(np.int64), _matrix(rows.column("row"), key[0].as_py()))
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "vb": pa.array([key[1].as_py()], pa.int32()), "ids": [lists.ids.tobytes()],
                         "rows": [np.ascontiguousarray(lists.rows).tobytes()], "places": [np.ascontiguousarray(lists.order).tobytes()]})

    dealt = vectors.withColumn("vb", F.pmod(F.xxhash64("vec_id", "row"), F.lit(count)).cast("int"))
    return stored(dealt.groupBy("dim", "vb").applyInArrow(sort, BLOCK), "lists")


def _searched(blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of every query in every block; both are dealt by (dim, vb, qb), a block is one row."""
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for block in left.to_pylist() if right.num_rows else []:
            dim = block["dim"]
            ids, rows, order = (np.frombuffer(block[c], dtype=t) for c, t in (("ids", np.int64), ("rows", np.int64), ("places", np.int32)))
            lists = Lists(ids, rows.reshape(-1, dim), order.reshape(-1, dim))
            asked, matrix, floors = right.column("vec_id").to_numpy(), _matrix(right.column("row"), dim), right.column("floor").to_numpy()
            for at in range(0, len(asked), TOGETHER):
                part = slice(at, at + TOGETHER)
                best, _ = lists.best_of(asked[part], matrix[part], k, floors[part])
                found += [(q, *b) for q, b in zip(asked[part].tolist(), best)]
        return _found(found)

    return blocks.groupBy("dim", "vb", "qb").cogroup(queries.groupBy("dim", "vb", "qb")).applyInArrow(search, RESULT)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = VECTORS, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best vectors. Both frames hold an id (bigint) and a row of whole
    numbers (array<bigint>, null: takes no part), named vec_id and row."""
    vectors, queries = (df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("row").cast("array<bigint>").alias("row"), F.size("row").alias("dim"))
                        .where("vec_id is not null and row is not null") for df in (vectors, queries))
    blocks = sorted_blocks(vectors, block)
    count = max(1, -(-queries.count() // query_block))
    asked = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))
    copied = blocks.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    numbers = blocks.groupBy("dim").agg(F.min("vb").alias("first"), F.collect_set("vb").alias("others"))
    asked = asked.join(numbers, "dim")
    none = F.lit(-(1 << 63)).cast("bigint")
    first = stored(_searched(copied.join(numbers.select("dim", F.col("first").alias("vb")), ["dim", "vb"], "left_semi"),
                             asked.select("vec_id", "row", "dim", "qb", F.col("first").alias("vb"), none.alias("floor")), k), "first")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    rest = asked.withColumn("vb", F.explode(F.array_remove("others", F.col("first"))))
    rest = rest.join(floors, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "row", "dim", "qb", "vb", F.coalesce("least", none).alias("floor"))
    others = _searched(copied.join(numbers.select("dim", F.col("first").alias("vb")), ["dim", "vb"], "left_anti"), rest, k)
    return first.union(others).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
