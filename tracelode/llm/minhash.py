"""Near-duplicate documents by ProbMinHash signatures, banding and verification.

A document is the set of its shingles (five consecutive words), each with weight 1 however often it occurs. Every shingle runs a
Poisson process whose rate is its weight; each arrival picks a component of the signature at random, and a component keeps
the shingle that arrived first. Arrivals later than the last component's best cannot win, so a shingle stops there: a few
arrivals a shingle instead of one per component. Two documents agree in a component with their probability Jaccard
similarity, which for weights 1 is the Jaccard similarity of the sets, the one that is verified. Bands of equal signature parts give buckets; documents of a bucket are verified by the Jaccard similarity of
their shingle sets, and components of verified links are classes.

Documents of the same shingle set are one node from the start. Within a bucket, members are compared with one hub, a few
rounds with another hub each, only across classes found so far, so a large group of copies costs a few comparisons per
member. What a bucket still holds of several classes then is compared all with all, in blocks of members whose common
shingles are counted by a matrix product; only links leave a block. So no bucket is capped and no link within one is lost;
two documents of similarity 0.8 share a bucket with probability 0.9999, more similar ones with more.

Defined results: fewer words than a shingle make one shingle; texts that are null or hold no word are classes of their own;
cluster_id is the least doc_id of a class (null only if all ids are null); repeated rows are one class; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tracelode.llm.columns import Rolling, mix, slices, texts_of, words_of
from tracelode.llm.components import components
from tracelode.llm.stored import stored

WORDS = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 5
#: Rounds with one hub a bucket before the rest is compared all with all.
ROUNDS = 3
#: Members of a block of a bucket, about, and how many rows and columns of it are multiplied at a time.
BLOCK = 1024
TILE = (128, 8192)

_U = np.uint64


def shingles(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of every k consecutive words; of all words if they are fewer."""
    return Rolling(words).windows(min(k, len(words))) if len(words) else words


def prob_minhash(document: np.ndarray, element: np.ndarray, weight: np.ndarray, documents: int, size: int) -> np.ndarray:
    """Signatures (documents x size) of weighted elements, all documents at once: one arrival of every live element a round."""
    best = np.full(documents * size, np.inf)
    who = np.zeros(documents * size, dtype=np.uint64)
    limit = np.full(documents, np.inf)
    time = np.zeros(len(element))
    arrival = 0
    while len(element):
        arrival += 1
        draw = mix(element ^ mix(np.array([arrival], dtype=np.uint64)))
        time = time - np.log(((draw >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)) / weight
        live = time < limit[document]
        document, element, weight, time, draw = (x[live] for x in (document, element, weight, time, draw))
        place = document * size + (mix(draw + _U(0x5851F42D4C957F2D)) % _U(size)).astype(np.int64)
        first = time < best[place]
        at, when, what = place[first], time[first], element[first]
        np.minimum.at(best, at, when)
        won = best[at] == when
        who[at[won]] = what[won]
        limit = best.reshape(documents, size).max(axis=1)
    return who.reshape(documents, size)


def _distinct(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Document number and shingle of every distinct shingle of each document."""
    found = [np.unique(x) for x in texts]
    return np.repeat(np.arange(len(texts)), [len(x) for x in found]), np.concatenate(found or [np.zeros(0, np.uint64)])


SKETCH = "doc_id bigint, row bigint, node binary, shingles int, bands array<bigint>"


def sketches(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For each document its id, a hash of its row, its node (a hash of its shingle set, null without words), the number of
    distinct shingles and the hashes of its signature's bands."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                all_words = words_of(texts_of(part.column("text")))
                sets = [shingles(all_words.hash[a:b], words) for a, b in zip(all_words.first, all_words.first[1:])]
                document, element = _distinct(sets)
                size = np.bincount(document, minlength=len(sets))
                signature = prob_minhash(document, element, np.ones(len(element)), len(sets), bands * rows)
                grouped = signature.reshape(len(sets), bands, rows)
                hashes = mix(np.arange(bands, dtype=np.uint64)[None, :] + sum(mix(grouped[:, :, r] + _U(r + 1)) for r in range(rows)))
                names = np.zeros((len(sets), 2), dtype=np.uint64)
                np.add.at(names, document, np.stack([mix(element), mix(~element)], axis=1))
                nodes = [name.tobytes() if n else None for name, n in zip(mix(names + size.astype(np.uint64)[:, None]), size)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("row"), pa.array(nodes, pa.binary()), pa.array(size, pa.int32()),
                    pa.array([h if n else [] for h, n in zip(hashes.view(np.int64), size)], pa.list_(pa.int64()))], ["doc_id", "row", "node", "shingles", "bands"])

    return _keyed(docs).mapInArrow(sketch, SKETCH)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("bigint"), "text").alias("row"), F.col("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """a, b and whether the shingle sets of both texts have at least this Jaccard similarity."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            for part in slices(batch, "text_b", 1 << 19):
                members = words_of(texts_of(part.column("text_b")))
                hubs, linked = part.column("a").to_pylist(), []
                for i, name in enumerate(hubs):
                    if name != hub:
                        hub, hub_set = name, np.unique(shingles(words_of(texts_of(part.column("text_a").slice(i, 1))).hash, words))
                    own = np.unique(shingles(members.hash[members.first[i] : members.first[i + 1]], words))
                    common = len(own) + len(hub_set) - len(np.union1d(own, hub_set))
                    linked.append(common >= similarity * (len(own) + len(hub_set) - common))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked)], ["a", "b", "linked"])

    member = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = member.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a binary, b binary, linked boolean")


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of `a` shares with each of `b`; sets are sorted and distinct."""
    columns = np.intersect1d(np.concatenate(a), np.concatenate(b))
    counts = np.zeros((len(a), len(b)))
    for start in range(0, len(columns), TILE[1]):
        part = columns[start : start + TILE[1]]
        sides = []
        for sets in (a, b):
            matrix = np.zeros((len(sets), len(part)), dtype=np.float32)
            for row, values in enumerate(sets):
                at = np.searchsorted(part, values)
                at = at[(at < len(part)) & (part[np.minimum(at, len(part) - 1)] == values)]
                matrix[row, at] = 1
            sides.append(matrix)
        counts += sides[0] @ sides[1].T
    return counts


def linked_pairs(sets: list[np.ndarray], side: np.ndarray, component: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of different components and at least this Jaccard similarity; across sides, or of one side if there is but one."""
    sizes, sides = np.array([len(x) for x in sets], dtype=float), np.unique(side)
    first, second = np.flatnonzero(side == sides[0]), np.flatnonzero(side == sides[-1])
    found = []
    for i in range(0, len(first), TILE[0]):
        for j in range(i if len(sides) == 1 else 0, len(second), TILE[0]):
            a, b = first[i : i + TILE[0]], second[j : j + TILE[0]]
            common = common_counts([sets[x] for x in a], [sets[x] for x in b])
            near = (common >= similarity * (sizes[a][:, None] + sizes[b][None, :] - common)) & (component[a][:, None] != component[b][None, :])
            found += [(int(a[x]), int(b[y])) for x, y in zip(*np.nonzero(near))]
    return found


def compared(members: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """a and b, the links between different components within a bucket; `members` is (bucket, node, component)."""
    sizes = stored(members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = members.join(sizes, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = placed.select("bucket", "node", "component", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def compare(block: pa.Table) -> pa.Table:
        found = words_of(texts_of(block.column("text")))
        sets = [np.unique(shingles(found.hash[i:j], words)) for i, j in zip(found.first, found.first[1:])]
        side, nodes = block.column("own").to_numpy(), block.column("node").to_pylist()
        _, component = np.unique(np.array([c.hex() for c in block.column("component").to_pylist()]), return_inverse=True)
        whole = block.column("low")[0] == block.column("high")[0]
        pairs = linked_pairs(sets, side, component, similarity) if whole or len(np.unique(side)) > 1 else []
        return pa.table({"a": pa.array([nodes[i] for i, _ in pairs], pa.binary()), "b": pa.array([nodes[j] for _, j in pairs], pa.binary())})

    return dealt.join(texts, "node").groupBy("bucket", "low", "high").applyInArrow(compare, "a binary, b binary")


def classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, row (hash of id and text), cluster_id and component of every document; documents without words have no component."""
    sketch = stored(sketches(docs, words, bands, rows), "sketches")
    nodes = sketch.where("node is not null").groupBy("node").agg(F.min("row").alias("row"), F.min("bands").alias("bands"))
    in_bands = nodes.select("node", "row", F.explode("bands").alias("bucket"))
    shared = in_bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = stored(in_bands.join(shared, "bucket"), "buckets")
    wanted = members.groupBy("node").agg(F.min("row").alias("row"))
    texts = stored(_keyed(docs).select("row", "text").join(wanted, "row").select("node", "text").dropDuplicates(["node"]), "candidates")
    members = members.select("bucket", "node")
    tested, found = None, None
    for round_ in range(rounds + 1):
        if found is None:
            placed = members.withColumn("component", F.col("node"))
        else:
            placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        order = F.col("node") if round_ == 0 else F.xxhash64("node", F.lit(round_)).cast("string").cast("binary")
        hubs = stored(placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                                   F.min(F.struct(order.alias("order"), "node", "component")).alias("hub")).where("low < high"), "hubs")
        if hubs.isEmpty():
            break
        if round_ == rounds:
            links = stored(compared(placed.join(hubs.select("bucket"), "bucket"), texts, words, similarity).distinct(), "verified")
            tested = links.withColumn("linked", F.lit(True)) if tested is None else tested.union(links.withColumn("linked", F.lit(True)))
            found = components(tested.where("linked"))
            break
        pairs = placed.join(hubs.select("bucket", F.col("hub.node").alias("other"), F.col("hub.component").alias("other_component")), "bucket")
        pairs = pairs.where("component <> other_component").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        result = stored(verified(pairs, texts, words, similarity), "verified")
        if result.isEmpty():  # every hub was compared before; what else is in the buckets was not
            continue
        tested = result if tested is None else tested.union(result)
        found = components(tested.where("linked"))
    placed = sketch.select("doc_id", "row", "node")
    if found is not None:
        placed = placed.join(found, "node", "left").select("doc_id", "row", F.coalesce("component", "node").alias("component"))
    else:
        placed = placed.select("doc_id", "row", F.col("node").alias("component"))
    least = stored(placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("cluster_id")), "least")
    return placed.join(least, "component", "left").select("doc_id", "row", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("cluster_id")).alias("cluster_id"), "component")


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """doc_id and cluster_id of every document."""
    return classes(docs, **settings).select("doc_id", "cluster_id")


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The rows, all columns, of the first document of every class (by doc_id, then a hash of the row); documents without
    words stay."""
    found = classes(docs, **settings)
    first = found.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("__first")).select(F.col("__first.row").alias("__row"))
    wordless = found.where("component is null").select(F.col("row").alias("__row"))
    kept = first.withColumn("__once", F.lit(True)).union(wordless.distinct().withColumn("__once", F.lit(False)))
    rows = docs.withColumn("__row", F.xxhash64(F.col("doc_id").cast("bigint"), "text")).join(kept, "__row")
    # Of rows equal in id and text, the one whose other columns have the least hash; wordless rows meet in no window.
    columns = [F.col(f"`{f.name}`") for f in docs.schema if not f.dataType.simpleString().startswith(("map", "variant"))]
    copy = F.row_number().over(Window.partitionBy("__row").orderBy(F.xxhash64(*columns)))
    once = rows.where("__once").withColumn("__copy", copy).where("__copy = 1").drop("__copy")
    return once.unionByName(rows.where("not __once")).select(*[F.col(f"`{c}`") for c in docs.columns])
