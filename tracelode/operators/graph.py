"""Dependency order and depth in span trees."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracelode.session import written


def _climbed(steps: DataFrame, key: list[str]) -> DataFrame:
    """Steps from each node up to the end of its chain, null on a cycle; ``steps`` is (key, up), unique by key.

    The last column of ``key`` is what ``up`` names. Each round doubles the distance that a node has looked up. Nodes that
    have arrived are written once and only looked up afterwards; a name that is not there ends the chain before it.
    """
    within, own = key[:-1], key[-1]
    state = written(steps.select(*key, "up", F.col("up").isNotNull().cast("bigint").alias("depth")), "climb")
    arrived, climbing = [state.where("up is null")], state.where("up is not null")
    longest = state.groupBy(*within).count().agg(F.max("count")).first()[0] if within else state.count()
    reach = 1
    while reach <= 2 * (longest or 0) and not climbing.isEmpty():
        known = reduce(DataFrame.unionByName, [*arrived, climbing])
        above = known.select(*within, F.col(own).alias("up"), F.col("up").alias("next_up"), F.col("depth").alias("more"))
        # No row above: the last step led to a node that is not there.
        moved = written(climbing.join(above, [*within, "up"], "left").select(
            *key, F.col("next_up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(-1))).alias("depth")), "climb")
        arrived.append(moved.where("up is null"))
        climbing = moved.where("up is not null")
        reach *= 2
    return reduce(DataFrame.unionByName, [*arrived, climbing]).select(*key, F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def _jumped(links: DataFrame) -> DataFrame:
    """Links (node, dep, w, b), one a node, led on to the first dep that is no link, by doubling.

    A link says level(node) = max(b, level(dep) + w); two of them behind each other are one of the same form. Links on or
    before a cycle of links keep a link as their dep.
    """
    state, total, reach = links, links.count(), 1
    while reach <= 2 * total:
        above = state.select(F.col("node").alias("dep"), F.col("dep").alias("_d"), F.col("w").alias("_w"), F.col("b").alias("_b"))
        state = written(state.join(above, "dep", "left").select(
            "node", F.coalesce("_d", "dep").alias("dep"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"),
            F.greatest("b", F.coalesce(F.col("_b") + F.col("w"), F.col("b"))).alias("b")), "links")
        reach *= 2
        if state.join(links.select(F.col("node").alias("dep")), "dep", "left_semi").isEmpty():
            break
    return state


def dependency_levels(edges: DataFrame) -> DataFrame:
    """(I) Level of each node so that its dependencies have lower ones; ``edges`` is (node, dep), dep null for a lone node.

    Nodes on or behind a cycle get one last level. Where no node has two dependencies, the
    level is the length of its chain, found in a logarithmic number of rounds. Otherwise a round places the nodes that wait
    for nothing, and then leads every chain of nodes that wait for one node each on to the first node that does not, if there is a chain:
    what is left of it is an edge with a weight. So rounds follow the number of nodes with two open dependencies behind each
    other, not the depth, and a chain costs the logarithm of its length. A round places a node or is the last.
    """
    spark = edges.sparkSession
    pairs = written(edges.select("node", "dep").where("node is not null").distinct(), "edges")
    waiting = pairs.where("dep is not null")
    nodes = pairs.select("node").union(waiting.select("dep")).distinct()
    if waiting.groupBy("node").count().where("count > 1").isEmpty():
        depth = written(_climbed(nodes.join(waiting.withColumnRenamed("dep", "up"), "node", "left"), ["node"]), "depths")
        last = depth.agg(F.coalesce(F.max("depth") + 1, F.lit(0))).first()[0]
        return depth.select("node", F.coalesce("depth", F.lit(last)).cast("int").alias("level"))
    # Open nodes with the level that what they no longer wait for gives them and the number of those they wait for, and weighted
    # edges between them. Edges to placed nodes stay, as a node is placed once; so a round moves what it places and what waits for it.
    waits = waiting.groupBy("node").agg(F.count("*").alias("n"))
    left = written(nodes.join(waits, "node", "left").select("node", F.lit(0).alias("b"), F.coalesce("n", F.lit(0)).alias("n")), "left")
    open_edges, placed = waiting.withColumn("w", F.lit(1)), []
    while True:
        ready = written(left.where("n = 0").select("node", "b"), "ready")
        if ready.isEmpty():
            break
        placed.append(ready)
        ends = open_edges.join(ready.select(F.col("node").alias("dep"), F.col("b").alias("level")), "dep")
        bases = written(ends.groupBy("node").agg(F.max(F.col("level") + F.col("w")).alias("_b"), F.count("*").alias("_n")), "bases")
        left = written(left.where("n > 0").join(bases, "node", "left").select(
            "node", F.greatest("b", F.coalesce("_b", F.lit(0))).alias("b"), (F.col("n") - F.coalesce("_n", F.lit(0))).alias("n")), "left")
        # A node that waits for one is a link. Without two behind each other there is no chain to lead on.
        single = written(left.where("n = 1").select("node"), "single")
        chained = open_edges.join(single, "node", "left_semi").join(single.select(F.col("node").alias("dep")), "dep", "left_semi")
        if single.isEmpty() or chained.isEmpty():
            continue
        rest = open_edges.join(left.select(F.col("node").alias("dep")), "dep", "left_semi").select("node", "dep", "w")
        links = written(rest.join(left.where("n = 1").select("node", "b"), "node").select("node", "dep", "w", "b"), "links")
        jumped = _jumped(links)
        over = jumped.select(F.col("node").alias("dep"), F.col("dep").alias("_d"), F.col("w").alias("_w"), F.col("b").alias("_b"))
        many = rest.join(links.select("node"), "node", "left_anti").join(over, "dep", "left")
        many = written(many.select("node", F.coalesce("_d", "dep").alias("dep"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"),
                                   (F.col("_b") + F.col("w")).alias("b")), "many")
        bases = many.select("node", "b").unionByName(jumped.select("node", "b")).groupBy("node").agg(F.max("b").alias("_b"))
        left = left.drop("n").join(bases, "node", "left").select("node", F.greatest("b", F.coalesce("_b", F.lit(0))).alias("b"))
        open_edges = many.select("node", "dep", "w").unionByName(jumped.select("node", "dep", "w")).groupBy("node", "dep").agg(F.max("w").alias("w"))
        open_edges = written(open_edges, "open")
        waits = open_edges.groupBy("node").agg(F.count("*").alias("n"))
        left = written(left.join(waits, "node", "left").select("node", "b", F.coalesce("n", F.lit(0)).alias("n")), "left")
    known = reduce(DataFrame.unionByName, placed) if placed else spark.createDataFrame([], left.select("node", "b").schema)
    last = known.agg(F.coalesce(F.max("b") + 1, F.lit(0))).first()[0]
    return known.unionByName(left.select("node", F.lit(last).alias("b"))).select("node", F.col("b").cast("int").alias("level"))


def _first(column: str) -> Column:
    return F.min(column).alias("up")


#: Steps below the roots that one recursive query takes; what lies deeper is climbed by doubling.
SHALLOW = 16


def span_depth(spans: DataFrame) -> DataFrame:
    """(S) Steps from each span up to the root of its tree, one row per distinct (trace, span); null on a cycle of parents.

    A parent that is not in the trace counts as absent. A span delivered twice is one span;
    if its deliveries name different parents, the least one counts. Trees are walked down from their roots by one recursive
    query; only spans that it has not reached, deep ones and those on or behind cycles, are climbed in rounds.
    """
    key, spark = ["trace_id", "span_id"], spans.sparkSession
    own = written(spans.groupBy(*key).agg(_first("parent_span_id")), "spans")
    name = f"spans_{uuid.uuid4().hex}"
    own.createOrReplaceTempView(name)
    same = "p.trace_id = s.trace_id and p.span_id = s.up"
    with _settings(spark, {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": str(SHALLOW + 2)}):
        reached = written(spark.sql(f"""
            with recursive d(trace_id, span_id, depth) as (
              select s.trace_id, s.span_id, 0L from {name} s left anti join {name} p on {same}
              union all
              select s.trace_id, s.span_id, p.depth + 1 from d p join {name} s on {same} where p.depth < {SHALLOW})
            select * from d"""), "reached")
    spark.catalog.dropTempView(name)
    known = reached.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"))
    below = written(own.join(known, F.col("trace_id").eqNullSafe(F.col("_t")) & F.col("span_id").eqNullSafe(F.col("_s")), "left_anti"), "below")
    if below.isEmpty():
        return reached
    # Their highest spans are children of the last ones reached.
    return reached.unionByName(_climbed(below, key).withColumn("depth", F.col("depth") + SHALLOW + 1))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
