"""Learning tables and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracelode.functions.text import tokens
from tracelode.operators.ordered import running_sum, slices
from tracelode.operators.vectors import knn_l2, mean_vectors
from tracelode.session import cut_lineage


def filter_difficulty(df: DataFrame, difficulty: int) -> DataFrame:
    """(I) Questions of one difficulty."""
    return df.where(F.col("difficulty") == difficulty)


def filter_concepts(df: DataFrame, concepts: list[str], match: str = "any") -> DataFrame:
    """(S) Questions holding any or all of the concepts; an empty list is no filter."""
    if not concepts:
        return df
    if match == "any":
        return df.where(F.arrays_overlap("concepts", F.array(*[F.lit(c) for c in concepts])))
    for concept in concepts:
        df = df.where(F.array_contains("concepts", concept))
    return df


#: Folders that concepts are dealt to.
CONCEPT_BUCKETS = 64


def _bucket(concept, buckets: int):
    return F.pmod(F.xxhash64(concept), F.lit(buckets)).cast("int")


def write_postings(questions: DataFrame, path: str, buckets: int = CONCEPT_BUCKETS) -> DataFrame:
    """(S) The declared index on concepts: (concept, question_id), once each, in folders by concept and in order within them.

    The rebalance hint lets adaptive execution split a concept that most questions hold.
    """
    pairs = questions.select("question_id", F.explode("concepts").alias("concept")).where("concept is not null and question_id is not null").distinct()
    dealt = pairs.withColumn("bucket", _bucket("concept", buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "concept", "question_id")
    dealt.write.partitionBy("bucket").parquet(path)
    return pairs.sparkSession.read.schema("question_id bigint, concept string, bucket int").parquet(path)


def posted_questions(postings: DataFrame, concepts: list[str], match: str = "any", buckets: int = CONCEPT_BUCKETS) -> DataFrame:
    """(S) Ids of the questions that hold any or all of some concepts, counted from their postings; only the folders of these
    concepts are read."""
    wanted = sorted(set(concepts))
    if not wanted:
        raise ValueError("an empty list is no filter, so there is nothing to look up")
    folders = postings.sparkSession.range(1).select(F.array_distinct(F.array(*[_bucket(F.lit(c), buckets) for c in wanted])).alias("b")).first().b
    held = postings.where(F.col("bucket").isin(folders) & F.col("concept").isin(wanted))
    ids = held.groupBy("question_id").agg(F.count("*").alias("_n"))
    return ids.where(F.col("_n") >= (len(wanted) if match == "all" else 1)).select("question_id")


def filter_concepts_indexed(df: DataFrame, postings: DataFrame, concepts: list[str], match: str = "any", buckets: int = CONCEPT_BUCKETS) -> DataFrame:
    """(S) As ``filter_concepts``, by the index: the questions whose ids it names."""
    return df.join(posted_questions(postings, concepts, match, buckets), "question_id", "left_semi") if concepts else df


def embedding_backfill(items: DataFrame, vectors: DataFrame, item_id: str, vector_id: str) -> DataFrame:
    """(S) Items that have no vector yet, oldest (lowest id) first."""
    done = vectors.select(F.col(vector_id).alias(item_id))
    return items.join(done, item_id, "left_anti").orderBy(item_id)


def progress_by_concept(progress: DataFrame, questions: DataFrame) -> DataFrame:
    """(S) Attempts and correct share per user and concept (our formula).

    Attempts are added up per user and question before the join, so a question that most
    attempts name is one row per user there.
    """
    attempts = progress.groupBy("user_id", "question_id").agg(
        F.count("*").alias("attempts"), F.count_if("correct").alias("right"))
    concepts = questions.select("question_id", F.explode("concepts").alias("concept"))
    per_concept = attempts.join(concepts, "question_id").groupBy("user_id", "concept").agg(
        F.sum("attempts").alias("attempts"), F.sum("right").alias("right"))
    return per_concept.select("user_id", "concept", "attempts", (F.col("right") / F.col("attempts")).alias("correct_share"))


def concept_mastery(progress: DataFrame, questions: DataFrame) -> DataFrame:
    """(S) The mastery table, one row per user and concept: the share of right answers, weighted by difficulty (our formula,
    between 0 and 1), and the number of answers behind it."""
    answers = progress.groupBy("user_id", "question_id").agg(
        F.count("*").alias("answers"), F.sum("difficulty").alias("weight"), F.sum(F.when(F.col("correct"), F.col("difficulty")).otherwise(0)).alias("right"))
    concepts = questions.select("question_id", F.explode(F.array_distinct("concepts")).alias("concept")).where("concept is not null")
    return answers.join(concepts, "question_id").groupBy("user_id", "concept").agg(
        F.sum("answers").alias("answers"), (F.sum("right") / F.sum("weight")).alias("mastery_score"))


def concept_vectors(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """(S) One vector per concept, the mean of its questions' vectors: concept, embedding. ``vectors`` is (question_id, embedding)."""
    held = questions.select("question_id", F.explode(F.array_distinct("concepts")).alias("concept")).where("concept is not null")
    return mean_vectors(held.join(vectors.where("embedding is not null"), "question_id"), "concept").withColumnRenamed("query", "embedding")


def nearest_concepts(concepts: DataFrame, k: int, dim: int) -> DataFrame:
    """(S) The k concepts whose vectors are nearest by L2 to each concept's, itself left out: concept, rank, near, distance.

    Concepts are numbered by a hash of their name for the search, so equal distances come in the order of that.
    """
    numbered = cut_lineage(concepts.select(F.xxhash64("concept").alias("id"), "concept", "embedding"))
    found = knn_l2(numbered.select(F.col("id").alias("vec_id"), "embedding"), numbered.select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), k + 1, dim)
    names = numbered.select("id", "concept")
    others = found.where("query_id <> vec_id").join(names.withColumnRenamed("id", "query_id"), "query_id").join(
        names.select(F.col("id").alias("vec_id"), F.col("concept").alias("near")), "vec_id")
    order = Window.partitionBy("concept").orderBy("distance", "near")
    return others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("concept", "rank", "near", "distance")


def recent_progress(progress: DataFrame, last: int = 10) -> DataFrame:
    """(S) The last attempts of each user."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("answered_at"), F.desc("event_id"))
    return progress.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= last)


def conversation_history(turns: DataFrame, last: int = 10) -> DataFrame:
    """(D) The last turns of each conversation, in order."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = turns.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= last)
    return recent.drop("rank").orderBy("conv_id", "turn")


def context_size(turns: DataFrame, parts: int | None = None) -> DataFrame:
    """(D) Tokens of a conversation up to and including each turn (our tokenizer)."""
    order = ["turn"]
    counted = turns.select("conv_id", "turn", F.coalesce(F.size(tokens(F.col("text"))), F.lit(0)).alias("tokens"))
    cut = slices(counted, ["conv_id"], order, parts)
    return running_sum(cut, ["conv_id"], order, F.col("tokens"), "context_tokens").drop("_slice")
