"""From questions to weights of entities, for many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import generic_text
from quillgraph.operators import vector

NAMED_LEAST, GENERIC_LEAST, GENERIC_K = 0.7, 0.5, 20


def query_texts(questions: DataFrame) -> DataFrame:
    """questions (query_id, text, named, generic) -> query_id, kind, text: named ones as they are, generic ones marked, and the question itself last."""
    named = questions.select("query_id", F.lit("named").alias("kind"), F.explode("named").alias("text"))
    generic = questions.select("query_id", F.lit("generic").alias("kind"), F.explode("generic").alias("text")).withColumn("text", generic_text(F.col("text")))
    return named.unionAll(generic).unionAll(questions.select("query_id", F.lit("question"), "text"))


def entity_weights(texts: DataFrame, store: DataFrame, named_least: float = NAMED_LEAST, generic_least: float = GENERIC_LEAST, k: int = GENERIC_K) -> DataFrame:
    """texts (text_id, query_id, kind, embedding) and store (id, embedding) -> query_id, idx, score.

    Named entities have one hit, the others up to k; the hits of a text weigh 1 together; an entity gets its highest weight.
    """
    ask = lambda df: df.select(F.col("text_id").alias("query_id"), "embedding")
    named = vector.score_all(ask(texts.where("kind = 'named'")), store, 1, named_least)
    others = vector.score_all(ask(texts.where("kind <> 'named'")), store, k, generic_least)
    scores = vector.normalise_scores(named.unionAll(others)).withColumnRenamed("query_id", "text_id")
    return vector.strongest(scores.join(texts.select("text_id", "query_id"), "text_id"))


def naive(queries: DataFrame, store: DataFrame, texts: DataFrame, k: int = 8) -> DataFrame:
    """Plain vector retrieval: the k nearest of each query by cosine, with their texts."""
    return vector.knn(queries, store, k, vector.COSINE).join(texts, "id").select("query_id", "rank", "id", "score", "text")


def perfect_retrieval(results: DataFrame) -> DataFrame:
    """results (evidence, truth, multihop) -> n, perfect, mean_recall for all queries and multihop ones: perfect is the share of queries all of whose true titles were found."""
    recall = F.when(F.size("truth") > 0, F.size(F.array_intersect("truth", "evidence")) / F.size(F.array_distinct("truth"))).otherwise(F.lit(0.0))
    rows = results.withColumn("recall", recall)
    groups = rows.select(F.lit("all").alias("subset"), "recall").unionAll(rows.where("multihop").select(F.lit("multihop"), "recall"))
    return groups.groupBy("subset").agg(F.count("*").alias("n"), F.avg(F.when(F.col("recall") == 1, 1.0).otherwise(0.0)).alias("perfect"), F.avg("recall").alias("mean_recall"))
