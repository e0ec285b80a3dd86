"""Ranking policies over scores (query_id, idx, score): an absent row is a score of 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by_score():
    return Window.partitionBy("query_id").orderBy(F.desc("score"), "idx")


def identity(scores: DataFrame) -> DataFrame:
    """The policy that cuts nothing."""
    return scores


def sorted_scores(scores: DataFrame) -> DataFrame:
    """Nonzero scores with their rank from 1, best first, ties by idx."""
    return scores.where("score <> 0").withColumn("rank", F.row_number().over(_by_score()))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best nonzero scores; all of them for k = 0."""
    scores = scores.where("score <> 0")
    return scores if k == 0 else scores.withColumn("_r", F.row_number().over(_by_score())).where(F.col("_r") <= k).drop("_r")


def threshold(scores: DataFrame, least: float = 0.05, most: int = 128) -> DataFrame:
    """Scores of at least `least`, and of those the `most` best (all for 0)."""
    return top_k(scores.where(F.col("score") >= least), most)


def elbow(scores: DataFrame) -> DataFrame:
    """Scores above the largest gap between neighbours in ascending order, the first such gap; a single score stays. Of equal scores all but one stay."""
    up = Window.partitionBy("query_id").orderBy("score", F.desc("idx"))
    whole = Window.partitionBy("query_id")
    rows = scores.where("score <> 0").withColumns({"_r": F.row_number().over(up), "_gap": F.lead("score").over(up) - F.col("score")})
    rows = rows.withColumn("_cut", F.min(F.when(F.col("_gap").isNotNull(), F.struct((-F.col("_gap")).alias("g"), F.col("_r").alias("r")))).over(whole)["r"])
    return rows.where("_cut IS NULL OR _r > _cut").drop("_r", "_gap", "_cut")
