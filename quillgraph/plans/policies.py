"""The parts of the engine that can be replaced, with what stands there by default."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import context, merge, vector

#: A cut of scores (query_id, idx, score).
Cut = Callable[[DataFrame], DataFrame]
Grouper = Callable[[list[str]], list[tuple[list[int], str]]]


def merged_nodes(new: DataFrame, stored: DataFrame, limit: int) -> DataFrame:
    """Descriptions are joined, the most frequent type wins."""
    return merge.merge_entities(new, stored, limit)


def last_nodes(new: DataFrame, stored: DataFrame, limit: int) -> DataFrame:
    """The last row of a name to arrive replaces what is stored."""
    return merge.last_wins(new).select("name", "type", "description", F.lit(False).alias("oversize"))


def merged_edges(new: DataFrame, stored: DataFrame, grouper: Grouper, threshold: int) -> DataFrame:
    """Pairs with more relations than the threshold are regrouped."""
    return merge.merge_edges(new, stored, grouper, threshold)


def added_edges(new: DataFrame, stored: DataFrame, grouper: Grouper, threshold: int) -> DataFrame:
    """New relations are put beside the stored ones, with ids of their own."""
    columns = ["edge_id", "source", "target", "description", "chunks"]
    return stored.select(columns).unionByName(new.select(columns).join(stored.select("edge_id"), "edge_id", "left_anti"))


@dataclass
class Policies:
    """limit: letters of a description from which on the summariser shortens it; threshold: relations of a pair from which on they are grouped.

    entities, relations, chunks: cuts of the scores on the way to a context. search: how alike entities are looked for;
    vector.knn() compares all, ann.searcher() the likely ones.
    """

    nodes: Callable[[DataFrame, DataFrame, int], DataFrame] = merged_nodes
    edges: Callable[[DataFrame, DataFrame, Grouper, int], DataFrame] = merged_edges
    grouper: Grouper = merge.same_description
    limit: int = merge.OVERSIZE
    threshold: int = merge.MERGE_THRESHOLD
    entities: Cut = context.CUTS[0]
    relations: Cut = context.CUTS[1]
    chunks: Cut = context.CUTS[2]
    alike: int = 3
    alike_least: float = 0.9
    search: Callable = vector.knn
