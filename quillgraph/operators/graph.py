"""The knowledge graph as two tables: entities by name, and relations (edge_id, source, target, description, chunks).

The graph is undirected and may have several relations between two entities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.order import with_position
from quillgraph.sources.scratch import Scratch, small

DAMPING = 0.85
#: Graphs of at most so many relations (and BROADCAST_BYTES) are sent to all tasks, which solve questions of their own in numpy; larger ones are solved by joins.
LOCAL_EDGES = 500_000
#: In each round of those joins a number for each question is broadcast, if there are so many questions at most.
LOCAL_QUESTIONS = 50_000


def entity_relations(relations: DataFrame) -> DataFrame:
    """name, edge_id, weight: how often an entity is an end of a relation (a loop counts twice)."""
    ends = relations.select(F.explode(F.array("source", "target")).alias("name"), "edge_id")
    return ends.groupBy("name", "edge_id").agg(F.count("*").alias("weight"))


def relation_chunks(relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """edge_id, chunk_id, weight for chunks that exist."""
    held = relations.select("edge_id", F.explode("chunks").alias("chunk_id"))
    return held.join(chunks.select(F.col("id").alias("chunk_id")).distinct(), "chunk_id", "left_semi").groupBy("edge_id", "chunk_id").agg(F.count("*").alias("weight"))


def edges_between(relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Relations from the first to the second of each (source, target), in that order."""
    return relations.join(pairs.select("source", "target").distinct(), ["source", "target"], "left_semi")


def nodes(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (pos, name) with type and description of each entity, null where there is none."""
    return asked.join(entities.select("name", "type", "description"), "name", "left").select("pos", "name", "type", "description")


def insert_edges(relations: DataFrame, edges: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """relations with all edges (edge_id, source, target, description, chunks) put beside them, whatever pairs they tie.

    Edges may name their ends by position instead (source_pos and target_pos, from 0 in the order of names), if entities
    are given; both at once are an error. No edges: the relations as they are.
    """
    by_position = {"source_pos", "target_pos"} <= set(edges.columns)
    if by_position == ({"source", "target"} <= set(edges.columns)) or by_position and entities is None:
        raise ValueError("edges name their ends either by source and target, or by position among given entities")
    if by_position:
        place = with_position(entities.select("name").distinct(), F.col("name"))
        end = lambda c: place.select(F.col("pos").alias(f"{c}_pos"), F.col("name").alias(c))
        edges = edges.join(end("source"), "source_pos").join(end("target"), "target_pos")
    return relations.unionByName(edges.select(relations.columns))


def not_adjacent(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """Pairs (source, target) that no relation ties in either direction."""
    ends = lambda df: df.withColumns({"_a": F.least("source", "target"), "_b": F.greatest("source", "target")})
    return ends(pairs).join(ends(relations).select("_a", "_b").distinct(), ["_a", "_b"], "left_anti").drop("_a", "_b")


def _both_ways(relations: DataFrame) -> DataFrame:
    """u, v, w: the share of u's mass that goes to v."""
    pairs = relations.select(F.col("source").alias("u"), F.col("target").alias("v"))
    pairs = pairs.unionAll(relations.select(F.col("target").alias("u"), F.col("source").alias("v"))).groupBy("u", "v").agg(F.count("*").alias("n"))
    degree = pairs.groupBy("u").agg(F.sum("n").alias("d"))
    return pairs.join(degree, "u").select("u", "v", (F.col("n") / F.col("d")).alias("w"))


def _sorted_join(side: DataFrame) -> DataFrame:
    """A side that is never broadcast: in each of many rounds it would pass through the driver."""
    return side.hint("merge")


_SCORED = "query_id long, idx string, score double"


def _solve(shared, rounds: int, damping: float):
    """For mapInArrow over (query_id, name, weight), the rows of a question one after another: the scores of one question at a time."""

    def solved(names: np.ndarray, place: dict, links, query: int, seeds: dict[str, float]) -> pa.RecordBatch:
        u, v, w = links
        extra = [n for n in seeds if n not in place]
        size = len(names) + len(extra)
        at = [place[n] if n in place else len(names) + extra.index(n) for n in seeds]
        reset = np.bincount(at, list(seeds.values()), size)
        reset /= reset.sum()
        p = reset
        for _ in range(rounds):
            moved = np.bincount(v, p[u] * w, size)
            p = damping * moved + (1 - damping * moved.sum()) * reset
        some = np.flatnonzero(p)
        known = pa.array(np.concatenate([names, np.array(extra, object)])[some], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), query), pa.int64()), known, pa.array(p[some])], names=["query_id", "idx", "score"])

    def run(batches):
        names, *links = shared.value
        place = {n: i for i, n in enumerate(names)}
        now, seeds = None, {}
        for batch in batches:
            for query, name, weight in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if query != now:
                    if seeds:
                        yield solved(names, place, links, now, seeds)
                    now, seeds = query, {}
                seeds[name] = seeds.get(name, 0.0) + weight
        if seeds:
            yield solved(names, place, links, now, seeds)

    return run


def personalized_pagerank(relations: DataFrame, seeds: DataFrame, rounds: int = 20, damping: float = DAMPING, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """seeds (query_id, name, weight > 0) -> query_id, idx, score: the mass of each entity after so many rounds, all queries at once.

    In a round an entity gives `damping` of its mass to its neighbours, one share for each relation; the rest, and what
    entities without relations hold, returns to the seeds in proportion to their weights.
    """
    links = _both_ways(relations)
    scratch = Scratch(relations.sparkSession, "pagerank")
    links = scratch.table(links)
    if small(links, 2 * local_edges):  # each relation is two links at most
        table = links.toArrow()
        ends = [np.array(table.column(c).to_pylist(), object) for c in ("u", "v")]
        names, index = np.unique(np.concatenate([*ends, np.zeros(0, object)]), return_inverse=True)
        shared = scratch.spark.sparkContext.broadcast((names, index[: len(ends[0])].astype(np.int32), index[len(ends[0]) :].astype(np.int32), table.column("w").to_numpy()))
        asked = seeds.select("query_id", "name", F.col("weight").cast("double")).repartition(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), "query_id").sortWithinPartitions("query_id")
        return asked.mapInArrow(_solve(shared, rounds, damping), _SCORED)
    total = scratch.table(seeds.groupBy("query_id").agg(F.sum("weight").alias("total")))
    by_question = F.broadcast if small(total, LOCAL_QUESTIONS) else _sorted_join
    reset = scratch.table(seeds.groupBy("query_id", "name").agg(F.sum("weight").alias("w0")).join(total, "query_id").select("query_id", F.col("name").alias("idx"), (F.col("w0") / F.col("total")).alias("r")))
    p = reset.withColumnRenamed("r", "score")
    for i in range(rounds):
        moved = _sorted_join(p).join(_sorted_join(links), p["idx"] == links["u"]).groupBy("query_id", "v").agg(F.sum(F.col("score") * F.col("w")).alias("score"))
        moved = scratch.table(moved.select("query_id", F.col("v").alias("idx"), (F.col("score") * damping).alias("score")))
        left = reset.join(by_question(moved.groupBy("query_id").agg(F.sum("score").alias("gone"))), "query_id", "left").select("query_id", "idx", ((1 - F.coalesce("gone", F.lit(0.0))) * F.col("r")).alias("score"))
        p = moved.unionAll(left).groupBy("query_id", "idx").agg(F.sum("score").alias("score"))
        if i % 4 == 3:
            p = scratch.table(p)
    return p


def pagerank(entities: DataFrame, relations: DataFrame, rounds: int = 20, damping: float = DAMPING) -> DataFrame:
    """Global PageRank: every entity is a seed of equal weight. An empty graph has no rows."""
    return personalized_pagerank(relations, entities.select(F.lit(0).cast("long").alias("query_id"), "name", F.lit(1.0).alias("weight")), rounds, damping)


def graphml_rows(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """The lines of the graph's nodes and edges in GraphML: part (1 nodes, 2 edges), key, line."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    data = lambda k, c: F.concat(F.lit(f'<data key="{k}">'), safe(F.col(c).cast("string")), F.lit("</data>"))
    nodes = entities.select(F.lit(1).alias("part"), F.col("name").alias("key"), F.concat(F.lit('<node id="'), safe(F.col("name")), F.lit('">'), data("type", "type"), data("description", "description"), F.lit("</node>")).alias("line"))
    edges = relations.select(F.lit(2).alias("part"), F.col("edge_id").cast("string").alias("key"), F.concat(F.lit('<edge source="'), safe(F.col("source")), F.lit('" target="'), safe(F.col("target")), F.lit('">'), data("relation", "description"), F.lit("</edge>")).alias("line"))
    return nodes.unionAll(edges)


def write_graphml(entities: DataFrame, relations: DataFrame, path: str) -> None:
    """One GraphML file on the driver; rows stream through it and are never held together."""
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        for kind, name in (("node", "type"), ("node", "description"), ("edge", "relation")):
            f.write(f'<key id="{name}" for="{kind}" attr.name="{name}" attr.type="string"/>\n')
        f.write('<graph edgedefault="undirected">\n')
        for row in graphml_rows(entities, relations).orderBy("part", "key").toLocalIterator():
            f.write(row["line"] + "\n")
        f.write("</graph>\n</graphml>\n")
