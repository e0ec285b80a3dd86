"""Merging extracted entities and relations into the graph. `ord` is a total order of arrival (document, chunk, mention)."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.batches import mapped, packed
from quillgraph.operators.graph import not_adjacent
from quillgraph.operators.vector import knn

OVERSIZE, MERGE_THRESHOLD = 512, 5


def merge_entities(new: DataFrame, stored: DataFrame | None = None, limit: int = OVERSIZE) -> DataFrame:
    """new (ord, name, type, description) and stored (name, type, description) -> name, type, description, oversize: a row for each new name.

    Descriptions are joined by line feeds in order of arrival, the stored one last; the type is the most frequent one, of
    equals the first to arrive. oversize marks descriptions that a summariser should shorten. All descriptions of a name
    meet in one row, as its description is one text: that is as long as the graph's users let it grow, see plans.policies.
    """
    rows = new.select("name", "type", "description", F.lit(0).alias("_late"), "ord")
    if stored is not None:
        known = stored.join(new.select("name").distinct(), "name", "left_semi")
        rows = rows.unionByName(known.select("name", "type", "description", F.lit(1).alias("_late"), F.lit(None).cast(new.schema["ord"].dataType).alias("ord")))
    types = rows.groupBy("name", "type").agg(F.count("*").alias("n"), F.min(F.struct("_late", "ord")).alias("first"))
    kind = types.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "type")).alias("t")).select("name", F.col("t.type").alias("type"))
    texts = rows.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_late", "ord", "description"))), lambda x: x["description"]), "\n").alias("description"))
    return kind.join(texts, "name").withColumn("oversize", F.length("description") > limit)


def last_wins(new: DataFrame) -> DataFrame:
    """Of rows (ord, name, ...) with one name, the last to arrive."""
    rest = [c for c in new.columns if c != "name"]
    return new.groupBy("name").agg(F.max_by(F.struct(*rest), "ord").alias("_x")).select("name", *[F.col(f"_x.{c}").alias(c) for c in rest if c != "ord"])


def valid_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    names = entities.select("name").distinct()
    return edges.join(names.withColumnRenamed("name", "source"), "source", "left_semi").join(names.withColumnRenamed("name", "target"), "target", "left_semi").select(edges.columns)


def edge_groups(new: DataFrame, stored: DataFrame, threshold: int = MERGE_THRESHOLD) -> DataFrame:
    """new and stored edges (edge_id, source, target, description) -> source, target, n_stored, n_new, merge, listing: a row for each ordered pair with a new edge.

    merge: stored and new are more than the threshold. listing: "position, description" lines, stored edges first.
    """
    rows = stored.select("source", "target", "edge_id", "description", F.lit(0).alias("_new")).unionByName(new.select("source", "target", "edge_id", "description", F.lit(1).alias("_new")))
    group = rows.groupBy("source", "target").agg((F.count("*") - F.sum("_new")).alias("n_stored"), F.sum("_new").alias("n_new"), F.array_sort(F.collect_list(F.struct("_new", "edge_id", "description"))).alias("e")).where("n_new > 0")
    listing = F.array_join(F.transform("e", lambda x, i: F.concat(i.cast("string"), F.lit(", "), x["description"])), "\n")
    return group.select("source", "target", "n_stored", "n_new", (F.col("n_stored") + F.col("n_new") > threshold).alias("merge"), listing.alias("listing"))


def same_description(descriptions: list[str]) -> list[tuple[list[int], str]]:
    """The offline grouping: edges of one description, which stays."""
    groups: dict[str, list[int]] = {}
    for i, d in enumerate(descriptions):
        groups.setdefault(d, []).append(i)
    return [(ids, d) for d, ids in groups.items()]


def apply_groups(edges: list[dict], groups: list[tuple[list[int], str]]) -> list[dict]:
    """Edges of one pair (stored ones first) after merging the groups (positions, new description), in the groups' order.

    Positions that are none of theirs are ignored, negative ones too, and groups of fewer than two. The first of a group gets the description and
    all chunks of the group and stays, even if an earlier group dropped it; the others go.
    """
    kept = {i: dict(e) for i, e in enumerate(edges)}
    gone: set[int] = set()
    for ids, description in groups:
        ids = [i for i in dict.fromkeys(ids) if 0 <= i < len(edges)]
        if len(ids) < 2:
            continue
        first, *rest = ids
        kept[first]["description"] = description
        kept[first]["chunks"] = sorted({c for i in ids for c in kept[i]["chunks"] or []})
        gone.update(rest)
        gone.discard(first)
    return [e for i, e in kept.items() if i not in gone]


def merge_edges(new: DataFrame, stored: DataFrame, grouper: Callable[[list[str]], list[tuple[list[int], str]]] = same_description, threshold: int = MERGE_THRESHOLD) -> DataFrame:
    """All edges (edge_id, source, target, description, chunks) after the new ones are merged into the stored.

    Pairs with more edges than the threshold, of which at least one is new, are regrouped; the edges of other pairs are
    kept, and never pass through Python.
    """
    columns = ["edge_id", "source", "target", "description", "chunks"]
    rows = stored.select(*columns, F.lit(0).alias("_new")).unionByName(new.select(*columns, F.lit(1).alias("_new")))
    pair = Window.partitionBy("source", "target")
    rows = rows.withColumn("_merge", (F.count("*").over(pair) > threshold) & (F.max("_new").over(pair) == 1))
    if grouper is same_description:
        return _one_of_each_description(rows)
    grouped = rows.where("_merge").groupBy("source", "target").agg(F.array_sort(F.collect_list(F.struct("_new", "edge_id", "description", "chunks"))).alias("e"))
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64())]

    def merged_rows(batch):
        for source, target, edges in (map(lambda x: x.as_py(), row) for row in zip(*[batch.column(c) for c in ("source", "target", "e")])):
            for e in apply_groups(edges, grouper([x["description"] for x in edges])):
                yield e["edge_id"], source, target, e["description"], e["chunks"]

    def run(batches):
        for batch in batches:
            yield from packed(merged_rows(batch), columns, kinds)

    merged = grouped.transform(mapped, run, "edge_id long, source string, target string, description string, chunks array<long>")
    return rows.where("NOT _merge").select(columns).unionByName(merged)


def _one_of_each_description(rows: DataFrame) -> DataFrame:
    """What merge_edges() makes of rows (edges, _new, _merge) by same_description(): no edge of it passes through Python.

    Of a merged pair's edges with one description the first stays, with all their chunks; an edge of its own keeps its
    chunks as they are, and so do all edges of other pairs.
    """
    alone = F.when(~F.col("_merge"), F.monotonically_increasing_id())
    first = F.min(F.struct("_new", "edge_id", "chunks")).alias("_first")
    groups = rows.withColumn("_alone", alone).groupBy("source", "target", "description", "_alone").agg(first, F.count("*").alias("_n"), F.flatten(F.collect_list("chunks")).alias("_all"))
    chunks = F.when(F.col("_n") > 1, F.array_sort(F.array_distinct("_all"))).otherwise(F.col("_first.chunks"))
    return groups.select(F.col("_first.edge_id").alias("edge_id"), "source", "target", "description", chunks.alias("chunks"))


def identity_edges(vectors: DataFrame, relations: DataFrame, k: int = 3, least: float = 0.9, fresh: DataFrame | None = None, search: Callable = knn) -> DataFrame:
    """vectors (id, name, embedding) -> source, target, description "is", chunks []: each entity and those of its k nearest (itself one of them) that are alike, come later and aren't adjacent yet.

    fresh: only these entities (id, embedding) are asked about, by default all. search: knn(), or an approximate one.
    """
    asked = (vectors if fresh is None else fresh).select(F.col("id").alias("query_id"), "embedding")
    found = search(asked, vectors, k).where(F.col("score") >= least)
    found = found.where(F.col("id") > F.col("query_id")) if fresh is None else found.where(F.col("id") != F.col("query_id")).select(F.least("id", "query_id").alias("query_id"), F.greatest("id", "query_id").alias("id"), "score").dropDuplicates(["query_id", "id"])
    names = vectors.select("id", "name")
    pairs = found.join(names.select(F.col("id").alias("query_id"), F.col("name").alias("source")), "query_id").join(names.withColumnRenamed("name", "target"), "id")
    return not_adjacent(pairs.select("source", "target"), relations).select("source", "target", F.lit("is").alias("description"), F.array().cast("array<bigint>").alias("chunks"))
