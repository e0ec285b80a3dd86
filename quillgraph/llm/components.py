"""Connected components of links by union-find within tasks and star contraction between them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.sources.scratch import Scratch
from quillgraph.llm.textbytes import mapped


#: Trees of so many edges at most, left over by all tasks, are joined by one; more by star contraction.
LOCAL_EDGES = 250_000


def _forest(batches):
    """Union-find over one task's links: each node but the smallest of its tree, with that smallest one."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            x, parent[x] = parent[x], root
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = sorted((find(a), find(b)))
            parent.setdefault(a, a)
            parent[b] = a
    pairs = [(x, r) for x in parent if (r := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["node", "root"])


def connected(scratch: Scratch, links: DataFrame) -> DataFrame:
    """links (two columns of node numbers) -> node, root: every linked node but the smallest of each component, with that smallest one.

    Each task first reduces its links to a forest. If LOCAL_EDGES edges at most are left, one task joins the trees. Else,
    until nothing changes, every node's larger neighbours and next its smaller ones are tied to the smallest neighbour;
    the number of rounds grows with the logarithm of a component's size. Minima are aggregated before they are shuffled, and are written before they are joined, so that a node with
    very many links is split over tasks. Loops and repeated links do nothing; no links: no rows.
    """
    a, b = links.columns
    edges = scratch.table(links.select(a, b).where(F.col(a) != F.col(b)).transform(mapped, _forest, "node long, root long").distinct())
    if edges.count() <= LOCAL_EDGES:
        return scratch.table(edges.coalesce(1).transform(mapped, _forest, "node long, root long"))
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root") % 1_000_000_007)).first()
        if now == mark or not now[0]:
            return edges
        mark = now
        both = edges.union(edges.select("root", "node")).toDF("u", "v")
        least = scratch.table(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = scratch.table(both.where("v > u").join(least, "u").select(F.col("v").alias("node"), F.col("m").alias("root")).where("node <> root").distinct())
        low = scratch.table(large.groupBy("node").agg(F.min("root").alias("m")))
        tied = large.join(low, "node").select(F.col("root").alias("node"), F.col("m").alias("root")).where("node <> root")
        after = scratch.table(tied.union(low.select("node", "m")).distinct())
        for old in (edges, least, large, low):
            scratch.drop(old)
        edges = after
