"""Approximate nearest neighbours: an inverted file of cells around centres.

Centres are found by k-means in numpy on a bounded sample. Every vector is put into the cell of its nearest centre; a
query is compared, exactly, with the vectors of the cells whose centres are nearest to it, as many as a full search of
the sample shows to be needed. Cells that hold very many vectors are split among tasks, so no cell has to fit into one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.vector import COSINE, HALF, knn
from quillgraph.sources.scratch import Scratch

#: Centres are fitted on so many vectors at most; there are so many at most (each sent to all tasks).
SAMPLE_VECTORS, MOST_CENTRES = 50_000, 4096
ROUNDS, VECTORS_PER_CELL = 8, 1000
#: The number of probed cells is set so that so many of the NEAREST of PROBED sampled queries are in them.
TARGET, NEAREST, PROBED = 0.95, 10, 500


def _unit(lists: pa.ListArray) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in lists.to_pylist()]) if len(lists) else np.zeros((0, 1))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centres_of(x: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """n centres of unit vectors by k-means on the sphere; a centre that nothing is near takes a vector at random."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:n]]
    for _ in range(ROUNDS):
        near = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.maximum(size, 1e-300), x[rng.integers(0, len(x), len(centres))])
    return centres


def probes_for(x: np.ndarray, centres: np.ndarray) -> int:
    """How many cells are to be probed for TARGET of the nearest, by a full search of the sample x."""
    asked = x[np.linspace(0, len(x) - 1, min(PROBED, len(x))).astype(np.int64)]
    cell = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
    need = []
    for q in asked:
        order = np.argsort(-(centres @ q), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        score = x @ q
        need.append(place[cell[np.argpartition(-score, min(NEAREST, len(x) - 1))[: NEAREST + 1]]])  # itself one of them
    return int(np.quantile(np.concatenate(need), TARGET + (1 - TARGET) / 2, method="higher")) + 1


@dataclass
class Index:
    """cells: id, embedding, cell of every vector; centres: one row a cell; probes: how many cells of a query hold TARGET of its nearest in the sample."""

    cells: DataFrame
    centres: np.ndarray
    probes: int = 1


def build(store: DataFrame, n_cells: int | None = None) -> Index:
    """An index of store (id, embedding). Null vectors have no place in it. The table of cells is written once."""
    spark = store.sparkSession
    scratch = Scratch(spark, "ann")
    store = store.where("embedding IS NOT NULL").select("id", "embedding")
    n = store.count()
    n_cells = n_cells or min(max(n // VECTORS_PER_CELL, int(np.sqrt(n)), 1), MOST_CENTRES)
    sample = store.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE_VECTORS / max(n, 1))) + 1)
    x = _unit(sample.select("embedding").toArrow().column(0).combine_chunks())
    centres = centres_of(x, min(n_cells, max(len(x), 1))) if len(x) else np.zeros((1, 0))  # an empty index has one cell
    return Index(scratch.table(_placed(store, centres, 1)), centres, probes_for(x, centres) if len(x) else 1)


def _placed(rows: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """rows (id, embedding) with each of the n nearest cells."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        c = shared.value
        take = min(n, len(c))
        for batch in batches:
            s = _unit(batch.column("embedding")) @ c.T if batch.num_rows and c.shape[1] else np.zeros((batch.num_rows, len(c)))
            best = np.argpartition(-s, take - 1, axis=1)[:, :take] if len(c) > take else np.tile(np.arange(len(c)), (len(s), 1))
            row = pa.array(np.repeat(np.arange(len(s)), take))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(row), batch.column("embedding").take(row), pa.array(best.reshape(-1).astype(np.int32))], names=["id", "embedding", "cell"])

    return rows.select("id", "embedding").mapInArrow(run, f"id {kinds['id']}, embedding {kinds['embedding']}, cell int")


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, metric: str = HALF) -> DataFrame:
    """queries (query_id, embedding) -> query_id, id, score, rank: the k best of the probed cells (by default index.probes), ties to the smaller id."""
    probes = probes or index.probes
    asked = _placed(queries.where("embedding IS NOT NULL").select(F.col("query_id").alias("id"), "embedding"), index.centres, probes).withColumnRenamed("id", "query_id")
    found = knn(asked, index.cells, k, COSINE, within="cell")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    best = best if metric == COSINE else best.withColumn("score", (F.col("score") + 1) / 2)
    return best.select("query_id", "id", "score", "rank")


def searcher(probes: int | None = None):
    """search() in the form of vector.knn(), with an index of its own: for Policies.search."""
    return partial(_search, probes=probes)


def _search(queries: DataFrame, store: DataFrame, k: int, probes: int | None) -> DataFrame:
    return search(build(store), queries, k, probes)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact hits (query_id, id) that were found."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id").withColumn("_hit", F.lit(1)), ["query_id", "id"], "left")
    return float(hits.agg(F.avg(F.coalesce("_hit", F.lit(0)))).first()[0] or 0.0)
