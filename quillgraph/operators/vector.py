"""Vector stores as tables (id, embedding), and searches in them.

Queries meet candidates in the cells of a grid of bounded size, each one matrix product; only the k best of each query
and cell leave it. Scores are (1 + cosine) / 2 by default, or the cosine itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions.vectors import normalised

CANDIDATES_PER_CELL, QUERIES_PER_CELL = 16384, 4096
HALF, COSINE = "half_cosine", "cosine"


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    lists = table.column("v").combine_chunks()
    ids = table.column("id").to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(size) and (size != size[0]).any():
        raise ValueError(f"vectors of {size.min()} and of {size.max()} components are in one store")
    x = flat.reshape(len(ids), int(size[0]) if len(size) else 0)
    return ids, x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _rows(df: DataFrame, within: str | None):
    """How many rows df has, or a table of how many each value has. Columns that are not needed for it are not computed."""
    return df.groupBy(within).agg(F.count("*").alias("n")) if within else df.select("embedding").count()


def knn(queries: DataFrame, store: DataFrame, k: int, metric: str = HALF, digits: int = 12, within: str | None = None) -> DataFrame:
    """queries (query_id long, embedding) x store (id long, embedding) -> query_id, id, score, rank: the k best of the store (all, if it has fewer), ties to the smaller id. Scores are rounded to `digits` before they are ranked. within: a column of both; only rows with equal values in it meet, however many have one value. Null vectors take no part; all others are of one length, or the job fails."""
    n, m = _rows(store, within), _rows(queries, within)
    group, keys = ([F.col(within).alias("_g")], ["_g"]) if within else ([], [])
    cells = lambda c: F.greatest(F.ceil(c), F.lit(1)).cast("int")
    if within:  # each value has as many cells as its own rows fill
        sizes = n.withColumnRenamed("n", "_n").join(m.withColumnRenamed("n", "_m"), within)
        n_cells, q_cells = cells(F.col("_n") / CANDIDATES_PER_CELL), cells(F.col("_m") / QUERIES_PER_CELL)
        queries, store = queries.join(sizes, within), store.join(sizes, within)
    else:
        n_cells, q_cells = F.lit(-(-n // CANDIDATES_PER_CELL) or 1), F.lit(-(-m // QUERIES_PER_CELL) or 1)
    cell = lambda c, count: F.pmod(F.xxhash64(c), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    left = queries.where("embedding IS NOT NULL").select(*group, every(n_cells).alias("c"), cell(F.col("query_id"), q_cells).alias("q"), F.col("query_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    right = store.where("embedding IS NOT NULL").select(*group, cell(F.col("id"), n_cells).alias("c"), every(q_cells).alias("q"), F.col("id").cast("long").alias("id"), F.col("embedding").alias("v"))

    def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if a.num_rows and b.num_rows:
            (q_ids, q), (ids, x) = _matrix(a), _matrix(b)
            if q.shape[1] != x.shape[1]:
                raise ValueError(f"queries of {q.shape[1]} components, vectors of {x.shape[1]}")
            take = min(k, len(ids))
            found = []
            for at in range(0, len(q), 256):
                s = np.round(q[at : at + 256] @ x.T, digits)
                for q_id, row in zip(q_ids[at : at + 256], s):
                    some = np.flatnonzero(row >= np.partition(row, len(row) - take)[len(row) - take]) if take else np.zeros(0, np.int64)
                    some = some[np.lexsort((ids[some], -row[some]))][:take]
                    found.append((np.full(len(some), q_id), ids[some], row[some]))
            out = [np.concatenate([f[i] for f in found]) for i in range(3)]
        own = {within: pa.repeat(key[0], len(out[0]))} if within else {}
        return pa.table({**own, "query_id": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    schema = T.StructType([store.schema[within], *T.StructType.fromDDL("query_id long, id long, score double").fields]) if within else "query_id long, id long, score double"
    met = left.groupBy(*keys, "c", "q").cogroup(right.groupBy(*keys, "c", "q")).applyInArrow(meet, schema)
    best = met.withColumn("rank", F.row_number().over(Window.partitionBy(*([within] if within else []), "query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return best if metric == COSINE else best.withColumn("score", (F.col("score") + 1) / 2)


def score_all(queries: DataFrame, store: DataFrame, k: int = 1, threshold: float | None = None, metric: str = HALF) -> DataFrame:
    """The k best of each query whose score reaches the threshold: query_id, idx, score."""
    found = knn(queries, store, k, metric)
    return (found if threshold is None else found.where(F.col("score") >= threshold)).select("query_id", F.col("id").alias("idx"), "score")


def normalise_scores(scores: DataFrame) -> DataFrame:
    """Each query's scores over their sum, which is added up before anything is joined."""
    total = scores.groupBy("query_id").agg(F.sum("score").alias("_total"))
    return scores.join(total, "query_id").withColumn("score", F.col("score") / (F.col("_total") + 1e-8)).drop("_total")


def strongest(scores: DataFrame, by: str = "query_id") -> DataFrame:
    """For each `by` and idx the highest score."""
    return scores.groupBy(by, "idx").agg(F.max("score").alias("score"))


def upsert(store: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """The store with new rows put in by id, replacing those of the same id; of new rows with one id the last in `order`. change tells update, insert or keep. Vectors are normalised."""
    if order:
        new = new.groupBy("id").agg(F.max_by("embedding", order).alias("embedding"))
    a, b = store.select("id", F.col("embedding").alias("_old")), new.select("id", normalised(F.col("embedding")).alias("_new"))
    change = F.when(F.col("_new").isNull(), "keep").when(F.col("_old").isNull(), "insert").otherwise("update")
    return a.join(b, "id", "full").select("id", F.coalesce("_new", F.col("_old").cast("array<double>")).alias("embedding"), change.alias("change"))


def delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id").distinct(), "id", "left_anti")


def query(queries: DataFrame, store: DataFrame, k: int = 10, least: float | None = None, where: Column | None = None) -> DataFrame:
    """Cosine search among the rows of the store that meet a condition."""
    found = knn(queries, store if where is None else store.where(where), k, COSINE)
    return found if least is None else found.where(F.col("score") >= least)


def tenant_query(queries: DataFrame, store: DataFrame, k: int, digits: int = 12) -> DataFrame:
    """queries and store with a tenant column: the k best of the query's own tenant, by cosine: tenant, query_id, id, score, rank. A large tenant is split into cells like any store."""
    return knn(queries, store, k, COSINE, digits, within="tenant").select("tenant", "query_id", "id", "score", "rank")
