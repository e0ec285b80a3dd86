"""Exact top-k by inner product: branch and bound over dimension blocks in vertical layout.

Queries and candidates meet in the cells of a grid of bounded size. In a cell, scores are accumulated one block of
dimensions at a time; what the remaining dimensions can still add is bounded by the product of the remaining norms
(Cauchy-Schwarz), and candidates whose best case is below the k-th best worst case are dropped from the arrays. What
is left is scored in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.sources.scratch import Scratch

CANDIDATES_PER_CELL = 4096
QUERIES_PER_CELL = 4096
DIMENSIONS_PER_BLOCK = 16


def quantised(vector: Column) -> Column:
    """floor(256 * x) of every component, x as double; null if the vector or a component is null or not finite."""
    fine = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * 256)))


def search(queries: np.ndarray, query_rows: np.ndarray, candidates: np.ndarray, rows: np.ndarray, k: int, ids: np.ndarray | None = None, block: int = DIMENSIONS_PER_BLOCK) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (a vector of integers) the positions and scores of its k best candidates, best first, ties to the smaller id (by default the row) and then row.

    query_rows and rows tell rows apart: a query's own is no candidate. Partial sums are doubles with a bound of their
    rounding error; what the bounds leave is scored in whole numbers. A score that is no 64-bit number is an error.
    """
    ids = rows if ids is None else ids
    d = candidates.shape[1]
    order = np.argsort(-(candidates.astype(float) ** 2).sum(axis=0), kind="stable")  # heavy dimensions first
    table, q_rows = np.ascontiguousarray(candidates.T[order].astype(float)), queries[:, order].astype(float)
    cuts = list(range(0, d, block)) + [d]
    mass = lambda x: np.sqrt(np.concatenate([np.cumsum((x**2)[::-1], axis=0)[::-1], np.zeros((1, x.shape[1]))]))
    c_left, q_left = mass(table), mass(q_rows.T)
    rounding = (d + 4) * 2.0**-50
    out = []
    first = cuts[1] if d else 0
    for at in range(0, len(queries), 256):
        part = q_rows[at : at + 256]
        scores = part[:, :first] @ table[:first]
        for i, q in enumerate(part):
            score = scores[i]
            alive = np.flatnonzero(rows != query_rows[at + i])
            score = score[alive]
            for lo, hi in zip(cuts[1:], [*cuts[2:], d]):
                alive, score = _survivors(alive, score, q_left[lo, at + i] * c_left[lo][alive] * (1 + 1e-9) + q_left[0, at + i] * c_left[0][alive] * rounding + 1e-6, k)
                if hi > lo:
                    score = score + q[lo:hi] @ table[lo:hi, alive]
            alive, score = _survivors(alive, score, q_left[0, at + i] * c_left[0][alive] * rounding, k)
            exact = _exact(queries[at + i], candidates[alive])
            best = np.lexsort((rows[alive], ids[alive], -exact))[:k] if exact.dtype != object else np.array(sorted(range(len(alive)), key=lambda j: (-exact[j], ids[alive[j]], rows[alive[j]]))[:k], np.int64)
            out.append((alive[best], exact[best].astype(np.int64)))  # an error beyond 64 bits
    return out


def _survivors(alive: np.ndarray, score: np.ndarray, slack: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Those whose best case is not below the k-th best worst case."""
    if len(alive) <= k:
        return alive, score
    least = np.partition(score - slack, len(alive) - k)[len(alive) - k]
    stay = np.flatnonzero(score + slack >= least)
    return alive[stay], score[stay]


def _exact(query: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers of as many bits as they take."""
    if float(np.abs(query.astype(float)).sum()) * float(np.abs(candidates.astype(float)).max(initial=0)) < 2**62:
        return candidates @ query
    return np.array([sum(a * b for a, b in zip(query.tolist(), c)) for c in candidates.tolist()], object)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score: for rows whose id `every` divides, the k best other rows.

    Vectors that are null, or hold a null or non-finite component, or whose id is null, take no part. Of rows with one id,
    each is a candidate, also for another one that is a query, and each is a query. Vectors of unequal length: missing
    components are 0. Fewer than k others: all. No rows: no rows. Other columns are dropped.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", quantised(F.col("embedding")).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = Scratch(spark, "vectors").table(rows.withColumn("row", F.monotonically_increasing_id()))
    n = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    n_cells, q_cells = -(-n[0] // CANDIDATES_PER_CELL) or 1, -(-n[1] // QUERIES_PER_CELL) or 1
    cell = lambda c, m, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(m)).cast("int")
    to_all = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = rows.select(cell(F.col("row"), n_cells, 1).alias("c"), to_all(q_cells).alias("q"), "row", "vec_id", "v")
    queries = rows.where(F.col("vec_id") % every == 0).select(to_all(n_cells).alias("c"), cell(F.col("row"), q_cells, 2).alias("q"), "row", "vec_id", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_row": [], "query_id": [], "row": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            (q_rows, q_ids, q), (c_rows, c_ids, c) = _matrix(left), _matrix(right)
            d = max(q.shape[1], c.shape[1])
            q, c = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (q, c))
            found = search(q, q_rows, c, c_rows, k, c_ids)
            times, at = [len(f[0]) for f in found], np.concatenate([f[0] for f in found])
            out = {"query_row": np.repeat(q_rows, times), "query_id": np.repeat(q_ids, times), "row": c_rows[at], "vec_id": c_ids[at], "score": np.concatenate([f[1] for f in found])}
        return pa.table({name: pa.array(x, pa.int64()) for name, x in out.items()})

    found = queries.groupBy("c", "q").cogroup(candidates.groupBy("c", "q")).applyInArrow(meet, "query_row long, query_id long, row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = table.combine_chunks()
    lists = pa.chunked_array(table.column("v")).combine_chunks() if isinstance(table.column("v"), pa.Array) else table.column("v").combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    rows, ids = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "vec_id"))
    if len(size) and (size == size[0]).all():
        return rows, ids, flat.reshape(len(size), size[0])
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return rows, ids, out


SQL = """
WITH q AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS query_row, a.vec_id AS query_id, b.row, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM q a JOIN q b ON a.row <> b.row WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, row)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
