"""Quality by hierarchical empirical Bayes.

A logistic model of what a text looks like gives each document's own evidence. Documents of a host, and of a folder
below it where the site is a URL, share a quality level, which is estimated from sums over all their documents and drawn towards the level
above by as many pseudo-documents as the spread between sites warrants: with little spread, or few documents, a site
hardly counts. The document's posterior odds are its own, times the odds of its path over the global ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.sources.scratch import Scratch, small
from quillgraph.llm.textbytes import chunks, mapped, _SPACE, text_of, words

#: Sites are sent to all executors only up to so many.
BROADCAST_SITES = 100_000
#: Of the documents labelled good, so many may be rejected at most.
LOST_GOOD = 0.005
#: Values that reach the driver to pick one by its rank; of more, the range is narrowed first, in so many parts.
PICKED, PARTS = 10_000, 1000
_PUNCTUATION = b".,!?|%*#$&@+=<>:;-_/()[]{}\"'~^"


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text: shares of kinds of bytes, of lines and of words, all of them of the whole text."""
    n, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1).astype(float)
    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    starts, ends, hashes = words(data, offsets, lower=True)
    text = text_of(starts, offsets)
    count = np.maximum(np.bincount(text, minlength=n), 1).astype(float)
    length = (ends - starts).astype(float)
    mean = np.bincount(text, length, n) / count
    spread = np.sqrt(np.maximum(np.bincount(text, length**2, n) / count - mean**2, 0))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    distinct = np.bincount(t[new], minlength=n)
    times = np.diff(np.concatenate([np.flatnonzero(new), [len(h)]]))
    most = np.zeros(n)
    np.maximum.at(most, t[new], times)
    same_next = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    stutter = np.bincount(text[1:][same_next], minlength=n)
    last = data[ends - 1] if len(ends) else data[:0]
    odd = np.isin(last, np.frombuffer(b"%*#$&|!@+=<>~^_", np.uint8))
    first = data[starts] if len(starts) else data[:0]
    capital = (first >= 65) & (first <= 90)
    columns = [
        *[np.sqrt(per_text(data == c)) for c in _PUNCTUATION],
        per_text((data >= 65) & (data <= 90)), per_text((data >= 97) & (data <= 122)), per_text(data >= 128), per_text((data >= 48) & (data <= 57)), per_text(_SPACE[data]), np.sqrt(per_text(data == 10)),
        np.log1p(np.diff(offsets)), np.log1p(mean), np.log1p(spread), distinct / np.sqrt(count), distinct / count, most / count, stutter / count, np.bincount(text, odd, n) / count, np.bincount(text, capital, n) / count,
    ]
    return np.stack(columns, axis=1)


def _units(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, in whole 1024ths between -8 and 8."""
    return np.rint(np.clip((x - mean) / scale, -8, 8) * 1024)


@dataclass
class TextModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float  # share of good documents among those it was fitted on

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(_units(x, self.mean, self.scale) / 1024 @ self.weights + self.bias, -12, 12)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _totals(known: DataFrame, size: int, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums over all rows of known, by part(x, y): `size` whole numbers for a batch of rows. They are added without rounding, so the order of rows does not matter."""

    def run(batches):
        total = [0] * size
        for batch in batches:
            if batch.num_rows:
                total = [t + int(v) for t, v in zip(total, part(_matrix(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False).astype(float)))]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["k", "v"])

    sums = known.select("y", "x").transform(mapped, run, "k int, v decimal(38,0)").groupBy("k").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for r in sums.collect():
        out[r["k"]] = float(r["v"])
    return out


def fit(known: DataFrame, ridge: float = 1.0) -> tuple[TextModel, int, int]:
    """Ridge logistic regression by Newton's method on all rows of known (doc_id, y, x); also how many rows there are, and how many are good. With labels of one kind, or none, all weights are 0."""
    d = len(features(np.zeros(0, np.uint8), np.zeros(1, np.int64)).T)
    sums = _totals(known, 2 * d + 2, lambda x, y: np.concatenate([np.rint(x * 2.0**32).sum(axis=0), np.rint(x**2 * 2.0**32).sum(axis=0), [len(y), y.sum()]]))
    n, good = int(sums[-2]), int(sums[-1])
    prior = (good + 1) / (n + 2)
    flat = TextModel(np.zeros(d), np.ones(d), np.zeros(d), float(np.log(prior / (1 - prior))), prior)
    if good in (0, n):
        return flat, n, good
    mean = sums[:d] / 2.0**32 / n
    scale = np.sqrt(np.maximum(sums[d : 2 * d] / 2.0**32 / n - mean**2, 1e-8))
    w, penalty, upper = np.zeros(d + 1), np.append(np.full(d, ridge), 1e-6), np.triu_indices(d + 1)
    for _ in range(30):

        def part(x: np.ndarray, y: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            z = np.concatenate([_units(x, mean, scale), np.full((len(x), 1), 1024.0)], axis=1)
            p = 1 / (1 + np.exp(-np.clip(z / 1024 @ w, -30, 30)))
            return np.concatenate([((z * np.rint(p * (1 - p) * 2.0**16)[:, None]).T @ z)[upper], z.T @ np.rint((y - p) * 2.0**26)])

        sums = _totals(known, len(upper[0]) + d + 1, part)
        bend = np.zeros((d + 1, d + 1))
        bend[upper] = sums[: -d - 1] / 2.0**36
        bend = np.triu(bend) + np.triu(bend, 1).T
        step = np.linalg.solve(bend + np.diag(penalty), sums[-d - 1 :] / 2.0**36 - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return TextModel(mean, scale, w[:-1], float(w[-1]), prior), n, good


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, y and x of every document of rows with a label; repeated labels of a document count by their mean, rounded, and of rows with one id the smallest features, of those with a text if there are any. A null text counts as the empty one."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("y"))
    one = rows.where("doc_id IS NOT NULL").select("doc_id", "has_text", "x").join(known.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(~F.col("has_text"), "x"))["x"].alias("x"))
    return one.join(known, "doc_id").select("doc_id", "y", "x")


_URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d*)?(?:/([^/?#]*)(?=/))?"


def host_and_path(site: Column) -> tuple[Column, Column]:
    """Of a URL the host in lower case and the first folder of its path (null, if it has none); another text is a host as it stands, without a path."""
    part = lambda i: F.nullif(F.regexp_extract(site, _URL, i), F.lit(""))
    return F.coalesce(F.lower(part(1)), site), part(2)


def _text_features(docs: DataFrame, site: str) -> DataFrame:
    def run(batches):
        for batch, data, offsets in chunks(batches, "text"):
            x = features(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column("text").is_valid(), lists], names=["doc_id", "host", "path", "has_text", "x"])

    host, path = host_and_path(F.col(f"`{site}`").cast("string"))
    rows = docs.select("doc_id", host.alias("host"), path.alias("path"), "text")
    return rows.transform(mapped, run, "doc_id long, host string, path string, has_text boolean, x array<double>")


def _text_evidence(rows: DataFrame, model: TextModel) -> DataFrame:
    def run(batches):
        for batch in batches:
            logits = model.logits(_matrix(batch.column(3))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(logits)], names=["doc_id", "host", "path", "logit"])

    return rows.select("doc_id", "host", "path", "x").transform(mapped, run, "doc_id long, host string, path string, logit double")


def _strength(sites: DataFrame, mean: float) -> float:
    """Pseudo-documents that draw a site to the level above, by the method of moments: with s**2 the spread between the sites' true levels, m (1 - m) / s**2 - 1."""
    r = sites.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum((F.col("s") / F.col("n") - F.lit(mean)) ** 2 * F.col("n")).alias("between"), F.sum("within").alias("within")).first()
    if not r["k"] or r["k"] < 2 or r["n"] <= r["k"]:
        return 1e6
    noise = r["within"] / (r["n"] - r["k"])
    spread = (r["between"] - (r["k"] - 1) * noise) / max(r["n"] - r["nn"] / r["n"], 1e-9)
    return float(np.clip(mean * (1 - mean) / spread - 1, 1, 1e6)) if spread > 1e-9 else 1e6


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, site: str = "source") -> DataFrame:
    """docs (doc_id, text, site) and labels (doc_id, quality 0 or 1) -> doc_id, text_p, host_p, path_p, posterior, keep for each row of docs.

    site: a URL, or else the name of a host; see host_and_path(). text_p: the text model's probability of good; host_p,
    path_p: the levels of its host and path, without the document itself (where there is no path, path_p is host_p);
    posterior: of all together. keep: posterior is at least the threshold, which lets go LOST_GOOD of all
    documents labelled good at most, and is 0.5 at most; equal posteriors are decided alike. Null text: as the empty one.
    Null site: a host of its own. Without labels, all are kept. No rows: no rows. Other columns are dropped.
    """
    scratch = Scratch(spark, "quality")
    seen = scratch.table(_text_features(docs, site))
    known = scratch.table(labelled(seen, labels))
    model, n, n_good = fit(known)
    p = 1 / (1 + F.exp(-F.col("logit")))
    rows = scratch.table(_text_evidence(seen, model).withColumn("p", p))
    scratch.drop(seen)
    sites = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.greatest(F.sum(F.col("p") ** 2) - F.sum("p") ** 2 / F.count("*"), F.lit(0.0)).alias("within"), F.sum(F.col("p") ** 2).alias("q"))
    sites = scratch.table(sites)
    hosts = sites.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.greatest(F.sum("q") - F.sum("s") ** 2 / F.sum("n"), F.lit(0.0)).alias("within"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = float(np.clip((total["s"] or 0) / max(total["n"] or 0, 1), 1e-4, 1 - 1e-4))
    k_host, k_path = _strength(hosts, mean), _strength(sites.where("path IS NOT NULL"), mean)
    both = sites.alias("a").join(hosts.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host"))).select(F.col("a.host").alias("_host"), F.col("a.path").alias("_path"), F.col("a.n").alias("pn"), F.col("a.s").alias("ps"), F.col("b.n").alias("hn"), F.col("b.s").alias("hs"))
    both = scratch.table(both)
    if small(both, BROADCAST_SITES):
        both = F.broadcast(both)
    out = rows.join(both, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    host_p = (k_host * mean + F.col("hs") - F.col("p")) / (k_host + F.col("hn") - 1)
    path_p = F.when(F.col("path").isNull(), host_p).otherwise((k_path * host_p + F.col("ps") - F.col("p")) / (k_path + F.col("pn") - 1))
    inside = lambda c: F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    logit = lambda c: F.log(c / (1 - c))
    out = out.select("doc_id", "logit", F.col("p").alias("text_p"), inside(host_p).alias("host_p"), inside(path_p).alias("path_p"))
    out = out.withColumn("posterior", 1 / (1 + F.exp(-(F.col("logit") + logit(F.col("path_p")) - float(np.log(mean / (1 - mean)))))))
    threshold = _threshold(scratch, out, known.where("y = 1").select("doc_id"), n_good) if 0 < n_good < n else 0.0
    return out.withColumn("keep", F.col("posterior") >= threshold).drop("logit")


def _threshold(scratch: Scratch, scored: DataFrame, good: DataFrame, n: int) -> float:
    """The posterior of rank n * LOST_GOOD among all n good documents, 0.5 at most."""
    good = scratch.table(good)
    if small(good, BROADCAST_SITES):
        good = F.broadcast(good)
    lowest = scratch.table(scored.join(good, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("posterior").alias("v")).select("v"))  # rows may repeat an id
    return min(0.5, _of_rank(lowest, int(n * LOST_GOOD)))


def _of_rank(values: DataFrame, rank: int) -> float:
    """The value (column v) that `rank` rows come before in ascending order, exact. The driver gets PICKED rows at most."""
    r = values.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    n, low, high = r["n"], r["low"], r["high"]
    while low < high and n > PICKED:
        values = values.where(F.col("v").between(low, high))
        part = F.floor((F.col("v") - F.lit(low)) / F.lit(high - low) * PARTS)  # low and high are in different parts
        for r in sorted(values.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect(), key=lambda r: r["part"]):
            if rank < r["n"]:
                n, low, high = r["n"], r["low"], r["high"]
                break
            rank -= r["n"]
    return low if low == high else sorted(r["v"] for r in values.where(F.col("v").between(low, high)).collect())[rank]


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, site: str = "source") -> DataFrame:
    """docs, with all columns, without the rows whose document the classifier rejects; rows of one doc_id go together if one is rejected, rows of a null doc_id stay.

    Null and empty texts are judged as the empty text. Without labels all rows stay. No rows: no rows.
    """
    gone = Scratch(spark, "rejected").table(score(spark, docs, labels, site).where("NOT keep AND doc_id IS NOT NULL").select("doc_id").distinct())
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
