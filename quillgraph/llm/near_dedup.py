"""Near-duplicate documents: SuperMinHash, banding, confirmation on whole shingle sets, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import minhash
from quillgraph.sources.scratch import Scratch
from quillgraph.llm.textbytes import chunks, digests, mapped, shingles, text_of, words

#: At a similarity of 0.8 a pair shares no band with a probability of (1 - 0.8 ** 4) ** 32, 5 in 100 million.
BANDS, ROWS = 32, 4


def shingle_sets(n_words: int):
    """For mapInArrow over (doc_id, text): doc_id, n, digest of the set, band keys."""

    def run(batches):
        for batch, data, offsets in chunks(batches, "text"):
            starts, _, hashes = words(data, offsets, lower=True)
            owner, found, others = shingles(hashes, text_of(starts, offsets), n_words, twice=True)
            n = batch.num_rows
            size = np.bincount(owner, minlength=n)
            keys = minhash.band_keys(minhash.signatures(owner, found, n, BANDS * ROWS), ROWS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(digests(owner, found, others, n), pa.binary()), minhash.lists(keys)], names=["doc_id", "n", "digest", "keys"])

    return run


def _elements(n_words: int):
    def run(batches):
        for batch, data, offsets in chunks(batches, "text"):
            starts, _, hashes = words(data, offsets, lower=True)
            owner, found = shingles(hashes, text_of(starts, offsets), n_words)
            yield pa.RecordBatch.from_arrays([batch.column("id"), minhash.binaries(owner, found, batch.num_rows)], names=["id", "elements"])

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, n_words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept: one row for each row of docs.

    A document's set: its distinct n-word shingles of whole texts, A-Z in lower case; of fewer words, the sequence as
    one. Documents are linked if shared / union of their sets is num / den or more. component_id: the smallest doc_id
    that links reach; kept: that is its own. Null text or no word: an empty set, linked with nothing. Null doc_id: in no
    component (null), kept. Rows of one doc_id are one document as far as links go, also if their texts are unequal: a link
    of one is a link of all. No rows: no rows. Other columns are dropped.

    Documents of equal sets are one class, known by its smallest doc_id; only classes are compared.
    """
    scratch = Scratch(spark, "near")
    rows = scratch.table(docs.select("doc_id", "text").transform(mapped, shingle_sets(n_words), "doc_id long, n long, digest binary, keys array<long>"))
    whole = rows.where("doc_id IS NOT NULL AND n > 0")
    classes = scratch.table(whole.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys")))  # equal in a class

    def sets_of(ids: DataFrame) -> DataFrame:
        texts = minhash.only(docs.select(F.col("doc_id").alias("id"), "text"), scratch.table(ids), "id")
        return texts.transform(mapped, _elements(n_words), "id long, elements binary").distinct()  # unequal texts of one id are two sets of it

    _, roots = minhash.links(scratch, classes.select("id", "n", F.explode("keys").alias("key")), sets_of, num, den)
    named = whole.select("doc_id", "n", "digest").join(classes.select("digest", "id"), "digest")
    out = named.join(roots, named["id"] == roots["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))
    rest = rows.where("doc_id IS NULL OR n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionAll(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(spark: SparkSession, docs: DataFrame, n_words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each group of near-duplicates, the one with the smallest doc_id; of rows that repeat a doc_id, one stays.

    All columns are kept, and rows with a null doc_id, a null text or no word. No rows: no rows.
    """
    scratch = Scratch(spark, "keep")
    found = near_duplicates(spark, docs, n_words, num, den)
    gone = scratch.table(found.where("NOT kept").select("doc_id").distinct())
    twice = scratch.table(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    stay = docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
    if twice.isEmpty():
        return stay
    one = stay.join(twice, stay["doc_id"] == twice["doc_id"], "left_semi").dropDuplicates(["doc_id"])
    return stay.join(twice, stay["doc_id"] == twice["doc_id"], "left_anti").unionAll(one)


#: near_duplicates(docs, n_words=4), for tables whose doc_id is never null.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS g FROM w),
d AS MATERIALIZED (SELECT doc_id, g, md5(array_to_string(g, chr(10))) AS h FROM g),
c AS MATERIALIZED (SELECT h, min(doc_id) AS id, any_value(g) AS g FROM d WHERE len(g) > 0 GROUP BY h),
s AS MATERIALIZED (SELECT id, len(g) AS n, unnest(g) AS x FROM c),
p AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM s a JOIN s b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT x, y FROM p UNION SELECT y, x FROM p),
r AS (SELECT id AS node, id AS root FROM c UNION SELECT e.y, r.root FROM r JOIN e ON r.node = e.x),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, len(d.g)::BIGINT AS n_shingles, coalesce(m.root, d.doc_id) AS component_id, d.doc_id = coalesce(m.root, d.doc_id) AS kept
FROM d LEFT JOIN c ON d.h = c.h AND len(d.g) > 0 LEFT JOIN m ON m.node = c.id
"""
