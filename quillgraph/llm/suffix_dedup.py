"""Passages that repeat word for word across documents, with a sparse suffix array.

Of all suffixes of a text, only those are retained that begin at a minimiser: the position whose first K words have the
smallest hash among WINDOW neighbouring ones. Any run of LENGTH = K + WINDOW - 1 words holds a whole minimiser prefix,
and equal runs hold the same one. Suffixes whose prefix two texts have are sorted by their words over all tasks, dealt
out by ranges of the whole key, so that a prefix shared by very many texts is split. Each is compared with its neighbours:
the nearest ones of other texts tell how many words it shares to the right. The match is then extended to the left, to
every run of LENGTH words that begins there and does not pass what is shared to the right; runs that two documents
share (by 128 bits) are merged into maximal passages.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillgraph.llm import minhash
from quillgraph.sources.scratch import Scratch
from quillgraph.llm.textbytes import chunks, digests, mapped, run_hashes, second, text_of, U, words

LENGTH, K = 50, 26
WINDOW = LENGTH - K + 1
_MOST = np.iinfo(U).max


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of values[i : i + width] for each i; len(values) - width + 1 of them."""
    out, have = values, 1
    while 2 * have <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    return best(out[: len(values) - width + 1], out[width - have : len(values) - have + 1]) if width > have else out


def minimisers(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in order) and prefix hashes of the retained suffixes of a batch of texts."""
    n = len(hashes)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.arange(n - K + 1)
    prefix = run_hashes(hashes, at, at + K)
    prefix[text[at] != text[at + K - 1]] = _MOST
    least = _sliding(prefix, WINDOW, np.minimum)  # of the run of LENGTH words from i on
    run = np.arange(len(least))
    least[text[run] != text[run + LENGTH - 1]] = 0  # a run over a border chooses nothing
    padded = np.concatenate([np.zeros(WINDOW - 1, U), least, np.zeros(WINDOW - 1, U)])
    chosen = np.flatnonzero((_sliding(padded, WINDOW, np.maximum) == prefix) & (prefix != _MOST))
    return chosen, prefix[chosen]


def _contents(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, list[bytes]]:
    """For each of n texts, its number of words and 128 bits for their sequence."""
    return np.bincount(text, minlength=n), digests(text, hashes, second(hashes), n)


def _describe(batches, lower=False):
    for batch, data, offsets in chunks(batches, "text"):
        starts, ends, hashes = words(data, offsets, lower)
        text = text_of(starts, offsets)
        size, content = _contents(hashes, text, batch.num_rows)
        letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        bounds = np.concatenate([[0], np.cumsum(size)])
        some = size > 0
        begin, end = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        begin[some] = letters[starts[bounds[:-1][some]]] - letters[offsets[:-1][some]]
        end[some] = letters[ends[bounds[1:][some] - 1]] - letters[offsets[:-1][some]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(content, pa.binary()), pa.array(size, pa.int64()), pa.array(begin), pa.array(end)], names=["doc_id", "content", "n", "begin", "end"])


def _prefixes(batches, lower=False):
    """The prefixes of retained suffixes, once a chunk, each with the smallest and the largest of 64 bits of the texts that have it."""
    for batch, data, offsets in chunks(batches, "text"):
        starts, _, hashes = words(data, offsets, lower)
        text = text_of(starts, offsets)
        at, prefix = minimisers(hashes, text)
        _, content = _contents(hashes, text, batch.num_rows)
        owner = np.frombuffer(b"".join(content), np.int64)[::2][text[at]] if len(at) else np.zeros(0, np.int64)
        order = np.lexsort((owner, prefix))
        prefix, owner = prefix[order], owner[order]
        new = np.ones(len(prefix), bool)
        new[1:] = prefix[1:] != prefix[:-1]
        last = np.ones(len(prefix), bool)
        last[:-1] = new[1:]
        yield pa.RecordBatch.from_arrays([pa.array(prefix[new].view(np.int64)), pa.array(owner[new]), pa.array(owner[last])], names=["prefix", "low", "high"])


def _suffixes(batches, lower=False):
    """Retained suffixes: their prefixes, 32 bits of each of the words that follow up to LENGTH, the text's content, and where they begin."""
    for batch, data, offsets in chunks(batches, "text"):
        starts, _, hashes = words(data, offsets, lower)
        text = text_of(starts, offsets)
        at, prefix = minimisers(hashes, text)
        _, content = _contents(hashes, text, batch.num_rows)
        bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
        brief = np.concatenate([(hashes >> U(32)).astype(">u4"), np.zeros(LENGTH, ">u4")])
        follow = np.arange(K, LENGTH)
        tails = np.where(at[:, None] + follow < bounds[text[at] + 1][:, None], brief[at[:, None] + follow], 0).astype(">u4")
        tails = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * (LENGTH - K)), len(at), [None, pa.py_buffer(np.ascontiguousarray(tails).tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), tails, pa.array(content, pa.binary()).take(pa.array(text[at])), pa.array((at - bounds[text[at]]).astype(np.int32))], names=["prefix", "tail", "content", "at"])


def reaches(prefix: np.ndarray, tails: np.ndarray, content: np.ndarray) -> np.ndarray:
    """For sorted suffixes, the most words (up to LENGTH) that each has in common with one of another content; 0 if less than a prefix.

    In sorted order what two suffixes share is the least that neighbours between them share, so the nearest suffix of
    another content on either side shares the most. Beyond the first and the last row others may follow that share all.
    """
    n = len(prefix)
    if not n:
        return np.zeros(0, np.int64)
    differ = tails[1:] != tails[:-1]
    near = np.where(prefix[1:] == prefix[:-1], K + np.where(differ.any(axis=1), differ.argmax(axis=1), tails.shape[1]), 0)
    near = np.concatenate([[LENGTH], near, [LENGTH]])  # what a row shares with the one before it
    same = content[1:] == content[:-1]
    back, ahead = near[:-1].copy(), near[1:].copy()
    for i in np.flatnonzero(same):  # of rows of one content, one after another, all look at what stands before the first
        back[i + 1] = min(back[i + 1], back[i])
    for i in np.flatnonzero(same)[::-1]:
        ahead[i] = min(ahead[i], ahead[i + 1])
    return np.maximum(back, ahead)


def _compare(batches):
    """Suffixes of a sorted table that share a prefix or more with a neighbour of another content, and how many words. What stands at an edge of a batch may share all with the next."""
    for batch in batches:
        n = batch.num_rows
        tails = np.frombuffer(b"".join(batch.column("tail").to_pylist()), np.uint8).reshape(n, LENGTH - K, 4).copy().view(np.uint32)[:, :, 0]
        reach = reaches(batch.column("prefix").to_numpy(), tails, np.array(batch.column("content").to_pylist(), object))
        some = pa.array(np.flatnonzero(reach))
        yield pa.RecordBatch.from_arrays([batch.column("content").take(some), batch.column("at").take(some), pa.array(reach[reach > 0].astype(np.int32))], names=["content", "at", "reach"])


def _extend(batches, lower=False):
    """All runs of LENGTH words that begin at or left of the given suffixes of each text and do not pass their reach: 128 bits of each, with the places of its first and last letters."""
    for batch, data, offsets in chunks(batches, "text"):
        starts, ends, hashes = words(data, offsets, lower)
        text = text_of(starts, offsets)
        bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
        letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        found = batch.column("found")
        owner = np.repeat(np.arange(batch.num_rows), found.value_lengths().to_numpy(zero_copy_only=False))
        at, reach = (found.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        at = at + bounds[owner]
        low, high = np.maximum(at - (WINDOW - 1), bounds[owner]), np.minimum(at - (LENGTH - reach), bounds[owner + 1] - LENGTH)
        wanted = np.zeros(len(hashes) + 1, np.int64)  # +1 where a stretch of run starts begins, -1 after its end
        np.add.at(wanted, low[high >= low], 1)
        np.add.at(wanted, high[high >= low] + 1, -1)
        run = np.flatnonzero(np.cumsum(wanted)[:-1] > 0)
        owner = text[run]
        base = letters[offsets[owner]]
        both = [pa.array(run_hashes(h, run, run + LENGTH).view(np.int64)) for h in (hashes, second(hashes))]
        yield pa.RecordBatch.from_arrays(
            [*both, batch.column("doc_id").take(pa.array(owner)), pa.array(run - bounds[owner]), pa.array(letters[starts[run]] - base), pa.array(letters[ends[run + LENGTH - 1]] - base)],
            names=["run", "run2", "doc_id", "at", "begin", "end"],
        )


_PASSAGE = "doc_id long, word long, begin long, end long, n_words long, first_doc_id long, removed boolean"


def _merge(batches):
    """Runs of each document, overlapping or touching ones as one passage; those whose first document is another one apart from the others."""
    for batch in batches:
        runs = batch.column("runs")
        doc_id = np.repeat(batch.column("doc_id").to_numpy(), runs.value_lengths().to_numpy(zero_copy_only=False))
        at, begin, end, first = (runs.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
        removed = first != doc_id
        order = np.lexsort((at, removed, doc_id))
        doc_id, at, begin, end, first, removed = (x[order] for x in (doc_id, at, begin, end, first, removed))
        new = np.ones(len(at), bool)
        new[1:] = (doc_id[1:] != doc_id[:-1]) | (removed[1:] != removed[:-1]) | (at[1:] > at[:-1] + LENGTH)
        start = np.flatnonzero(new)
        last = np.append(start[1:], len(at))[: len(start)] - 1
        first = np.minimum.reduceat(first, start) if len(start) else first
        columns = [doc_id[start], at[start], begin[start], end[last], at[last] + LENGTH - at[start], first]
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(removed[start])], names=["doc_id", "word", "begin", "end", "n_words", "first_doc_id", "removed"])


def repeated_passages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, begin, end, n_words, first_doc_id, removed: one row for each passage of 50 words or more that another document shares.

    Words are runs of other characters than white space, compared exactly; begin and end are code points of the text.
    Every run of 50 words has its first document, the smallest doc_id that holds it. Passages made of runs first seen in a
    smaller document have removed true, and first_doc_id the smallest of those; the first holder's own have removed false.
    Documents of equal words share one passage, the whole text. A document that shares nothing has no row. Null text,
    and texts of fewer words: no row. Null doc_id: no row. Rows of one doc_id do not repeat one another. No rows: no rows.
    """
    return placed_passages(Scratch(spark, "passages"), docs).drop("word")


def placed_passages(scratch: Scratch, docs: DataFrame, lower: bool = False) -> DataFrame:
    """repeated_passages() and the place of each one's first word (word); A-Z are compared in lower case, if lower. Tables go to scratch."""
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = scratch.table(docs.transform(mapped, partial(_describe, lower=lower), "doc_id long, content binary, n long, begin long, end long").where(F.col("n") >= LENGTH))
    contents = scratch.table(rows.groupBy("content").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("high")))
    shared = docs.transform(mapped, partial(_prefixes, lower=lower), "prefix long, low long, high long").groupBy("prefix").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    shared = scratch.table(shared.where("low < high").select("prefix"))
    suffixes = scratch.table(minhash.only(docs.transform(mapped, partial(_suffixes, lower=lower), "prefix long, tail binary, content binary, at int"), shared, "prefix"))
    order = ["prefix", "tail", "content", "at"]
    sorted_ = suffixes.repartitionByRange(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    met = sorted_.transform(mapped, _compare, "content binary, at int, reach int")
    found = met.groupBy("content").agg(F.collect_set(F.struct("at", "reach")).alias("found"))
    found = scratch.table(found.join(contents, "content").select(F.col("id").alias("doc_id"), "found"))
    scratch.drop(suffixes)
    texts = minhash.only(docs, found.select("doc_id"), "doc_id").join(found, "doc_id")  # only these texts are shuffled
    runs = scratch.table(texts.transform(mapped, partial(_extend, lower=lower), "run long, run2 long, doc_id long, at long, begin long, end long"))
    twice = scratch.table(runs.groupBy("run", "run2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("run", "run2", "first"))
    kept = runs.join(twice, ["run", "run2"]).groupBy("doc_id").agg(F.collect_list(F.struct("at", "begin", "end", "first")).alias("runs"))
    passages = kept.transform(mapped, _merge, _PASSAGE)
    copies = contents.where("id < high").select("content", "id")
    whole = rows.join(copies, "content").select("doc_id", F.lit(0).cast("long").alias("word"), "begin", "end", F.col("n").alias("n_words"), F.col("id").alias("first_doc_id"), (F.col("doc_id") != F.col("id")).alias("removed"))
    return passages.unionAll(whole)


def _cut(text: str, spans) -> str:
    out, at = [], 0
    for span in sorted((s["begin"], s["end"]) for s in spans):
        out.append(text[at : max(at, span[0])])
        at = max(at, span[1])
    return "".join([*out, text[at:]])


def without_spans(spark: SparkSession, docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs without the spans (doc_id, begin, end) of their texts, which may overlap; n_chars, if there, follows the text. Documents of which no word is left go. All other rows and columns are kept as they are."""
    kept = [f"row.`{c}`" for c in docs.columns]
    gone = Scratch(spark, "cuts").table(spans.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("begin", "end")).alias("spans")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    met = F.col("row.doc_id") == F.col("id")
    if gone.count() <= minhash.BROADCAST_IDS:  # then only the texts that are cut are shuffled
        ids = F.broadcast(gone.select("id"))
        whole, rows = rows.join(ids, met, "left_anti"), rows.join(ids, met, "left_semi").join(gone, met)
        whole = whole.unionAll(rows.where("row.text IS NULL").select("row"))
    else:
        rows = rows.join(gone, met, "left")
        whole = rows.where("spans IS NULL OR row.text IS NULL")
    cut = F.pandas_udf(lambda texts, spans: texts.combine(spans, _cut), StringType())
    rest = rows.where("spans IS NOT NULL AND row.text IS NOT NULL").withColumn("row", F.col("row").withField("text", cut("row.text", "spans"))).where(F.col("row.text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        rest = rest.withColumn("row", F.col("row").withField("n_chars", F.length("row.text").cast(docs.schema["n_chars"].dataType)))
    return whole.select(kept).unionAll(rest.select(kept))


def cut_passages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the passages that a document of a smaller doc_id already has; see without_spans()."""
    return without_spans(spark, docs, repeated_passages(spark, docs).where("removed").select("doc_id", "begin", "end"))


#: repeated_passages(docs).
SQL = r"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS k FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
w AS MATERIALIZED (SELECT doc_id, list_transform(k, lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+', '')) AS w, list_transform(k, lambda x: length(x)) AS sizes FROM t),
c AS MATERIALIZED (SELECT w, min(doc_id) AS id, max(doc_id) AS high FROM w WHERE len(w) >= 50 GROUP BY w),
u AS (SELECT w.doc_id, unnest(range(1, len(w.w) + 1)) AS i, unnest(w.w) AS word, unnest(w.sizes) AS size FROM w WHERE doc_id IN (SELECT id FROM c)),
b AS MATERIALIZED (SELECT doc_id, i, (sum(size) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS stop, length(word) AS letters FROM u),
x AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h FROM w WHERE doc_id IN (SELECT id FROM c)),
f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h HAVING min(doc_id) < max(doc_id)),
y AS (SELECT x.doc_id, x.i, f.first, f.first <> x.doc_id AS removed FROM x JOIN f USING (h)),
z AS (SELECT *, CASE WHEN i > 50 + lag(i) OVER o THEN 1 ELSE 0 END AS apart FROM y WINDOW o AS (PARTITION BY doc_id, removed ORDER BY i)),
v AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, removed ORDER BY i) AS island FROM z),
r AS (SELECT doc_id, removed, min(i) AS low, max(i) + 49 AS high, min(first) AS first_doc_id FROM v GROUP BY doc_id, removed, island)
SELECT r.doc_id, a.stop - a.letters AS begin, e.stop AS "end", r.high - r.low + 1 AS n_words, r.first_doc_id, r.removed FROM r JOIN b a ON a.doc_id = r.doc_id AND a.i = r.low JOIN b e ON e.doc_id = r.doc_id AND e.i = r.high
UNION ALL SELECT w.doc_id, length(sizes_text.lead), sizes_text.total, len(w.w), c.id, w.doc_id <> c.id FROM w JOIN c ON w.w = c.w AND c.id < c.high JOIN (SELECT doc_id, regexp_extract(text, '^[\x20\x09-\x0D]*') AS lead, length(regexp_replace(text, '[\x20\x09-\x0D]+$', '')) AS total FROM t) sizes_text ON sizes_text.doc_id = w.doc_id
"""
