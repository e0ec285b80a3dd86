"""Repeated paragraphs: MinHash banding tuned for recall, exact Jaccard, removals by components.

A paragraph is a line that has a word. Equal shingle sets are one class, known by 128 bits. Sets of fewer than four
shingles reach a similarity of 0.8 only when equal, so only the others are banded. Keys that one class alone has are
left out before classes are joined; what meets is verified on whole sets. For passages that stand inside a line,
find_repeats() also has the runs of 50 words or more that documents share word for word, wherever they begin and end.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import minhash
from quillgraph.llm.suffix_dedup import LENGTH, placed_passages, without_spans
from quillgraph.sources.scratch import Scratch
from quillgraph.llm.textbytes import chunks, digests, mapped, shingles, words

N_WORDS = 5
#: At a similarity of 0.8 a pair shares no band with a probability of (1 - 0.8 ** 3) ** 10, 8 in 10 000.
BANDS, ROWS = 10, 3
#: Sets of fewer shingles are alike only if they are equal.
LEAST_BANDED = 4
#: Lists of lines whose sets are wanted (8 bytes a line) are sent to all executors only up to so many lines.
BROADCAST_LINES = 500_000


def _units(data: np.ndarray, offsets: np.ndarray):
    """Lines that have a word: the text, first word and number of words of each; and all words: first bytes, ends, hashes."""
    at = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    starts, ends, hashes = words(data, at, lower=True)
    unit = np.searchsorted(at, starts, "right") - 1
    _, first, size = np.unique(unit, return_index=True, return_counts=True)
    text = np.searchsorted(offsets, starts[first], "right") - 1
    return text, first, size, starts, ends, hashes


def _lines(data: np.ndarray, offsets: np.ndarray):
    """_units(), owner and hashes of their shingles, how many each has, and 128 bits for each set."""
    text, first, size, starts, ends, hashes = _units(data, offsets)
    owner, found, others = shingles(hashes, np.repeat(np.arange(len(first)), size), N_WORDS, twice=True)
    count = np.bincount(owner, minlength=len(first))
    return text, first, size, starts, ends, owner, found, count, digests(owner, found, others, len(first))


def _table(batches):
    """Lines with their place among the words of their text, and in code points."""
    for batch, data, offsets in chunks(batches, "text"):
        text, first, size, starts, ends, _, _, _, sets = _lines(data, offsets)
        letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        base = letters[offsets[text]]
        word = first - np.searchsorted(starts, offsets[:-1])[text]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(text)), pa.array(word), pa.array(size), pa.array(letters[starts[first]] - base), pa.array(letters[ends[first + size - 1]] - base), pa.array(sets, pa.binary())], names=["doc_id", "word", "words", "begin", "end", "digest"])


def _halves(sets: list[bytes]) -> np.ndarray:
    """64 of the 128 bits of each set."""
    return np.frombuffer(b"".join(sets), ">i8")[::2].astype(np.int64)


def _keys(batches):
    """Sets of LEAST_BANDED shingles or more, once a chunk, with their band keys."""
    for _, data, offsets in chunks(batches, "text"):
        *_, owner, found, count, sets = _lines(data, offsets)
        _, one = np.unique(_halves(sets), return_index=True)
        wanted = np.zeros(len(sets), bool)
        wanted[one] = count[one] >= LEAST_BANDED
        place = np.cumsum(wanted) - 1
        some = wanted[owner]
        keys = minhash.band_keys(minhash.signatures(place[owner[some]], found[some], int(wanted.sum()), BANDS * ROWS), ROWS)
        yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()).filter(pa.array(wanted)), pa.array(_halves(sets)[wanted]), pa.array(count[wanted]), minhash.lists(keys)], names=["digest", "half", "n", "keys"])


def _sets(batches):
    """The sets of the lines of each text whose halves are wanted, once a chunk."""
    for batch, data, offsets in chunks(batches, "text"):
        text, _, _, _, _, owner, found, _, sets = _lines(data, offsets)
        half = _halves(sets)
        asked = [set(x) for x in batch.column("wanted").to_pylist()]
        wanted = np.array([h in asked[t] for h, t in zip(half.tolist(), text.tolist())], bool)
        _, one = np.unique(half, return_index=True)
        once = np.zeros(len(half), bool)
        once[one] = True
        wanted &= once
        place = np.cumsum(wanted) - 1
        some = wanted[owner]
        yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()).filter(pa.array(wanted)), minhash.binaries(place[owner[some]], found[some], int(wanted.sum()))], names=["digest", "elements"])


def repeated_lines(spark: SparkSession, docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """docs (doc_id, text) -> doc_id, word, n_words, begin, end, component_id, first_doc_id, first_word: a row for each line that repeats.

    Lines are alike if shared / union of their 5-word shingle sets (A-Z in lower case; of fewer words, the sequence as
    one) is num / den or more; likeness is passed on within components. A line repeats if its component has another line,
    in whatever document, the same one too. word: the place of its first word; begin and end: code points. first_doc_id
    and first_word: the first line of the component by document and word. component_id is the same for all lines of a
    component, and no number that another run need give it. Null text or doc_id: no row. Rows of one doc_id are one
    document. No rows: no rows. Other columns are dropped.
    """
    return _repeated(Scratch(spark, "paragraphs"), docs, num, den)


def find_repeats(spark: SparkSession, docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """repeated_lines(), and the runs of 50 words or more that documents share: doc_id, begin, end, n_words, component_id, first_doc_id, first, removed, passage.

    The words of a run are equal (A-Z in lower case). It begins and ends at any word, also in the middle of lines, so
    every run of 50 words that two documents share is in a row, whole; these rows have a null component_id. first: nothing
    alike stands before it. passage: it has 50 words or more. removed: it is such a passage, and not the first.
    """
    runs = _exact(Scratch(spark, "runs"), docs)
    lines = repeated_lines(spark, docs, num, den)
    first = (F.col("doc_id") == F.col("first_doc_id")) & (F.col("word") == F.col("first_word"))
    lines = lines.select("doc_id", "begin", "end", "n_words", "component_id", "first_doc_id", first.alias("first"))
    both = lines.unionByName(runs).withColumn("passage", F.col("n_words") >= LENGTH)
    return both.select("doc_id", "begin", "end", "n_words", "component_id", "first_doc_id", "first", (F.col("passage") & ~F.col("first")).alias("removed"), "passage")


def _exact(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """Runs that documents share word for word; all tables on the way to them are deleted."""
    way = Scratch(scratch.spark, "passages")
    out = scratch.table(placed_passages(way, docs, lower=True).select("doc_id", "begin", "end", "n_words", F.lit(None).cast("long").alias("component_id"), "first_doc_id", (~F.col("removed")).alias("first")))
    way.clear()
    return out


def _repeated(scratch: Scratch, docs: DataFrame, num: int, den: int) -> DataFrame:
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    keyed = scratch.table(docs.transform(mapped, _keys, "digest binary, half long, n long, keys array<long>"))
    entries = keyed.select("digest", "half", "n", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.min("half").alias("low"), F.max("half").alias("high")).where("low < high").select("key")
    members = scratch.table(minhash.only(entries.drop("half"), scratch.table(shared), "key"))
    scratch.drop(keyed)
    lines = scratch.table(docs.transform(mapped, _table, "doc_id long, word long, words long, begin long, end long, digest binary"))
    classes = lines.groupBy("digest").agg(F.count("*").alias("times"), F.min("doc_id").alias("doc_id"))
    classes = scratch.table(classes.withColumn("id", F.monotonically_increasing_id()))
    entries = scratch.table(members.join(classes.select("digest", "id"), "digest").select("id", "n", "key").distinct())
    scratch.drop(members)

    def sets_of(ids: DataFrame) -> DataFrame:
        asked = scratch.table(classes.join(ids, "id").select("id", "digest", "doc_id"))
        wanted = asked.groupBy("doc_id").agg(F.collect_list(_half("digest")).alias("wanted"))  # some of a document's own lines
        if asked.count() <= BROADCAST_LINES:
            wanted = F.broadcast(wanted)
        found = docs.join(wanted, "doc_id").transform(mapped, _sets, "digest binary, elements binary")
        return found.join(asked.select("id", "digest"), "digest").select("id", "elements").dropDuplicates(["id"])

    _, roots = minhash.links(scratch, entries, sets_of, num, den)
    named = classes.join(roots, F.col("id") == F.col("node"), "left").select("digest", "times", F.coalesce("root", "id").alias("component_id"))
    named = scratch.table(named)
    again = scratch.table(named.groupBy("component_id").agg(F.sum("times").alias("times")).where("times > 1").select("component_id"))
    held = named.join(again, "component_id").select("digest", "component_id")
    rows = scratch.table(lines.join(held, "digest").select("doc_id", "word", F.col("words").alias("n_words"), "begin", "end", "component_id"))
    scratch.drop(lines)
    lowest = scratch.table(rows.groupBy("component_id").agg(F.min("doc_id").alias("first_doc_id")))
    place = rows.join(lowest, "component_id").where("doc_id = first_doc_id").groupBy("component_id", "first_doc_id").agg(F.min("word").alias("first_word"))
    return rows.join(scratch.table(place), "component_id").select("doc_id", "word", "n_words", "begin", "end", "component_id", "first_doc_id", "first_word")


def _half(digest: str):
    """_halves() of a column."""
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("long")


def cut_paragraphs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the passages that find_repeats() says are removed: shorter lines that repeat stay. See suffix_dedup.without_spans()."""
    return without_spans(spark, docs, find_repeats(spark, docs).where("removed").select("doc_id", "begin", "end"))
