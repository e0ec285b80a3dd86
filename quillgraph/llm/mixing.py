"""Mixing sources to target weights, in DataFrame functions only.

Sizes are summed by source before anything is joined. Each source's repetition rate is its target over its size;
a document is emitted floor(rate) times, and once more if a hash of its id (without one, of its text), seen as a number
from 0 to 1, is below the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.order import with_position
from quillgraph.sources.scratch import Scratch, small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Rates are sent to all executors only up to so many sources; beyond, the join is an ordinary one.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(spark: SparkSession, sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """sized (source, size) -> source, source_size, target: one row for each source, null being one.

    Sources in code-point order, null last, get the weights in turn. Together the targets are the sum of all sizes, in
    proportion to weight, but none exceeds `most` times its source's size: those whose share is above it are held there,
    and what they leave is shared anew by the others, until none is above. Each round is one sum over the sources, and
    positions are counted by ranges, so sources may be as many as documents.
    """
    by = Scratch(spark, "sources").table(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    by = with_position(by, F.col("source").asc_nulls_last(), name="_rank")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("double")
    by = Scratch(spark, "sources").table(by.select("source", "source_size", w.alias("w"), (F.col("source_size").cast("double") * most).alias("cap")))
    total = float(by.agg(F.sum("source_size")).first()[0] or 0)
    # a source is held once its cap over its weight is below the level that the others share; the level only rises
    level = 0.0
    while True:
        held = F.col("cap") / F.col("w") < level
        full, share = by.agg(F.sum(F.when(held, F.col("cap")).otherwise(0.0)), F.sum(F.when(held, 0.0).otherwise(F.col("w")))).first()
        up = (total - full) / share if share else level
        if up <= level:
            break
        level, last = up, (full, share)
    if not level:
        return by.select("source", "source_size", F.lit(0.0).alias("target"))
    fits = (F.lit(total) - F.lit(last[0])) * F.col("w") / F.lit(last[1])
    return by.select("source", "source_size", F.least(fits, F.col("cap")).alias("target"))


def drawn_by(doc_id: Column, text: Column) -> Column:
    """What a document's draw is made from: its id, or without one a hash of its text."""
    return F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def copies(key: Column, source_size: Column, target: Column, seed: str = "mix", most: int = MOST_COPIES) -> Column:
    """How often a document of this drawn_by() is emitted. Rows of one id get equal numbers, and so do rows without an id of equal text."""
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    whole = F.floor(rate)
    return F.least(whole + F.when(draw < rate - whole, 1).otherwise(0), F.lit(most)).cast("long")


def _with_rates(spark: SparkSession, docs: DataFrame, sized: DataFrame) -> DataFrame:
    """docs (with columns source and _key) and the three columns source_size, target and copies."""
    rates = Scratch(spark, "mixing").table(targets(spark, sized)).withColumnRenamed("source", "_source")
    if small(rates, BROADCAST_SOURCES):
        rates = F.broadcast(rates)
    out = docs.join(rates, docs["source"].eqNullSafe(rates["_source"])).drop("_source")
    return out.withColumn("copies", copies(F.col("_key"), F.col("source_size"), F.col("target"))).drop("_key")


def plan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, for each row of docs.

    Null or empty text: size 0, taken 0. A source without words: target 0. No rows: no rows. Other columns are dropped.
    """
    sized = Scratch(spark, "sizes").table(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), drawn_by(F.col("doc_id"), F.col("text")).alias("_key")))
    return _with_rates(spark, sized, sized).withColumn("taken", F.col("copies") * F.col("size"))


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Each row of docs as often as plan() says, with docs' columns; texts are not shuffled. Null texts and texts without a word count as 0 words. No rows: no rows."""
    kept = docs.columns
    rated = _with_rates(spark, docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), "doc_id", "source", drawn_by(F.col("doc_id"), F.col("text")).alias("_key")), docs.select("source", word_count(F.col("text")).alias("size")))
    emitted = rated.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return emitted.select("_row.*")


SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS key, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
r AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w,
        (sum(source_size) OVER ())::DOUBLE AS total, source_size * 3.0::DOUBLE AS cap FROM s),
f AS (SELECT *, cap * sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
          >= (total - coalesce(sum(cap) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS fits FROM r),
t AS (SELECT source, source_size, CASE WHEN fits THEN
          (total - sum(CASE WHEN fits THEN 0.0::DOUBLE ELSE cap END) OVER ()) * w / sum(CASE WHEN fits THEN w ELSE 0.0::DOUBLE END) OVER ()
        ELSE cap END::DOUBLE AS target FROM f),
d AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('mix:' || key), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
      FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (least(floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END, 3) * size)::BIGINT AS taken FROM d
"""
