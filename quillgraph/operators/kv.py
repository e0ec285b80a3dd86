"""A table (key, idx, value) used as a key-value store with dense indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.order import with_position


def lookup(keys: DataFrame, store: DataFrame) -> DataFrame:
    """keys (pos, key) with idx and value, null where there is no such key."""
    return keys.join(store, "key", "left").select("pos", "key", "idx", "value")


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """new (ord, key, value) put into the store: a known key keeps its index; others get the free indices, the highest first, and then those after the last, by the order of their first arrival. The last value of a key counts."""
    latest = new.groupBy("key").agg(F.max_by("value", "ord").alias("value"), F.min("ord").alias("ord"))
    both = store.select("key", "idx", F.col("value").alias("_old"))
    kept = both.join(latest.select("key", "value"), "key", "left").select("key", "idx", F.coalesce("value", "_old").alias("value"))
    fresh = with_position(latest.join(store.select("key"), "key", "left_anti"), F.col("ord"), F.col("key"), name="n")
    top = store.agg(F.max("idx")).first()[0]
    top = 0 if top is None else int(top) + 1
    free = store.sparkSession.range(top).select(F.col("id").alias("idx")).join(store.select(F.col("idx").cast("long")), "idx", "left_anti")
    free = with_position(free, F.desc("idx"), name="n").withColumnRenamed("idx", "_free")
    size = free.count()
    placed = fresh.join(free, "n", "left").withColumn("idx", F.coalesce("_free", F.col("n") + (top - size)).cast(store.schema["idx"].dataType)).select("key", "idx", "value")
    return kept.unionByName(placed)


def delete(store: DataFrame, keys: DataFrame) -> DataFrame:
    """The store without these keys; their indices become free."""
    return store.join(keys.select("key").distinct(), "key", "left_anti")
