"""Incremental insert from a stream of documents, and a windowed count of events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.plans.engine import Engine


def insert_stream(docs: DataFrame, engine: Engine, checkpoint: str, once: bool = True) -> StreamingQuery:
    """A streaming DataFrame (doc_id, text, metadata) into the engine, one version a batch. A batch that is delivered again adds nothing: its chunks are known."""
    stream = docs.writeStream.foreachBatch(lambda batch, _: engine.insert(batch) and None).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start() if once else stream.start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type; works on static and streaming tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
