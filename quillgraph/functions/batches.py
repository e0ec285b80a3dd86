"""Arrow batches of bounded size, for functions of mapInArrow over texts."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Texts reach Python in batches of so many rows at most, and are held as Python's strings in pieces of about so many bytes; what comes of them leaves in batches of so many rows and about so many letters.
BATCH_ROWS, PIECE_BYTES, OUT_ROWS, OUT_LETTERS = 1000, 1 << 20, 4096, 1 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lean(run):
    """run, a function for mapInArrow, giving memory that it no longer needs back to the system when a task ends: workers live on for other tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                with contextlib.suppress(OSError, AttributeError):  # another C library
                    ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in small batches, for df.transform(): texts are long, and a task holds a batch of them several times over. The session keeps the smaller size."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH, "10000")) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df.mapInArrow(lean(run), schema)


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches, in their order, of about `most` bytes in a column of texts; a longer text is a slice of its own."""
    for batch in batches:
        first = held = 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if i > first and held + (n or 0) > most:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n or 0
        if first < batch.num_rows:
            yield batch.slice(first)


def packed(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType], rows_most: int = OUT_ROWS, letters: int = OUT_LETTERS) -> Iterator[pa.RecordBatch]:
    """Rows as batches of so many rows and about so many letters at most (one row at least)."""
    out: list[tuple] = []
    held = 0
    for row in rows:
        size = sum(len(x) for x in row if isinstance(x, str))
        if out and (len(out) >= rows_most or held + size > letters):
            yield _batch(out, names, kinds)
            out, held = [], 0
        out.append(row)
        held += size
    if out:
        yield _batch(out, names, kinds)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)
