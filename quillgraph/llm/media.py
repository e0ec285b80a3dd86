"""Media columns: payloads kept by content in tar shards of the shared folder; rows carry digest, shard, offset and length.

Tasks write shards under names of their own (partition and attempt), each content once a shard, and a table of places
is written from what they return: a task that is run again leaves an unused shard, never a broken reference. Header
columns come from range reads of the first bytes of a member. All access is through pyarrow's file systems, so the
folder may be on local disk, HDFS or an object store.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.sources.scratch import Scratch
from quillgraph.llm.textbytes import mapped

WIDTH = 64
SHARD_BYTES = 64 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
_CATALOG = "doc_id long, digest binary, n_bytes long, shard string, at long, length long"


def payload_of(text: bytes) -> bytes:
    """The bytes, and zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def to_png(payload: bytes) -> bytes:
    """A lossless 8-bit grey image, 64 samples a row, each sample one byte of the payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    body = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with filter 0
    body[:, 1:] = rows
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return _SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(body.tobytes(), 6)) + part(b"IEND", b"")


def header_of(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from an image's first bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("no PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(media: bytes) -> bytes:
    """The payload of what to_png() made."""
    width, height, _ = header_of(media)
    at, data = 8, b""
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        if zlib.crc32(media[at + 4 : at + 8 + n]) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a PNG part is damaged")
        data += media[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def features_of(payload: bytes) -> str:
    """Sample count, sum, number of distinct values and of changes between neighbours."""
    x = np.frombuffer(payload, np.uint8)
    return f"n={len(x)};sum={int(x.sum(dtype=np.int64))};distinct={len(np.unique(x))};changes={int((x[1:] != x[:-1]).sum())}"


class _Shards:
    """Writes members to tar shards and tells where their bytes begin."""

    def __init__(self, folder: str, name: str):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(folder)
        self.name, self.number, self.file = name, 0, None

    def add(self, name: str, data: bytes) -> tuple[str, int]:
        if self.file is None:
            self.shard = f"{self.name}-{self.number:05d}.tar"
            self.file, self.at = self.fs.open_output_stream(f"{self.path}/{self.shard}"), 0
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.file.write(head + data + bytes(-len(data) % 512))
        place = self.shard, self.at + len(head)
        self.at += len(head) + len(data) + -len(data) % 512
        if self.at >= SHARD_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self.file is not None:
            self.file.write(bytes(1024))
            self.file.close()
            self.file, self.number = None, self.number + 1


def store(docs: DataFrame, folder: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, digest, n_bytes, shard, at, length; writing the shards is part of computing it, so write it to a table once. A null text is the empty payload."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        shards, known = _Shards(folder, f"part-{task.partitionId():05d}-{task.taskAttemptId()}"), {}
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                text = text or b""
                payload = payload_of(text)
                digest = hashlib.sha256(payload).digest()
                if digest not in known:
                    media = to_png(payload)
                    known[digest] = (*shards.add(f"{digest.hex()}.png", media), len(media))
                rows.append((doc_id, digest, len(text), *known[digest]))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = [pa.array(list(x), t) for x, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n_bytes", "shard", "at", "length"])
        shards.close()

    return docs.select("doc_id", "text").transform(mapped, run, _CATALOG)


def places(catalog: DataFrame) -> DataFrame:
    """One place for each content: digest, shard, at, length. Tasks get ranges of shards, in the order of their bytes, so that they are read from front to back."""
    one = catalog.groupBy("digest").agg(F.min(F.struct("shard", "at", "length")).alias("p"))
    parts = int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return one.select("digest", "p.*").repartitionByRange(parts, "shard", "at").sortWithinPartitions("shard", "at")


def _read(rows: DataFrame, folder: str, schema: str, size, use) -> DataFrame:
    """Adds columns from size(length) bytes read at each place."""
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(added)
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        shard = file = None
        for batch in batches:
            found = []
            for name, at, length in zip(*[batch.column(c).to_pylist() for c in ("shard", "at", "length")]):
                if name != shard:
                    if file is not None:
                        file.close()
                    shard, file = name, fs.open_input_file(f"{path}/{name}")
                found.append(use(file.read_at(size(length), at)))
            new = [pa.array(list(x), f.type) for x, f in zip(zip(*found), kinds)] if found else [pa.array([], f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *kinds.names])
        if file is not None:
            file.close()

    return rows.transform(mapped, run, StructType([*rows.schema.fields, *added.fields]))


def header_columns(rows: DataFrame, folder: str) -> DataFrame:
    """Adds width, height and bits, from a range read of each member's header alone."""
    return _read(rows, folder, "width int, height int, bits int", lambda n: min(n, HEADER_BYTES), header_of)


def content_columns(rows: DataFrame, folder: str) -> DataFrame:
    """Adds what whole members tell: sizes, digests and features of the payload read back and of the stored form."""

    def use(media: bytes) -> tuple:
        payload = from_png(media)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features_of(payload)

    return _read(rows, folder, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", lambda n: n, use)


def media_table(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height, digest, shard, at, length for each row of docs.

    Null or empty text: 64 zero bytes. Rows of equal text share one place and all values. No rows: no rows. Other columns are dropped.
    """
    scratch = Scratch(spark, "media")
    folder = scratch.folder("shards")
    catalog = scratch.table(store(docs, folder))
    found = content_columns(header_columns(places(catalog), folder), folder)
    return catalog.select("doc_id", "n_bytes", "digest").join(scratch.table(found), "digest")
