"""Tables written once to the folder that driver and executors share.

A written table cuts the lineage: when an executor is lost, what it held is read again from shared storage, and
functions that ran before the write do not run twice.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What is sent to all executors is of so many bytes at most, whatever its rows.
BROADCAST_BYTES = 64 << 20


def small(table: DataFrame, rows: int, most: int = BROADCAST_BYTES) -> bool:
    """May this written table be broadcast? It has so many rows and bytes of values at most: both are counted. Columns of other kinds than text, bytes and single values count as their JSON."""
    size = F.lit(0).cast("long")
    for f in table.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(0))
        else:
            size = size + F.lit(8)
    n = table.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n[0] <= rows and n[1] <= most


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Unset and on a local master: a new temporary folder; on a cluster: an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scratch:
    """A folder of its own inside the shared folder; it goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._fs(self.root).deleteOnExit(self._path(self.root))

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def table(self, df: DataFrame) -> DataFrame:
        """Write df and read it back; `path` of the result's table is kept in its _scratch attribute."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def folder(self, name: str) -> str:
        path = f"{self.root}/{name}"
        self._fs(path).mkdirs(self._path(path))
        return path

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing will read again."""
        self._fs(df._scratch).delete(self._path(df._scratch), True)

    def clear(self) -> None:
        """Delete all tables of this folder."""
        self._fs(self.root).delete(self._path(self.root), True)
