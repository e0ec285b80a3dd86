"""A vector store for each of many tenants, and free data beside each, as folders of one root.

A tenant is one folder of Parquet files that only it reads, so tenants never meet, and none has to be held in memory or
put out of it. Every change writes a new version and then points to it; readers see the old or the new one.
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quillgraph.operators import vector
from quillgraph.sources.store import InvalidStorageUsageError, Store

_NAME = re.compile(r"[A-Za-z0-9._-]+")
_EMPTY = "id long, embedding array<double>"


class Tenants:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, name: str):
        if not _NAME.fullmatch(name) or name.startswith("."):
            raise InvalidStorageUsageError(f"no name of a tenant: {name!r}")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _store(self, name: str) -> Store:
        return Store(self.spark, f"{self.root}/{name}", keep=2)

    def names(self) -> list[str]:
        fs, path = self._folder("x")
        root = path.getParent()
        return sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()) if fs.exists(root) else []

    def contains(self, name: str) -> bool:
        fs, path = self._folder(name)
        return fs.exists(path)

    def create(self, name: str) -> None:
        """A new tenant without vectors; an error, if there is one of this name."""
        if self.contains(name):
            raise InvalidStorageUsageError(f"there is a tenant {name!r}")
        self._commit(name, self.spark.createDataFrame([], _EMPTY), {})

    def delete(self, name: str) -> None:
        fs, path = self._folder(name)
        fs.delete(path, True)

    def _tables(self, name: str) -> dict[str, DataFrame]:
        tables = self._store(name).load(["vectors", "data"]) if self.contains(name) else None
        if tables is None:
            raise InvalidStorageUsageError(f"there is no tenant {name!r}")
        return tables

    def _commit(self, name: str, vectors: DataFrame, data: dict[str, Any]) -> None:
        store = self._store(name)
        store.commit({"vectors": vectors, "data": self.spark.createDataFrame([(json.dumps(data),)], "json string")})
        store.vacuum()

    def get(self, name: str) -> DataFrame:
        """id, embedding."""
        return self._tables(name)["vectors"]

    def data(self, name: str) -> dict[str, Any]:
        """The free data kept beside a tenant's vectors."""
        return json.loads(self._tables(name)["data"].first()[0])

    def put_data(self, name: str, **values: Any) -> None:
        """Adds to the free data; JSON holds it."""
        self._commit(name, self.get(name), self.data(name) | values)

    def upsert(self, name: str, rows: DataFrame) -> None:
        """rows (id, embedding) into a tenant's store."""
        self._commit(name, vector.upsert(self.get(name), rows).drop("change"), self.data(name))

    def append(self, name: str, rows: DataFrame) -> None:
        """rows beside what is there, whatever their ids: nothing is replaced."""
        old = self.get(name)
        self._commit(name, old.unionByName(rows.select("id", rows["embedding"].cast("array<double>").alias("embedding"))), self.data(name))

    def remove(self, name: str, ids: DataFrame) -> None:
        self._commit(name, vector.delete(self.get(name), ids), self.data(name))

    def query(self, name: str, queries: DataFrame, k: int = 10, least: float | None = None) -> DataFrame:
        """Cosine search in one tenant's store."""
        return vector.query(queries, self.get(name), k, least)
