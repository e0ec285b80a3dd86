"""Versions of a set of tables as Parquet folders; the newest readable one is used, older ones are kept for rollback."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession


class InvalidStorageError(Exception):
    """No version can be read."""


class InvalidStorageUsageError(Exception):
    """A store is asked for what its state does not allow."""


#: What Spark says of files that are there but are no tables of ours; all else may pass, and is raised as it is.
_UNREADABLE = ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND", "CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE", "is not a Parquet file", "PARQUET_COLUMN_DATA_TYPE_MISMATCH", "expected magic number")


class Store:
    """<root>/<number>/<table>. A version is complete once its _DONE file exists; numbers are seconds, or follow the last one."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 3):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *map(str, parts)]))

    def versions(self) -> list[int]:
        """Complete versions, newest first; folders of other names are ignored."""
        fs = self._fs()
        if not fs.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path())]
        return sorted((int(n) for n in names if n.isdigit() and fs.exists(self._path(n, "_DONE"))), reverse=True)

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Write all tables as a new version; readers see it only when all are there."""
        version = max([int(time.time()), *(v + 1 for v in self.versions()[:1])])
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{version}/{name}")
        self._fs().create(self._path(version, "_DONE"), True).close()
        return version

    def load(self, names: list[str], version: int | None = None) -> dict[str, DataFrame] | None:
        """The tables of a version, by default the newest that can be read; None for an empty store.

        Versions whose files are missing or no tables are set aside as 0__err_<number>, but not one that is asked for by
        number. Other faults, such as of the network, are raised and change nothing.
        """
        known = self.versions() if version is None else [version]
        for v in known:
            try:
                tables = {n: self.spark.read.parquet(f"{self.root}/{v}/{n}") for n in names}
                for df in tables.values():
                    df.limit(1).collect()
                return tables
            except Exception as e:
                if not any(x in str(e) for x in _UNREADABLE):
                    raise
                error = e
                if version is None:
                    self._fs().rename(self._path(v), self._path(f"0__err_{v}"))
        if known:
            raise InvalidStorageError(f"no version under {self.root} can be read") from error
        return None

    def vacuum(self) -> list[int]:
        """Delete all but the newest `keep` versions; returns those deleted."""
        old = self.versions()[self.keep :]
        for v in old:
            self._fs().delete(self._path(v), True)
        return old
