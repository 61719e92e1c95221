"""Batches of files that become visible as a whole, and once.

A writer puts the files of a batch, for any number of tables, into folders of its own
and then publishes the batch: one empty file, whose name holds batch, version and
attempt, appears at once. Readers list these files and read the folders they name, so
they see all tables of a batch or none. Writing a batch again (a retried job) publishes
a higher version, which replaces the earlier one.

Folders are `data/<table>/batch=<n>/attempt=<id>`, so one scan over the live ones
gives every row its batch. A listing has one entry per batch, or per live folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class BatchLog:
    """The published batches below `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        found = self._fs.globStatus(self._hadoop.Path(f"{self.path}/{pattern}"))
        return [str(s.getPath().toString()) for s in found or []]

    def _marks(self) -> list[tuple[int, int, str]]:
        """(batch, version, attempt), in order."""
        parts = [n.rsplit("/", 1)[-1].split(".") for n in self._names("_batches/*")]
        return sorted((int(b), int(v), attempt) for b, v, attempt in parts)

    def new_attempt(self) -> str:
        return uuid.uuid4().hex

    def folder(self, table: str, batch: int, attempt: str) -> str:
        return f"{self.path}/data/{table}/batch={batch}/attempt={attempt}"

    def publish(self, batch: int, attempt: str) -> None:
        """Make the attempt the one that readers see of the batch."""
        version = max((v for b, v, _ in self._marks() if b == batch), default=0) + 1
        self._fs.create(self._hadoop.Path(f"{self.path}/_batches/{batch:020d}.{version:06d}.{attempt}"), False).close()

    def live(self, before: int | None = None) -> dict[int, str]:
        """Batch -> its attempt, of all batches or those before one."""
        return {b: attempt for b, _, attempt in self._marks() if before is None or b < before}

    def read(self, table: str, schema: T.StructType, folders: list[str] | None = None) -> DataFrame:
        """The rows of `table` in the live folders (or those given), with `batch`."""
        whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        if folders is None:
            folders = [self.folder(table, b, attempt) for b, attempt in self.live().items()]
        if not folders:
            return self.spark.createDataFrame([], whole)
        rows = self.spark.read.schema(whole).option("basePath", f"{self.path}/data/{table}").parquet(*folders)
        return rows.select(*whole.names)

    def parts(self, table: str, inner: str) -> list[str]:
        """Paths of the folders that match `inner` inside any batch and attempt of a table."""
        return self._names(f"data/{table}/batch=*/attempt=*/{inner}")

    def vacuum(self, keep: set[str] | None = None) -> None:
        """Delete the files of attempts that were replaced or never published, or all but
        those in `keep`. Marks go first, so no reader finds a mark without its files. Not
        for use while another writer is at work."""
        keep = set(self.live().values()) if keep is None else keep
        for batch, version, attempt in self._marks():
            if attempt not in keep:
                self._fs.delete(self._hadoop.Path(f"{self.path}/_batches/{batch:020d}.{version:06d}.{attempt}"), False)
        for path in self._names("data/*/batch=*/attempt=*"):
            if path.rsplit("attempt=", 1)[-1] not in keep:
                self._fs.delete(self._hadoop.Path(path), True)
