"""The current row of every key, kept by a stream.

Rows live in hash buckets of their key. A micro-batch reads and rewrites only the
buckets its changes fall into, in one shuffle, and publishes them as one batch
(`BatchLog`); a bucket's current files are those of the latest batch that wrote it.
A replayed micro-batch starts from the batches before it and replaces what it wrote, so
a restart changes nothing. Cost follows the touched buckets, not the length of the
history; files that no bucket needs any more are deleted. A table and the checkpoint of
the stream that fills it belong together: batch numbers must go on, not start anew.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crx.sources.commits import BatchLog

TABLE = "state"
TASK_ROWS = 500_000  # rows that a task folds, on average


class KeyedTable:
    """`schema` of the rows, `keys`, and the columns whose largest value, compared in
    turn, is the current row of a key. `buckets` bounds the folders of a batch; a bucket of
    more than `task_rows` rows is folded by several tasks, each with a share of its keys."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str], order: list[str], buckets: int = 16,
                 task_rows: int = TASK_ROWS):
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.log, self.keys, self.order, self.buckets, self.task_rows = BatchLog(spark, path), keys, order, buckets, task_rows

    def _latest(self, rows: DataFrame, *more: str) -> DataFrame:
        rest = [c for c in self.schema.names if c not in self.keys]
        best = F.max_by(F.struct(*rest), F.struct(*self.order))
        return rows.groupBy(*more, *self.keys).agg(best.alias("_row")).select(*more, *self.keys, "_row.*").select(*more, *self.schema.names)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _folders(self, before: int | None = None) -> dict[int, str]:
        """Bucket -> its current folder."""
        live, newest = self.log.live(before), {}
        for path in self.log.parts(TABLE, "bucket=*"):
            batch, attempt, bucket = re.search(r"batch=(\d+)/attempt=(\w+)/bucket=(\d+)$", path).groups()
            if live.get(int(batch)) == attempt and int(batch) >= newest.get(int(bucket), (-1, ""))[0]:
                newest[int(bucket)] = (int(batch), path)
        return {b: path for b, (_, path) in newest.items()}

    def merge(self, changes: DataFrame, batch: int) -> None:
        """Fold a batch of changes into the table. Batches come in ascending order; the
        last one may come again."""
        latest = self._latest(changes.select(*self.schema.names)).withColumn("bucket", self._bucket()).persist()
        try:
            counts = {r.bucket: r["count"] for r in latest.groupBy("bucket").count().collect()}  # at most `buckets`
            folders = self._folders(before=batch)
            old = self.log.read(TABLE, self.schema, [folders[b] for b in counts if b in folders]).withColumn("bucket", self._bucket())
            rows = old.select("bucket", *self.schema.names).union(latest.select("bucket", *self.schema.names))
            tasks = max(1, -(-(sum(counts.values()) + old.count()) // self.task_rows))
            shares = -(-tasks // max(len(counts), 1))
            # another hash than the bucket's, so that a bucket's keys spread
            dealt = rows.withColumn("share", F.pmod(F.hash(*self.keys), F.lit(shares))).repartition(max(len(counts), 1) * shares, "bucket", "share")
            attempt = self.log.new_attempt()
            folded = self._latest(dealt, "bucket", "share").drop("share")
            folded.write.partitionBy("bucket").parquet(self.log.folder(TABLE, batch, attempt))
        finally:
            latest.unpersist()
        self.log.publish(batch, attempt)
        needed = {re.search(r"attempt=(\w+)", p)[1] for at in (batch, None) for p in self._folders(before=at).values()}
        self.log.vacuum(keep=needed | {attempt})

    def read(self) -> DataFrame:
        """One row per key."""
        return self.log.read(TABLE, self.schema, list(self._folders().values())).select(*self.schema.names)
