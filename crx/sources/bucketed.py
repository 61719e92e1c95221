"""Tables that batches of rows are upserted into, bucketed by their key.

Files are partitioned by a hash of the key (`part`) and bucketed by the key inside. An
upsert reads and rewrites only the parts that the batch falls into; the bucketed scan is
joined as it lies, so the batch is shuffled and the target isn't. Spark swaps the
rewritten parts when all of them are written, files of other parts stay as they are.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crx.operators.maintain import upsert_by_key
from crx.plans.session import ensure_checkpoint_dir

OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


class BucketedTable:
    """A table of the session's catalog whose files lie in the shared folder."""

    def __init__(self, rows: DataFrame, keys: list[str], parts: int = 16, buckets: int = 8, name: str | None = None):
        """Store `rows`. A part of `parts` times a bucket of `buckets` should fit a task."""
        self.spark: SparkSession = rows.sparkSession
        self.keys, self.parts, self.buckets, self.columns = keys, parts, buckets, rows.columns
        self.name = name or f"upserts_{uuid.uuid4().hex}"
        self.path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/upserts/{self.name}"
        (rows.withColumn("part", self._part()).repartition(buckets, *keys).write.partitionBy("part").bucketBy(buckets, *keys).sortBy(*keys)
         .option("path", self.path).saveAsTable(self.name))

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def read(self) -> DataFrame:
        return self.spark.table(self.name).select(*self.columns)

    def merged(self, batch: DataFrame, cols: list[str], order_col: str = "seq", defaults: dict[str, Column] | None = None) -> DataFrame:
        """The rows, after the upsert, of the parts that the batch touches, with `part`."""
        touched = [r.part for r in batch.select(self._part().alias("part")).distinct().collect()]  # at most `parts`
        target = self.spark.table(self.name).filter(F.col("part").isin(touched)).select(*self.columns)
        # combined first, then dealt as the target lies, so that the join leaves the target in place
        latest = batch.groupBy(*self.keys).agg(F.max_by(F.struct(*cols), order_col).alias("_row"), F.max(order_col).alias(order_col))
        dealt = latest.select(*self.keys, "_row.*", order_col).repartition(self.buckets, *self.keys)
        return upsert_by_key(target, dealt, self.keys, cols, order_col, defaults).withColumn("part", self._part())

    def upsert(self, batch: DataFrame, cols: list[str], order_col: str = "seq", defaults: dict[str, Column] | None = None) -> None:
        rows = self.merged(batch, cols, order_col, defaults)
        with self._only_touched():
            rows.select(*self.columns, "part").write.insertInto(self.name, overwrite=True)

    @contextmanager
    def _only_touched(self):
        before = self.spark.conf.get(OVERWRITE, None)
        self.spark.conf.set(OVERWRITE, "dynamic")
        try:
            yield
        finally:
            self.spark.conf.set(OVERWRITE, before) if before else self.spark.conf.unset(OVERWRITE)
