"""Structured Streaming jobs (§2.9) built from the batch operators.

Sinks are files in the shared folder (never the driver). Append-only outputs are
plain parquet. The current status of each review is kept in hash buckets
(`KeyedTable`), of which a micro-batch rewrites those it touches. A daily count goes to
one folder per micro-batch, overwritten when the batch is replayed. So a restart changes
nothing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crx.functions.common import instant_utc_date, ntz_to_instant
from crx.operators import events as EV
from crx.streaming.keyed import KeyedTable


def run_available_now(query_builder, name: str) -> None:
    q = query_builder.queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def review_requests_stream(deliveries: DataFrame, repos: DataFrame, configs: DataFrame, out_path: str,
                           checkpoint: str, name: str = "review_requests") -> None:
    """parse -> route -> gate as one stateless streaming query (stream-static
    joins to repositories and configs), appended to parquet."""
    reqs = EV.review_requests(deliveries, repos, configs)
    run_available_now(reqs.writeStream.format("parquet").option("path", out_path)
                      .option("checkpointLocation", checkpoint).outputMode("append"), name)


@contextmanager
def shuffle_parts(spark: SparkSession, parts: int) -> Iterator[None]:
    """A stream takes the number of its state's parts, which nothing coalesces, from the
    session when it starts; the session gets its own number back."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(parts))
    try:
        yield
    finally:
        spark.conf.set(key, before)


TREND_PARTS = 16  # the state holds a row a day; each part costs a task, and a task result, per micro-batch
TREND_SCHEMA = "day string, issue_count bigint, batch bigint"


def issue_trend_stream(issues: DataFrame, out_base: str, checkpoint: str, watermark: str = "2 days",
                       name: str = "issue_trend", parts: int = TREND_PARTS) -> None:
    """Daily issue counts over a stream: 1-day tumbling windows on created_at
    with a watermark, so state for days behind the watermark is evicted (rows
    that late may be dropped; Spark does not guarantee it). Each micro-batch
    appends the days it changed."""
    ev = issues.withColumn("event_time", ntz_to_instant(F.col("created_at")))
    counts = (ev.withWatermark("event_time", watermark)
              .groupBy(F.window("event_time", "1 day").alias("w"))
              .agg(F.count(F.lit(1)).alias("issue_count"))
              .select(F.date_format(instant_utc_date(F.col("w.start")), "yyyy-MM-dd").alias("day"), "issue_count"))

    def append(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_base}/batch={epoch_id}")
    with shuffle_parts(issues.sparkSession, parts):
        run_available_now(counts.writeStream.outputMode("update").foreachBatch(append)
                          .option("checkpointLocation", checkpoint), name)


def read_issue_trend(spark: SparkSession, out_base: str) -> DataFrame:
    """(day, issue_count): the count of the last micro-batch that changed the day."""
    return (spark.read.schema(TREND_SCHEMA).parquet(out_base)
            .groupBy("day").agg(F.max_by("issue_count", "batch").alias("issue_count")))


LIFECYCLE_SCHEMA = "review_id bigint, status string, error_message string, ts timestamp_ntz, seq bigint"
LIFECYCLE_BUCKETS = 16


def _lifecycle(spark: SparkSession, path: str, buckets: int = LIFECYCLE_BUCKETS) -> KeyedTable:
    return KeyedTable(spark, path, LIFECYCLE_SCHEMA, ["review_id"], ["ts", "seq"], buckets)


def review_lifecycle_stream(status_events: DataFrame, out_path: str, checkpoint: str,
                            name: str = "review_lifecycle", buckets: int = LIFECYCLE_BUCKETS) -> None:
    """The current status of every review, kept up to date by micro-batches: the change
    of the largest (ts, seq), in whatever order changes arrive."""
    state = _lifecycle(status_events.sparkSession, out_path, buckets)
    changes = status_events.withColumn("seq", F.col("seq").cast("bigint"))
    run_available_now(changes.writeStream.outputMode("append").foreachBatch(state.merge).option("checkpointLocation", checkpoint), name)


def read_lifecycle(spark: SparkSession, path: str) -> DataFrame:
    """Current status per review: review_id, status, error_message, updated_at."""
    rows = _lifecycle(spark, path).read()
    return rows.select("review_id", "status", "error_message", F.col("ts").alias("updated_at"))
