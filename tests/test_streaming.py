"""Streaming jobs: out-of-order status changes and late rows behind the watermark."""

import os
import tempfile
import time

from crx.streaming import jobs as S


def _write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def test_lifecycle_keeps_latest_change_when_older_arrives_later(spark):
    base = tempfile.mkdtemp(prefix="crx-test-life-", dir=os.environ.get("CRX_SCRATCH", "/tmp"))
    schema = "review_id bigint, status string, error_message string, ts timestamp_ntz, seq int"
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    # the newer changes arrive in the first file, the older ones in the second
    _write(spark, [(1, "completed", None, t0 + dt.timedelta(hours=2), 1), (2, "failed", "x", t0 + dt.timedelta(hours=1), 1)],
           schema, f"{base}/in/a")
    time.sleep(1.1)
    _write(spark, [(1, "pending", None, t0, 0), (2, "pending", None, t0, 0), (3, "pending", None, t0, 0)],
           schema, f"{base}/in/b")
    time.sleep(1.1)
    # a large sequence number does not outrank a later time
    _write(spark, [(4, "first", None, t0, 9), (4, "second", None, t0 + dt.timedelta(microseconds=1), 0)], schema, f"{base}/in/c")
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(f"{base}/in"))
    S.review_lifecycle_stream(stream, f"{base}/changes", f"{base}/ckpt", name="t_lifecycle")
    got = {r.review_id: r.status for r in S.read_lifecycle(spark, f"{base}/changes").collect()}
    assert got == {1: "completed", 2: "failed", 3: "pending", 4: "second"}


def test_trend_drops_rows_behind_the_watermark(spark):
    base = tempfile.mkdtemp(prefix="crx-test-trend-", dir=os.environ.get("CRX_SCRATCH", "/tmp"))
    schema = "id bigint, created_at timestamp_ntz"
    import datetime as dt
    d10 = dt.datetime(2024, 1, 11, 12)
    _write(spark, [(1, d10), (2, d10)], schema, f"{base}/in/a")
    time.sleep(1.1)
    # 10 days older than the first batch: behind a 2-day watermark, which Spark
    # may or may not drop; the row on the same day as the first batch counts
    _write(spark, [(3, dt.datetime(2024, 1, 1, 9)), (4, d10)], schema, f"{base}/in/b")
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(f"{base}/in"))
    S.issue_trend_stream(stream, f"{base}/counts", f"{base}/ckpt", watermark="2 days", name="t_trend")
    got = {r.day: r.issue_count for r in S.read_issue_trend(spark, f"{base}/counts").collect()}
    assert got["2024-01-11"] == 3
    assert set(got) <= {"2024-01-11", "2024-01-01"}


LIFE = "review_id bigint, status string, error_message string, ts timestamp_ntz, seq int"


def _life_stream(spark, path):
    return (spark.readStream.schema(LIFE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path))


def test_lifecycle_restarts_where_it_stopped(spark, monkeypatch):
    """A micro-batch whose files are published but whose end the stream never saw comes
    again after a restart: the state is as if it had come once."""
    import datetime as dt

    import pytest

    from crx.streaming.keyed import KeyedTable
    base = tempfile.mkdtemp(prefix="crx-test-life-", dir=os.environ.get("CRX_SCRATCH", "/tmp"))
    t0 = dt.datetime(2024, 1, 1)
    for i, name in enumerate("abc"):
        rows = [(k, f"{name}{k}", None, t0 + dt.timedelta(days=900 * i + k), i) for k in range(i * 10, 200)]
        _write(spark, rows, LIFE, f"{base}/in/{name}")
        time.sleep(1.1)
    merge = KeyedTable.merge

    def dies(self, changes, batch):
        merge(self, changes, batch)
        if batch == 1:
            raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "merge", dies)
        with pytest.raises(Exception, match="lost"):
            S.review_lifecycle_stream(_life_stream(spark, f"{base}/in"), f"{base}/now", f"{base}/ckpt", name="t_life_dies")
    half = {r.review_id: r.status for r in S.read_lifecycle(spark, f"{base}/now").collect()}
    assert half == {k: f"b{k}" if k >= 10 else f"a{k}" for k in range(200)}
    S.review_lifecycle_stream(_life_stream(spark, f"{base}/in"), f"{base}/now", f"{base}/ckpt", name="t_life_again")
    got = S.read_lifecycle(spark, f"{base}/now").collect()
    assert {r.review_id: r.status for r in got} == {k: f"c{k}" if k >= 20 else f"b{k}" if k >= 10 else f"a{k}" for k in range(200)} and len(got) == 200


def test_keyed_table_rewrites_only_touched_buckets(spark):
    """Files of other buckets stay as they are; a batch that comes again replaces itself;
    files nobody needs are gone; a key's history costs nothing."""
    from crx.streaming.keyed import KeyedTable
    base = tempfile.mkdtemp(prefix="crx-test-keyed-", dir=os.environ.get("CRX_SCRATCH", "/tmp"))
    t = KeyedTable(spark, base, "k long, v string, at long", ["k"], ["at"], buckets=8)
    assert t.read().count() == 0
    t.merge(spark.createDataFrame([(k, "a", 1) for k in range(100)], t.schema), 0)
    first = t._folders()
    assert len(first) == 8
    t.merge(spark.createDataFrame([(7, "late", 0), (7, "b", 2), (None, "n", 1)], t.schema), 1)
    second = t._folders()
    changed = {b for b in first if first[b] != second[b]}
    assert 1 <= len(changed) <= 2
    t.merge(spark.createDataFrame([(7, "b2", 2), (None, "n", 1)], t.schema), 1)
    got = {r.k: r.v for r in t.read().collect()}
    assert got == {**{k: "a" for k in range(100)}, 7: "b2", None: "n"}
    for batch in range(2, 6):
        t.merge(spark.createDataFrame([(7, f"v{batch}", batch + 1)], t.schema), batch)
    assert {r.k: r.v for r in t.read().collect()}[7] == "v5" and t.read().count() == 101
    assert len(t.log.parts("state", "bucket=*")) <= 8 + 2 + 2  # live ones, and what the last batch replaced
    t.merge(spark.createDataFrame([], t.schema), 6)
    assert t.read().count() == 101


def test_state_of_the_trend_has_few_parts_whatever_the_session_has(spark, tmp_path):
    import os

    from crx.streaming import jobs as S
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.sql("SELECT id, timestamp_ntz'2024-01-01' + make_dt_interval(id % 5) AS created_at FROM range(50)").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id bigint, created_at timestamp_ntz").parquet(f"{tmp_path}/in")
    spark.conf.set(key, "40")
    try:
        S.issue_trend_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt", watermark="36500 days")
        assert spark.conf.get(key) == "40"
    finally:
        spark.conf.set(key, before)
    assert len([d for d in os.listdir(f"{tmp_path}/ckpt/state/0") if d.isdigit()]) == S.TREND_PARTS
    assert sorted(r.issue_count for r in S.read_issue_trend(spark, f"{tmp_path}/out").collect()) == [10] * 5


def test_large_bucket_of_a_keyed_table_is_folded_by_several_tasks(spark):
    from pyspark.sql import functions as F
    from crx.streaming.keyed import KeyedTable
    base = tempfile.mkdtemp(prefix="crx-test-shares-", dir=os.environ.get("CRX_SCRATCH", "/tmp"))
    t = KeyedTable(spark, base, "k long, v string, at long", ["k"], ["at"], buckets=2, task_rows=100)
    t.merge(spark.createDataFrame([(k, "a", 1) for k in range(1000)] + [(None, "a", 1)], t.schema), 0)
    files = t.read().groupBy(F.input_file_name().alias("f")).count().collect()
    assert len(files) > 4 and max(r["count"] for r in files) < 500
    t.merge(spark.createDataFrame([(k, "b", k % 2 * 2) for k in range(1000)] + [(None, "b", 2)], t.schema), 1)
    got = {r.k: r.v for r in t.read().collect()}
    assert got == {**{k: "b" if k % 2 else "a" for k in range(1000)}, None: "b"} and t.read().count() == 1001
