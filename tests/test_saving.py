"""Saving reviews: batches become visible whole, once, and replace earlier saves."""

import os
import tempfile

import pytest

from crx.sources import readers as RD
from crx.sources.commits import BatchLog
from crx.sources.tables import conform


def _tables(spark, ids, title, per=2):
    reviews = spark.createDataFrame([(i, "completed" if i % 2 else "failed") for i in ids], "id long, status string")
    issues = spark.createDataFrame([(i * 10 + j, i, f"{title}{j}") for i in [*ids, 99] for j in range(per)], "id long, review_record_id long, title string")
    return conform("review_records", reviews), conform("review_issues", issues)


def _seen(spark, path):
    r, i = RD.load_reviews(spark, path)
    return sorted((x.id, x.status) for x in r.collect()), sorted((x.review_record_id, x.title) for x in i.collect())


def test_replayed_batch_leaves_the_same_rows(spark):
    base = tempfile.mkdtemp(prefix="crx-test-save-", dir=os.environ.get("CRX_SCRATCH", "/tmp"))
    assert _seen(spark, base) == ([], [])
    for _ in range(3):
        RD.save_reviews(*_tables(spark, [1, 2], "a"), base, batch=5)
    once = ([(1, "completed"), (2, "failed")], [(1, "a0"), (1, "a1"), (2, "a0"), (2, "a1")])
    assert _seen(spark, base) == once
    BatchLog(spark, base).vacuum()
    assert _seen(spark, base) == once and len(BatchLog(spark, base)._names("data/*/batch=*/attempt=*")) == 2
    # the batch written again with other rows replaces all of it, partitions too
    RD.save_reviews(*_tables(spark, [1], "b", per=1), base, batch=5)
    assert _seen(spark, base) == ([(1, "completed")], [(1, "b0")])


def test_review_saved_again_in_a_later_batch_replaces_its_issues(spark):
    base = tempfile.mkdtemp(prefix="crx-test-save-", dir=os.environ.get("CRX_SCRATCH", "/tmp"))
    RD.save_reviews(*_tables(spark, [1, 2], "a"), base, batch=1)
    RD.save_reviews(*_tables(spark, [2, 3], "b", per=1), base, batch=2)
    assert _seen(spark, base) == ([(1, "completed"), (2, "failed"), (3, "completed")], [(1, "a0"), (1, "a1"), (2, "b0"), (3, "b0")])
    RD.save_reviews(*_tables(spark, [1, 2], "a"), base, batch=1)  # a late replay doesn't win over the later batch
    assert _seen(spark, base)[1] == [(1, "a0"), (1, "a1"), (2, "b0"), (3, "b0")]


def test_a_batch_that_failed_half_way_is_not_seen(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="crx-test-save-", dir=os.environ.get("CRX_SCRATCH", "/tmp"))
    RD.save_reviews(*_tables(spark, [1], "a"), base, batch=1)
    reviews, issues = _tables(spark, [2], "b")
    broken = issues.withColumn("title", RD.F.expr("raise_error('lost')").cast("string"))
    with pytest.raises(Exception, match="lost"):
        RD.save_reviews(reviews, broken, base, batch=2)
    assert _seen(spark, base) == ([(1, "completed")], [(1, "a0"), (1, "a1")])
    log = BatchLog(spark, base)
    assert len(log._names("data/review_records/batch=2/attempt=*")) == 1  # written, but no reader finds it
    log.vacuum()
    assert not log._names("data/review_records/batch=2/attempt=*")


def test_upsert_rewrites_touched_parts_without_shuffling_the_target(spark):
    from crx.operators.maintain import upsert_by_key
    from crx.sources.bucketed import BucketedTable
    rows = spark.range(5_000).selectExpr("id", "concat('n', id) AS name", "id % 3 = 0 AS old")
    table = BucketedTable(rows, ["id"], parts=8, buckets=4)

    def files():
        return {f for f in table.spark.table(table.name).inputFiles()}
    before = files()
    batch = spark.createDataFrame([(7, "x", 1), (7, "y", 2), (10_001, "new", 1)], "id long, name string, seq int")
    want = sorted(map(str, upsert_by_key(rows, batch, ["id"], ["name"], defaults={"old": RD.F.lit(True)}).collect()))
    plan = table.merged(batch, ["name"])._jdf.queryExecution().executedPlan().toString()
    scan_side = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scan_side) == 1 and "Bucketed: true" in scan_side[0] and "PartitionFilters: [" in scan_side[0]
    exchanged = plan[:plan.index("FileScan")].rsplit("SortMergeJoin", 1)[-1]
    assert "Exchange" not in exchanged, plan
    table.upsert(batch, ["name"], defaults={"old": RD.F.lit(True)})
    assert sorted(map(str, table.read().collect())) == want
    after = files()
    untouched = {f for f in before if f in after}
    changed = {f.split("part=")[1].split("/")[0] for f in before - after}
    assert len(changed) <= 2 and {f.split("part=")[1].split("/")[0] for f in untouched} == {str(i) for i in range(8)} - changed
    table.upsert(batch.limit(0), ["name"])
    assert sorted(map(str, table.read().collect())) == want and files() == after
