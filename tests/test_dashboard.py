"""Dashboard queries on hand-made rows (shape of the reference's stats tests)."""

import datetime as dt

from crx.operators import dashboard as D

NOW = dt.datetime(2024, 3, 10, 12, 0, 0)


def _tables(spark):
    repos = spark.createDataFrame([(1, "o/r", "r"), (2, "o/idle", "idle")], "id long, full_name string, name string")
    prs = spark.createDataFrame([(1, 1, 7, "t")], "id long, repository_id long, pr_number long, title string")
    recs = spark.createDataFrame([(i, 1, "completed", NOW) for i in range(1, 11)],
                                 "id long, pull_request_id long, status string, created_at timestamp_ntz")
    issues = ([(100 + i, i, "critical", "security", NOW - dt.timedelta(days=1)) for i in range(1, 6)]
              + [(200 + i, i, "warning", "logic", NOW - dt.timedelta(days=1)) for i in range(6, 9)])
    iss = spark.createDataFrame(issues, "id long, review_record_id long, severity string, category string, "
                                        "created_at timestamp_ntz")
    return repos, prs, recs, iss


def test_overview(spark):
    repos, prs, recs, iss = _tables(spark)
    r = D.overview_stats(recs, iss, prs, repos).collect()[0]
    assert (r.total_reviews, r.total_issues, r.critical_count, r.warning_count, r.suggestion_count,
            r.active_repos, r.avg_issues_per_review) == (10, 8, 5, 3, 0, 1, 0.8)


def test_distribution_trend_and_comparison(spark):
    repos, prs, recs, iss = _tables(spark)
    sev = {r.severity: r.issue_count for r in D.severity_distribution(iss).collect()}
    assert sev == {"critical": 5, "warning": 3, "suggestion": 0}
    trend = D.issue_trend(iss, days=7, as_of=str(NOW)).orderBy("date").collect()
    assert len(trend) == 7 and sum(r.issue_count for r in trend) == 8
    assert trend[0].date == "2024-03-03" and trend[-1].date == "2024-03-09"
    cmp_ = [(r.repo_name, r.total_reviews, r.total_issues, r.critical_count)
            for r in D.repo_comparison(repos, prs, recs, iss).collect()]
    assert cmp_ == [("o/r", 10, 8, 5)]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(1, 4), (3, 4), (0, 0), (7, 20), (9, 20)], "t long, r long")
    from crx.functions.common import round_half_even_ratio
    from pyspark.sql import functions as F
    got = [x.v for x in df.select(round_half_even_ratio(F.col("t"), F.col("r")).alias("v")).collect()]
    assert got == [0.2, 0.8, 0.0, 0.4, 0.4]


def test_parts_of_issues_by_file_follow_the_rows(spark, monkeypatch):
    """A session with few shuffle partitions gets more of them for more rows, with the same result."""
    from crx.plans import q_dashboard as Q
    from crx.plans import session as S
    small = "/root/testdata/sf0.001"
    assert S.parts_for(spark.range(100), 10) == 10 and S.parts_for(spark.range(100), 50) is None
    want = sorted(map(str, Q.q_issues_by_file(spark, small).collect()))
    monkeypatch.setattr(Q, "parts_for", lambda rows: S.parts_for(rows, 200))
    got = Q.q_issues_by_file(spark, small)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert got._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 4
    assert sorted(map(str, got.collect())) == want
