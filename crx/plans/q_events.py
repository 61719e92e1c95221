"""Registered event, streaming and maintenance queries (§2.9, §2.1)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crx.operators import events as EV
from crx.operators import maintain as M
from crx.plans.registry import query
from crx.plans.session import ensure_checkpoint_dir
from crx.sources import fixtures as X
from crx.sources import readers as RD
from crx.sources.bucketed import BucketedTable
from crx.sources.fixture_sql import register, sql_str
from crx.sources.tables import DEFAULTS, load_tables
from crx.streaming import jobs as S

register("wh_seed", """
  SELECT event_id AS delivery_id, event_type AS src, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k,
         user_id, user_id % 30 AS nkey, ts
  FROM events""")

register("wh_geo", """
  SELECT w.*, CASE WHEN w.nkey < 25 THEN lower(r.r_name) ELSE 'ghost' END AS g_owner,
         CASE WHEN w.nkey < 25 THEN lower(n.n_name) ELSE 'repo' || w.nkey::VARCHAR END AS g_repo,
         CASE WHEN w.src IN ('purchase', 'click') THEN 'pull_request' WHEN w.src = 'view' THEN 'issue_comment'
              WHEN w.src = 'error' THEN CASE WHEN w.k % 2 = 0 THEN 'installation_repositories' ELSE 'installation' END
              ELSE 'ping' END AS event_type,
         CASE WHEN w.src = 'purchase' THEN ['opened','reopened','closed'][(w.k % 3)::INT + 1]
              WHEN w.src = 'click' THEN 'synchronize'
              WHEN w.src = 'view' THEN CASE WHEN w.k % 2 = 0 THEN 'created' ELSE 'edited' END
              WHEN w.src = 'error' THEN 'created' ELSE '' END AS action
  FROM wh_seed w LEFT JOIN nation n ON n.n_nationkey = w.nkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")

_BODIES = "[" + ", ".join(sql_str(b) for b in X.COMMENT_BODIES) + "]"

register("wh_exp", f"""
  SELECT delivery_id, event_type, action, ts,
    CASE WHEN event_type = 'pull_request' AND action IN ('opened', 'reopened') THEN 'pr_open'
         WHEN event_type = 'pull_request' AND action = 'synchronize' THEN 'pr_sync'
         WHEN event_type = 'issue_comment' THEN 'comment'
         WHEN event_type IN ('installation', 'installation_repositories') THEN 'installation' ELSE 'unknown' END AS event_class,
    g_owner, g_repo, k, user_id,
    {_BODIES}[(k % 8)::INT + 1] AS body
  FROM wh_geo""")

register("wh_ids", """
  SELECT delivery_id, event_class,
    CASE WHEN event_class IN ('pr_open', 'pr_sync', 'comment') THEN g_owner ELSE '' END AS owner,
    CASE WHEN event_class IN ('pr_open', 'pr_sync', 'comment') THEN g_repo ELSE '' END AS repo,
    CAST(CASE WHEN event_class IN ('pr_open', 'pr_sync') THEN CASE WHEN k % 4 <> 0 THEN delivery_id ELSE delivery_id + 1000000 END
         WHEN event_class = 'comment' THEN CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN 0 ELSE delivery_id END
         ELSE 0 END AS BIGINT) AS pr_number,
    CASE WHEN event_class = 'unknown' THEN '' ELSE 'user' || user_id::VARCHAR END AS sender,
    CAST(CASE WHEN event_type = 'ping' OR k % 4 = 0 THEN 0 ELSE k END AS BIGINT) AS installation_id,
    CASE WHEN event_class = 'comment' THEN body END AS comment_body, ts
  FROM wh_exp""")


@query("parse_events", oracle="SELECT delivery_id, event_type, action, event_class FROM wh_exp")
def q_parse_events(spark, d):
    return EV.parse_events(X.webhook_events(spark, d)).select("delivery_id", "event_type", "action", "event_class")


@query("event_identifiers", oracle="""
SELECT delivery_id, event_class, owner, repo, pr_number, sender, installation_id, comment_body FROM wh_ids""")
def q_event_identifiers(spark, d):
    return EV.event_identifiers(EV.parse_events(X.webhook_events(spark, d))).select(
        "delivery_id", "event_class", "owner", "repo", "pr_number", "sender", "installation_id", "comment_body")


@query("route_events", oracle="""
SELECT delivery_id, CASE WHEN event_class IN ('pr_open', 'pr_sync') THEN 'review' WHEN event_class = 'comment' THEN 'command'
       ELSE 'ignored' END AS route,
  CASE WHEN event_class IN ('pr_open', 'pr_sync') THEN 'Review triggered' WHEN event_class = 'comment' THEN 'Command processed'
       ELSE 'Event ignored' END AS response FROM wh_exp""")
def q_route_events(spark, d):
    return EV.route_events(EV.parse_events(X.webhook_events(spark, d))).select("delivery_id", "route", "response")


# Expected commands per body index (k % 8): matched, categories.
_CMD_EXP = """CASE k % 8 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN false
  WHEN 5 THEN false WHEN 6 THEN true ELSE true END"""
_CAT_EXP = """CASE k % 8 WHEN 1 THEN ['security'] WHEN 2 THEN ['security', 'logic'] WHEN 7 THEN ['style'] END"""


@query("parse_commands", oracle=f"""
SELECT delivery_id, {_CMD_EXP} AS is_command, {_CAT_EXP} AS categories FROM wh_exp WHERE event_class = 'comment'""")
def q_parse_commands(spark, d):
    ev = EV.event_identifiers(EV.parse_events(X.webhook_events(spark, d))).filter(F.col("event_class") == "comment")
    return EV.parse_commands(ev).select("delivery_id", "is_command", "categories")


@query("authorize_commands", oracle=f"""
SELECT i.delivery_id, i.sender,
  EXISTS (SELECT 1 FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
          WHERE c.c_custkey % 2 = 0 AND lower(r.r_name) = i.owner AND lower(n.n_name) = i.repo
            AND 'user' || c.c_custkey::VARCHAR = i.sender) AS allowed
FROM wh_ids i JOIN wh_exp e ON e.delivery_id = i.delivery_id WHERE i.event_class = 'comment' AND {_CMD_EXP.replace('k %', 'e.k %')}""")
def q_authorize_commands(spark, d):
    ev = EV.event_identifiers(EV.parse_events(X.webhook_events(spark, d))).filter(F.col("event_class") == "comment")
    cmds = EV.parse_commands(ev).filter("is_command")
    return EV.authorize_commands(cmds, X.collaborators(spark, d)).select("delivery_id", "sender", "allowed")


_GATE_SQL = """
gate AS (
  SELECT i.*, coalesce((SELECT c.auto_review FROM repositories g JOIN repo_configs c ON c.repository_id = g.id
                        WHERE g.full_name = i.owner || '/' || i.repo), true) AS auto_review
  FROM wh_ids i WHERE i.event_class IN ('pr_open', 'pr_sync'))"""


@query("auto_review_gate", oracle="WITH " + _GATE_SQL + " SELECT delivery_id, owner, repo, auto_review FROM gate")
def q_auto_review_gate(spark, d):
    ev = EV.route_events(EV.event_identifiers(EV.parse_events(X.webhook_events(spark, d))))
    g = EV.auto_review_gate(ev.filter(F.col("route") == "review"), X.repositories(spark, d), X.repo_configs(spark, d))
    return g.select("delivery_id", "owner", "repo", "auto_review")


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:10]}"


@query("review_requests_stream", oracle="WITH " + _GATE_SQL + """
SELECT delivery_id, owner, repo, pr_number, installation_id, sender AS triggered_by, 'pending' AS status
FROM gate WHERE auto_review""")
def q_review_requests_stream(spark, d):
    """Deliveries written as files, read back with readStream, processed by
    one availableNow streaming query into a parquet sink."""
    base = _scratch(spark, "review_requests")
    X.webhook_events(spark, d).repartition(4).write.parquet(f"{base}/in")
    stream = RD.load_webhook_stream(spark, f"{base}/in", max_files=2)
    S.review_requests_stream(stream, X.repositories(spark, d), X.repo_configs(spark, d), f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out").select(
        "delivery_id", "owner", "repo", "pr_number", "installation_id", "triggered_by", "status")


@query("review_lifecycle", oracle="""
SELECT o_orderkey AS review_id,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status,
       CASE WHEN o_orderstatus = 'P' THEN 'analysis failed' END AS error_message,
       CASE WHEN o_orderstatus = 'O' THEN o_orderdate ELSE o_orderdate + INTERVAL 1 DAY END AS updated_at
FROM orders""")
def q_review_lifecycle(spark, d):
    return EV.review_lifecycle(X.status_events(spark, d))


@query("review_lifecycle_stream", oracle="""
SELECT o_orderkey AS review_id,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status,
       CASE WHEN o_orderstatus = 'P' THEN 'analysis failed' END AS error_message,
       CASE WHEN o_orderstatus = 'O' THEN o_orderdate ELSE o_orderdate + INTERVAL 1 DAY END AS updated_at
FROM orders""")
def q_review_lifecycle_stream(spark, d):
    """Status changes streamed in several files, so a review's changes come in any
    order over micro-batches; the keyed table holds the latest."""
    base = _scratch(spark, "lifecycle")
    X.status_events(spark, d).repartition(3, "seq").write.parquet(f"{base}/in")
    stream = (spark.readStream.schema("review_id bigint, status string, error_message string, ts timestamp_ntz, seq int")
              .option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
    S.review_lifecycle_stream(stream, f"{base}/current", f"{base}/ckpt")
    return S.read_lifecycle(spark, f"{base}/current").select("review_id", "status", "error_message", "updated_at")


@query("issue_trend_stream", oracle="""
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS day, count(*) AS issue_count
FROM review_issues GROUP BY 1""")
def q_issue_trend_stream(spark, d):
    """Issues streamed through daily windows in three or more micro-batches, out of
    order: rows are dealt by id, so every batch holds all days. The watermark is
    wider than the data, so no row is behind it and the result equals the batch
    count."""
    base = _scratch(spark, "trend")
    X.review_issues(spark, d).select("id", "created_at").repartition(3, "id").write.parquet(f"{base}/in")
    stream = (spark.readStream.schema("id bigint, created_at timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
    S.issue_trend_stream(stream, f"{base}/counts", f"{base}/ckpt", watermark="36500 days")
    return S.read_issue_trend(spark, f"{base}/counts")


# ------------------------------------------------------------- maintenance

@query("upsert_by_key", oracle="""
WITH latest AS (SELECT github_user_id, arg_max(login, seq) AS login, arg_max(avatar_url, seq) AS avatar_url,
                       arg_max(last_login_at, seq) AS last_login_at FROM login_feed GROUP BY github_user_id)
SELECT coalesce(u.github_user_id, l.github_user_id) AS github_user_id,
       CASE WHEN l.github_user_id IS NOT NULL THEN l.login ELSE u.login END AS login,
       CASE WHEN l.github_user_id IS NOT NULL THEN l.avatar_url ELSE u.avatar_url END AS avatar_url,
       CASE WHEN u.github_user_id IS NULL THEN false ELSE u.is_admin END AS is_admin,
       CASE WHEN l.github_user_id IS NOT NULL THEN l.last_login_at ELSE u.last_login_at END AS last_login_at,
       CASE WHEN u.github_user_id IS NULL THEN l.last_login_at ELSE u.created_at END AS created_at
FROM users u FULL OUTER JOIN latest l ON u.github_user_id = l.github_user_id""")
def q_upsert_by_key(spark, d):
    """Users kept as a bucketed table, with the login feed upserted into it."""
    users = BucketedTable(X.users(spark, d), ["github_user_id"])
    users.upsert(X.login_feed(spark, d), ["login", "avatar_url", "last_login_at"], "seq",
                 defaults={"is_admin": F.lit(DEFAULTS["users"]["is_admin"]), "created_at": F.col("_b.last_login_at")})
    return users.read()


@query("cascade_delete", oracle="""
SELECT 'pull_requests' AS table_name, id, repository_id AS parent_id FROM pull_requests WHERE id % 3 <> 0
UNION ALL SELECT 'review_records', id, pull_request_id FROM review_records WHERE pull_request_id % 3 <> 0
UNION ALL SELECT 'review_issues', i.id, i.review_record_id FROM review_issues i JOIN review_records r ON i.review_record_id = r.id
  WHERE r.pull_request_id % 3 <> 0""")
def q_cascade_delete(spark, d):
    """Delete every third pull request (by id) and everything below it: the rows left."""
    t = {"pull_requests": X.pull_requests(spark, d), "review_records": X.review_records(spark, d),
         "review_issues": X.review_issues(spark, d)}
    gone = t["pull_requests"].filter(F.col("id") % 3 == 0).select("id")
    out = M.cascade_delete(t, gone)
    parents = {"pull_requests": "repository_id", "review_records": "pull_request_id", "review_issues": "review_record_id"}
    return reduce(DataFrame.unionByName, [
        out[k].select(F.lit(k).alias("table_name"), "id", F.col(p).alias("parent_id")) for k, p in parents.items()])


@query("constraint_report", oracle="""
SELECT 'foreign_key' AS "check", 'review_records' AS table_name, 'pull_request_id' AS "column",
       r.pull_request_id::VARCHAR AS key, count(*) AS n
FROM review_records r WHERE r.pull_request_id % 3 = 0 GROUP BY r.pull_request_id
UNION ALL
SELECT 'not_null', 'pull_requests', 'title', NULL, count(*) FROM pull_requests WHERE id % 3 <> 0 AND id % 7 = 0
UNION ALL
SELECT 'unique', 'repositories', 'github_repo_id', CAST(n_nationkey + 1000 AS VARCHAR), 2
FROM nation WHERE n_nationkey < 5""")
def q_constraint_report(spark, d):
    """Pull requests deleted without cascading (every third id), titles
    blanked on every seventh, and five repositories listed twice."""
    t = X.review_tables(spark, d)
    prs = t["pull_requests"].filter(F.col("id") % 3 != 0)
    t["pull_requests"] = prs.withColumn("title", F.when(F.col("id") % 7 != 0, F.col("title")))
    t["repositories"] = t["repositories"].unionByName(t["repositories"].filter(F.col("id") < 5))
    return M.constraint_report(t)


@query("normalize_configs", oracle="""
SELECT CAST(n_nationkey AS BIGINT) AS repository_id, n_nationkey % 2 = 0 AS auto_review,
  CASE n_nationkey % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 WHEN 2 THEN 0.6 ELSE 0.7 END::DOUBLE AS confidence_threshold,
  CASE WHEN n_nationkey % 3 = 0 THEN []::VARCHAR[] ELSE ['security', 'style'] END AS enabled_categories,
  CASE WHEN n_nationkey % 5 = 0 THEN []::VARCHAR[]
       ELSE ['rule-' || (n_nationkey % 3)::VARCHAR, 'python-exec-eval'] END AS ignore_rule_ids
FROM nation""")
def q_normalize_configs(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    key = F.col("n_nationkey")
    settings = n.select(
        key.cast("long").alias("repository_id"),
        F.when(key % 2 == 0, F.lit("1")).otherwise(F.lit("0")).alias("auto_review"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high"), F.lit("extreme")), (key % 4 + 1).cast("int"))
         .alias("sensitivity"),
        F.when(key % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("security"), F.lit("style")))
         .alias("enabled_categories"),
        F.when(key % 5 == 0, F.lit("\n  \n")).otherwise(
            F.concat(F.lit("  rule-"), (key % 3).cast("string"), F.lit("\n\npython-exec-eval \n"))).alias("ignore_rule_ids"))
    return M.normalize_configs(settings)


@query("load_patches", oracle="""
SELECT review_id, file_seq, filename, patch, CASE WHEN patch IS NULL THEN 'renamed' ELSE 'modified' END AS status,
       CASE WHEN patch IS NULL THEN 'old/' || filename END AS previous_filename,
       CAST(coalesce(length(patch), 0) AS INT) AS additions, 0 AS deletions, CAST(coalesce(length(patch), 0) AS INT) AS changes
FROM pr_files""")
def q_load_patches(spark, d):
    base = _scratch(spark, "patches")
    gone = F.col("patch").isNull()
    size = F.coalesce(F.length("patch"), F.lit(0))
    (X.pr_files(spark, d).select("review_id", "file_seq", "filename", "patch", F.when(gone, "renamed").otherwise("modified").alias("status"),
                                 F.when(gone, F.concat(F.lit("old/"), "filename")).alias("previous_filename"),
                                 size.alias("additions"), F.lit(0).alias("deletions"), size.alias("changes")).write.json(base))
    return RD.load_patches(spark, base).select("review_id", "file_seq", "filename", "patch", "status", "previous_filename",
                                               "additions", "deletions", "changes")


@query("load_sources", oracle="""
SELECT page_id, CAST(strlen(html) + 1 AS BIGINT) AS length, html || chr(10) AS content FROM pages""")
def q_load_sources(spark, d):
    """Pages written one file each (the source reads whole files, so a file per
    page is what it is given here), read back with the binary-file source."""
    base = _scratch(spark, "sources")
    spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html").write.partitionBy("page_id").text(base)
    src = RD.load_sources(spark, base)
    return src.select(F.regexp_extract("path", r"page_id=(\d+)", 1).cast("long").alias("page_id"), "length", "content")


_TABLE_ROWS = """
SELECT 'repositories' AS table_name, id::VARCHAR AS key, concat_ws('|', github_repo_id, full_name, owner, default_branch, coalesce(language, '-')) AS content FROM repositories
UNION ALL SELECT 'pull_requests', id::VARCHAR, concat_ws('|', repository_id, pr_number, title, author) FROM pull_requests
UNION ALL SELECT 'review_records', id::VARCHAR, concat_ws('|', pull_request_id, status, critical_count, warning_count, suggestion_count, total_issues) FROM review_records
UNION ALL SELECT 'review_issues', id::VARCHAR, concat_ws('|', review_record_id, file_path, line_start, line_end, severity, category, rule_id, title, source) FROM review_issues
UNION ALL SELECT 'repo_configs', repository_id::VARCHAR, concat_ws('|', auto_review, review_language, max_files_per_review) FROM repo_configs
UNION ALL SELECT 'users', github_user_id::VARCHAR, concat_ws('|', login, avatar_url, is_admin) FROM users"""
_TABLE_COLS = {
    "repositories": ("id", ["github_repo_id", "full_name", "owner", "default_branch", "language"]),
    "pull_requests": ("id", ["repository_id", "pr_number", "title", "author"]),
    "review_records": ("id", ["pull_request_id", "status", "critical_count", "warning_count", "suggestion_count", "total_issues"]),
    "review_issues": ("id", ["review_record_id", "file_path", "line_start", "line_end", "severity", "category", "rule_id", "title", "source"]),
    "repo_configs": ("repository_id", ["auto_review", "review_language", "max_files_per_review"]),
    "users": ("github_user_id", ["login", "avatar_url", "is_admin"])}


@query("load_tables", oracle=_TABLE_ROWS)
def q_load_tables(spark, d):
    """The six tables written with nulls where defaults apply, then scanned with
    fixed schemas and defaults filled: every row of every table, as one text."""
    base = _scratch(spark, "tables")
    for name, df in X.review_tables(spark, d).items():
        df.write.parquet(f"{base}/{name}.parquet")
    parts = []
    for name, df in load_tables(spark, base).items():
        key, cols = _TABLE_COLS[name]
        text = [F.coalesce(F.col(c), F.lit("-")) if c == "language" else F.col(c).cast("string") for c in cols]
        parts.append(df.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("key"), F.concat_ws("|", *text).alias("content")))
    return reduce(DataFrame.unionByName, parts)


@query("write_review", oracle="""
SELECT 'review' AS part, id, id AS review_id, status AS content FROM review_records
UNION ALL SELECT 'issue', id, review_record_id, concat_ws('|', file_path, line_start, line_end, severity, title) FROM review_issues""")
def q_write_review(spark, d):
    """Reviews and the findings linked to them, saved in two batches, the first of
    which is written again as a retried job would; then read back."""
    base = _scratch(spark, "reviews_out")
    reviews, issues = X.review_records(spark, d), X.review_issues(spark, d)
    for batch, part in ((0, 0), (1, 1), (0, 0)):
        RD.save_reviews(reviews.filter(F.col("id") % 2 == part), issues, base, batch)
    r, i = RD.load_reviews(spark, base)
    return r.select(F.lit("review").alias("part"), "id", F.col("id").alias("review_id"), F.col("status").alias("content")).unionByName(
        i.select(F.lit("issue").alias("part"), "id", F.col("review_record_id").alias("review_id"),
                 F.concat_ws("|", "file_path", F.col("line_start").cast("string"), F.col("line_end").cast("string"), "severity", "title").alias("content")))


@query("load_webhook_stream", oracle="SELECT delivery_id, event_type, ts FROM wh_exp")
def q_load_webhook_stream(spark, d):
    """Deliveries as files, read as a stream (explicit schema, bounded files
    per trigger) and appended unchanged to a parquet sink."""
    base = _scratch(spark, "deliveries")
    X.webhook_events(spark, d).repartition(4).write.parquet(f"{base}/in")
    stream = RD.load_webhook_stream(spark, f"{base}/in", max_files=2)
    S.run_available_now(stream.writeStream.format("parquet").option("path", f"{base}/out")
                        .option("checkpointLocation", f"{base}/ckpt"), "load_webhook_stream")
    return spark.read.parquet(f"{base}/out").select("delivery_id", "event_type", "ts")
