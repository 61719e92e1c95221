"""Webhook event operators (§2.9), written once for batch and streaming:
every function is a stateless projection/join, so it applies unchanged to a
`readStream` DataFrame (stream-static joins for configs and collaborators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crx.functions.text import PY_WS_CLASS

# Command grammar and the focus categories it accepts.
COMMAND_RE = r"(?iU)^/review(?:\s+focus:([a-z_,]+))?\s*$"
COMMAND_CATEGORIES = ["security", "logic", "performance", "style"]
# Router responses.
ROUTE_MESSAGES = {"review": "Review triggered", "command": "Command processed", "ignored": "Event ignored"}


def _j(path: str, typ: str = "string") -> Column:
    return F.try_variant_get(F.col("payload_v"), path, typ)


def parse_events(deliveries: DataFrame) -> DataFrame:
    """Adds payload_v (variant), action and event_class:
    pull_request opened/reopened -> pr_open, synchronize -> pr_sync, other
    actions -> unknown; issue_comment (any action) -> comment; installation and
    installation_repositories -> installation; ping and the rest -> unknown."""
    d = deliveries.withColumn("payload_v", F.try_parse_json(F.col("payload")))
    action = F.coalesce(_j("$.action"), F.lit(""))
    et = F.col("event_type")
    cls = (F.when((et == "pull_request") & action.isin("opened", "reopened"), "pr_open")
            .when((et == "pull_request") & (action == "synchronize"), "pr_sync")
            .when(et == "issue_comment", "comment")
            .when(et.isin("installation", "installation_repositories"), "installation")
            .otherwise("unknown"))
    return d.withColumn("action", action).withColumn("event_class", cls)


def event_identifiers(events: DataFrame) -> DataFrame:
    """owner, repo, pr_number, sender, installation_id, comment body/id.

    PR number: pull_request.number, falling back (also on 0) to number. For
    comments: the last path segment of issue.pull_request.url, 0 when missing
    or not numeric. Unknown and installation events carry "", "", 0."""
    c = F.col("event_class")
    owner = F.coalesce(_j("$.repository.owner.login"), F.lit(""))
    repo = F.coalesce(_j("$.repository.name"), F.lit(""))
    pr_num = F.coalesce(F.nullif(F.coalesce(_j("$.pull_request.number", "bigint"), F.lit(0)), F.lit(0)),
                        _j("$.number", "bigint"), F.lit(0))
    url = F.regexp_replace(F.coalesce(_j("$.issue.pull_request.url"), F.lit("")), "/+$", "")
    seg = F.element_at(F.split(url, "/"), -1)
    seg_num = F.when(seg.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(seg).cast("bigint"))
    comment_pr = F.when(url == "", F.lit(0)).otherwise(F.coalesce(seg_num, F.lit(0)))
    has_ids = c.isin("pr_open", "pr_sync", "comment")
    sender = F.when(c == "unknown", F.lit("")).otherwise(F.coalesce(_j("$.sender.login"), F.lit("")))
    return events.select(
        "*",
        F.when(has_ids, owner).otherwise(F.lit("")).alias("owner"),
        F.when(has_ids, repo).otherwise(F.lit("")).alias("repo"),
        F.when(c.isin("pr_open", "pr_sync"), pr_num).when(c == "comment", comment_pr).otherwise(F.lit(0))
         .cast("bigint").alias("pr_number"),
        sender.alias("sender"),
        F.coalesce(_j("$.installation.id", "bigint"), F.lit(0)).alias("installation_id"),
        F.when(c == "comment", F.coalesce(_j("$.comment.body"), F.lit(""))).alias("comment_body"),
        F.when(c == "comment", F.coalesce(_j("$.comment.id", "bigint"), F.lit(0))).alias("comment_id"))


def route_events(events: DataFrame) -> DataFrame:
    c = F.col("event_class")
    route = F.when(c.isin("pr_open", "pr_sync"), "review").when(c == "comment", "command").otherwise("ignored")
    msg = F.coalesce(*[F.when(route == k, F.lit(v)) for k, v in ROUTE_MESSAGES.items()])
    return events.withColumn("route", route).withColumn("response", msg)


def parse_commands(comments: DataFrame, body_col: str = "comment_body") -> DataFrame:
    """Adds is_command and categories: the trimmed body must match
    `/review [focus:a,b]`; categories keep exact lowercase names among the
    four; none valid (or no focus) -> null meaning all."""
    body = F.regexp_replace(F.coalesce(F.col(body_col), F.lit("")), f"^{PY_WS_CLASS}+|{PY_WS_CLASS}+$", "")
    is_cmd = body.rlike(COMMAND_RE)
    focus = F.regexp_extract(body, COMMAND_RE, 1)
    cats = F.filter(F.transform(F.split(focus, ","), lambda x: F.trim(x)),
                    lambda x: x.isin(COMMAND_CATEGORIES))
    return comments.withColumn("is_command", is_cmd).withColumn(
        "categories", F.when(is_cmd & (focus != "") & (F.size(cats) > 0), cats))


def authorize_commands(commands: DataFrame, collaborators: DataFrame | None = None) -> DataFrame:
    """Adds allowed: the sender is a collaborator of owner/repo; with no
    collaborator table everyone may run. Denied commands are still handled."""
    if collaborators is None:
        return commands.withColumn("allowed", F.lit(True))
    col = collaborators.select("owner", "repo", F.col("login").alias("sender")).distinct() \
        .withColumn("_collab", F.lit(True))
    return (commands.join(col, ["owner", "repo", "sender"], "left")
            .withColumn("allowed", F.coalesce(F.col("_collab"), F.lit(False))).drop("_collab"))


def auto_review_gate(events: DataFrame, repos: DataFrame, configs: DataFrame) -> DataFrame:
    """Adds auto_review: the config of repository owner/repo (by full name);
    a missing repository or config means enabled."""
    cfg = (repos.select(F.col("id").alias("repository_id"), F.col("full_name"))
           .join(configs.select("repository_id", "auto_review"), "repository_id")
           .select("full_name", F.col("auto_review").alias("_ar")))
    e = events.withColumn("full_name", F.concat(F.col("owner"), F.lit("/"), F.col("repo")))
    return (e.join(cfg, "full_name", "left")
            .withColumn("auto_review", F.coalesce(F.col("_ar"), F.lit(True))).drop("_ar"))


def review_requests(deliveries: DataFrame, repos: DataFrame, configs: DataFrame) -> DataFrame:
    """parse -> identify -> route -> gate: pending review requests for PR
    events whose repository has auto review on (triggered_by = sender)."""
    ev = route_events(event_identifiers(parse_events(deliveries)))
    gated = auto_review_gate(ev.filter(F.col("route") == "review"), repos, configs)
    return gated.filter("auto_review").select(
        "delivery_id", "owner", "repo", "pr_number", "installation_id", F.col("sender").alias("triggered_by"),
        F.lit("pending").alias("status"), *([c for c in ["ts"] if c in deliveries.columns]))


def review_lifecycle(status_events: DataFrame) -> DataFrame:
    """Current state per review: the status of its latest event (ties broken by
    the event sequence)."""
    return status_events.groupBy("review_id").agg(
        F.max_by(F.struct("status", "error_message"), F.struct("ts", "seq")).alias("s"),
        F.max("ts").alias("updated_at")).select("review_id", "s.status", "s.error_message", "updated_at")
