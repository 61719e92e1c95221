"""Review-domain tables derived from the driver's TPC-H-style tables.

Every derivation is a plain projection / join of the given tables so the work
grows with them. The DuckDB twin of each derivation lives in `fixture_sql.py`
and is used only by the oracle queries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crx.sources.tables import conform, read_driver_table

def _epoch() -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")

# The closed vocabularies of the review domain.
CATEGORIES = ["security", "logic", "performance", "best_practice", "style"]
FILE_PREFIXES = ["src/", "tests/test_", "vendor/", "app/"]
FILE_EXTS = [".py", ".java", ".js"]


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_driver_table(spark, sf_dir, name)


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation")
    r = _t(spark, sf_dir, "region")
    nat = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").cast("long").alias("id"),
        (F.col("n_nationkey") + 1000).cast("long").alias("github_repo_id"),
        F.lower("n_name").alias("name"),
        F.concat(F.lower("r_name"), F.lit("/"), F.lower("n_name")).alias("full_name"),
        F.lower("r_name").alias("owner"),
        F.concat(F.lit("/repos/"), F.lower("r_name"), F.lit("/"), F.lower("n_name")).alias("html_url"),
        F.lit(None).cast("string").alias("default_branch"),
        F.when(F.col("n_nationkey") % 3 == 0, "Python")
         .when(F.col("n_nationkey") % 3 == 1, "Java").alias("language"),
        _epoch().alias("created_at"), _epoch().alias("updated_at"))
    # One repository per region that never gets a pull request.
    extra = r.select(
        (F.col("r_regionkey") + 100).cast("long").alias("id"),
        (F.col("r_regionkey") + 2000).cast("long").alias("github_repo_id"),
        F.lit("archive").alias("name"),
        F.concat(F.lower("r_name"), F.lit("/archive")).alias("full_name"),
        F.lower("r_name").alias("owner"),
        F.concat(F.lit("/repos/"), F.lower("r_name"), F.lit("/archive")).alias("html_url"),
        F.lit("trunk").alias("default_branch"),
        F.lit(None).cast("string").alias("language"),
        _epoch().alias("created_at"), _epoch().alias("updated_at"))
    return conform("repositories", nat.unionByName(extra))


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    c = _t(spark, sf_dir, "customer")
    df = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"),
        F.col("c_nationkey").cast("long").alias("repository_id"),
        (F.col("o_orderkey") + 1).alias("pr_number"),
        F.concat(F.lit("Change "), F.col("o_orderkey").cast("string"), F.lit(": "),
                 F.col("o_orderpriority"), F.lit(" update for "), F.col("c_name"),
                 F.lit(" in "), F.col("c_mktsegment")).alias("title"),
        F.when(F.col("o_orderstatus") != "P",
               F.concat(F.lit("Order for customer "), F.col("o_custkey").cast("string"))).alias("body"),
        F.concat(F.lit("user"), F.col("o_custkey").cast("string")).alias("author"),
        F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("head_sha"),
        F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("base_sha"),
        F.concat(F.lit("feature/"), F.col("o_orderkey").cast("string")).alias("head_branch"),
        F.lit("main").alias("base_branch"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))
    return conform("pull_requests", df)


def review_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per order; even pull requests get up to two, odd ones none."""
    o = _t(spark, sf_dir, "orders")
    status = (F.when(F.col("o_orderstatus") == "F", "completed")
               .when(F.col("o_orderstatus") == "O", "pending")
               .when(F.col("o_orderstatus") == "P", "failed"))
    df = o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderkey") - F.col("o_orderkey") % 2).alias("pull_request_id"),
        status.alias("status"),
        F.when(F.col("o_orderstatus") != "O",
               F.concat(F.lit("Reviewed change "), F.col("o_orderkey").cast("string"))).alias("summary"),
        F.concat(F.lit("user"), F.col("o_custkey").cast("string")).alias("triggered_by"),
        F.when(F.col("o_orderstatus") == "P", F.lit("analysis failed")).alias("error_message"),
        F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") == "F",
               F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("completed_at"),
        F.col("o_orderdate").alias("created_at"))
    return conform("review_records", df)


def lineitem_rn(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """lineitem with `rn`, a row number inside each order (orders are small); dealt by
    order over `parts` parts, if given."""
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_shipdate")
    li = _t(spark, sf_dir, "lineitem")
    return (li.repartition(parts, "l_orderkey") if parts else li).withColumn("rn", F.row_number().over(w))


def _finding_cols(li: DataFrame) -> dict[str, Column]:
    k = F.round(F.col("l_discount") * 100).cast("int")
    rule = F.concat(F.lit("rule-"), (F.col("l_suppkey") % 3).cast("string"))
    sev = (F.when(F.col("l_partkey") % 17 == 0, "info")
            .when(F.col("l_returnflag") == "R", "critical")
            .when(F.col("l_returnflag") == "A", "warning")
            .otherwise("suggestion"))
    line_start = F.col("l_quantity").cast("int")
    return {
        "rule_id": rule,
        "severity": sev,
        "category": _pick(CATEGORIES, F.col("l_partkey") % 5),
        "line_start": line_start,
        "line_end": line_start + F.col("l_linenumber"),
        "title": F.concat(F.lit("Issue "), rule, F.lit(" at line "), line_start.cast("string")),
        "description": F.concat(F.lit("Item "), F.col("l_linenumber").cast("string"),
                                F.lit(" of change "), F.col("l_orderkey").cast("string")),
        "suggestion": F.when(F.col("l_linenumber") % 2 == 1,
                             F.concat(F.lit("fix "), F.col("l_partkey").cast("string"))),
        "confidence": (F.lit(50) + F.lit(5) * k).cast("double") / 100,
        "source": F.when(F.col("l_linestatus") == "O", "ai").otherwise("ast"),
    }


def review_issues(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Issues of reviews; those of a review stand in one of `parts` parts, if given."""
    li = lineitem_rn(spark, sf_dir, parts)
    c = _finding_cols(li)
    path = F.concat(_pick(FILE_PREFIXES, F.col("l_suppkey") % 4), F.lit("mod"),
                    (F.col("l_partkey") % 5).cast("string"),
                    _pick(FILE_EXTS, F.col("l_partkey") % 3))
    df = li.select(
        (F.col("l_orderkey") * 100 + F.col("rn")).alias("id"),
        F.col("l_orderkey").alias("review_record_id"),
        path.alias("file_path"),
        *[v.alias(k) for k, v in c.items()],
        F.col("l_shipdate").alias("created_at"))
    return conform("review_issues", df)


def raw_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense overlapping findings: 50 changes per review, 3 files, 3 rules."""
    li = lineitem_rn(spark, sf_dir)
    c = _finding_cols(li)
    review_id = F.floor(F.col("l_orderkey") / 50).cast("long")
    return li.select(
        review_id.alias("review_id"),
        (review_id % 25).alias("repository_id"),
        (F.col("l_orderkey") * 100 + F.col("rn")).alias("seq"),
        F.concat(F.lit("src/mod"), (F.col("l_partkey") % 3).cast("string"), F.lit(".py")).alias("file_path"),
        *[v.alias(k) for k, v in c.items()])


def repo_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configs for three nations in four; null and empty lists both occur."""
    n = _t(spark, sf_dir, "nation").filter(F.col("n_nationkey") % 4 != 3)
    key = F.col("n_nationkey")
    empty = F.array().cast("array<string>")

    def arr(*vs):
        return F.array(*[F.lit(v) for v in vs])

    cats = (F.when(key % 5 == 1, empty).when(key % 5 == 2, arr("security", "logic"))
             .when(key % 5 == 3, arr(*CATEGORIES))
             .when(key % 5 == 4, arr("style", "logic", "best_practice")))
    pats = F.when(key % 3 == 1, arr("vendor/")).when(key % 3 == 2, arr("tests/", "mod1"))
    rules = F.when(key % 4 == 1, empty).when(key % 4 == 2, arr("rule-1"))
    df = n.select(
        key.cast("long").alias("repository_id"),
        (key % 4 != 2).alias("auto_review"),
        cats.alias("enabled_categories"), pats.alias("ignore_patterns"),
        rules.alias("ignore_rule_ids"),
        _epoch().alias("created_at"), _epoch().alias("updated_at"))
    return conform("repo_configs", df)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").filter(F.col("c_custkey") % 2 == 0)
    df = c.select(
        F.col("c_custkey").alias("github_user_id"),
        F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("login"),
        F.lit(None).cast("string").alias("avatar_url"),
        (F.col("c_custkey") % 100 == 0).alias("is_admin"),
        F.lit(None).cast("timestamp_ntz").alias("last_login_at"),
        _epoch().alias("created_at"))
    return conform("users", df)


def login_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logins = signup events (repeats per user; later event_id wins)."""
    e = _t(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    return e.select(
        F.col("user_id").alias("github_user_id"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("login"),
        F.concat(F.lit("/avatars/"), F.col("user_id").cast("string"), F.lit("/"),
                 F.col("event_id").cast("string")).alias("avatar_url"),
        F.col("ts").alias("last_login_at"),
        F.col("event_id").alias("seq"))


def review_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "repositories": repositories(spark, sf_dir),
        "pull_requests": pull_requests(spark, sf_dir),
        "review_records": review_records(spark, sf_dir),
        "review_issues": review_issues(spark, sf_dir),
        "repo_configs": repo_configs(spark, sf_dir),
        "users": users(spark, sf_dir),
    }


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def pr_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files with unified-diff patches, one hunk per line item.

    Per order: files src/f0.py / src/f1.py by l_suppkey % 2; hunk rn sits at
    old/new line 10*rn with one context line, one removed line (written as
    '--- old r' when l_partkey % 7 == 0, which the parser drops) and
    l_quantity % 3 + 1 added lines; headers omit counts when l_partkey % 4 == 0;
    '\\ No newline at end of file' follows when l_partkey % 5 == 0. The second
    file of every fifth order has a null patch (binary)."""
    li = lineitem_rn(spark, sf_dir)
    r = F.col("rn").cast("string")
    a = F.col("l_quantity").cast("int") % 3 + 1
    nocount = F.col("l_partkey") % 4 == 0
    start = (F.col("rn") * 10).cast("string")
    header = F.concat(F.lit("@@ -"), start, F.when(nocount, "").otherwise(",2"), F.lit(" +"), start,
                      F.when(nocount, "").otherwise(F.concat(F.lit(","), (a + 1).cast("string"))),
                      F.lit(" @@ fn_"), r)
    removed = F.when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("--- old "), r)).otherwise(F.concat(F.lit("-old "), r))
    adds = F.array_join(F.transform(F.sequence(F.lit(1), a),
                                    lambda j: F.concat(F.lit("+new "), r, F.lit(" "), j.cast("string"))), "\n")
    nonl = F.when(F.col("l_partkey") % 5 == 0, "\n\\ No newline at end of file").otherwise("")
    hunk = F.concat(header, F.lit("\n ctx "), r, F.lit("\n"), removed, F.lit("\n"), adds, nonl)
    h = li.select(F.col("l_orderkey").alias("review_id"), (F.col("l_suppkey") % 2).alias("file_seq"),
                  "rn", a.alias("a"), hunk.alias("hunk"))
    g = (h.groupBy("review_id", "file_seq")
         .agg(F.array_join(F.array_sort(F.collect_list(F.struct("rn", "hunk")))["hunk"], "\n").alias("patch"),
              F.sum("a").cast("int").alias("additions"), F.count(F.lit(1)).cast("int").alias("deletions")))
    return g.select(
        "review_id", "file_seq",
        F.concat(F.lit("src/f"), F.col("file_seq").cast("string"), F.lit(".py")).alias("filename"),
        F.lit("modified").alias("status"),
        F.when((F.col("file_seq") == 1) & (F.col("review_id") % 5 == 0), F.lit(None)).otherwise(F.col("patch")).alias("patch"),
        F.lit(None).cast("string").alias("previous_filename"),
        "additions", "deletions", (F.col("additions") + F.col("deletions")).alias("changes"))


def anchor_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings aimed at the diffs of `pr_files`: some hit added or context
    lines, some fall between hunks, some name the other (possibly binary) file."""
    li = lineitem_rn(spark, sf_dir)
    ls = (F.col("l_partkey") % 13 + 1) * 10 + F.col("l_suppkey") % 3 - 1
    return li.select(
        F.col("l_orderkey").alias("review_id"),
        (F.col("l_orderkey") * 100 + F.col("rn")).alias("seq"),
        F.concat(F.lit("src/f"), ((F.col("l_suppkey") + F.col("l_partkey")) % 2).cast("string"),
                 F.lit(".py")).alias("file_path"),
        ls.cast("int").alias("line_start"),
        (ls + F.col("l_linenumber") % 3).cast("int").alias("line_end"),
        F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "warning")
         .when(F.col("l_partkey") % 17 == 0, "info").otherwise("suggestion").alias("severity"),
        F.concat(F.lit("Check "), F.col("l_partkey").cast("string")).alias("title"),
        F.concat(F.lit("Line item "), F.col("rn").cast("string")).alias("description"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("x = "), F.col("rn").cast("string")))
         .otherwise(F.lit("")).alias("suggestion"))


def _wrap_json(js: Column, v: Column, o: Column) -> Column:
    """Response text around a JSON document, by variant v (0..5): fenced, bare,
    prose around, invalid, empty object, invalid fence before bare JSON."""
    return (F.when(v == 0, F.concat(F.lit("Analysis:\n```json\n"), js, F.lit("\n```\nDone.")))
             .when(v == 1, js)
             .when(v == 2, F.concat(F.lit("Here you go: "), js, F.lit(" Thanks!")))
             .when(v == 3, F.concat(F.lit("Sorry, no analysis for change "), o.cast("string")))
             .when(v == 4, F.lit("{}"))
             .otherwise(F.concat(F.lit("```\nnot json\n```\n"), js)))


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase-1 and per-direction responses per order, built from its line
    items (fields omitted by seed rules so every default is exercised)."""
    li = lineitem_rn(spark, sf_dir)
    k = F.round(F.col("l_discount") * 100).cast("int")
    q = F.col("l_quantity").cast("int")
    ln = F.col("l_linenumber")
    item = F.struct(
        F.when(F.col("l_partkey") % 11 != 0, F.concat(F.lit("AI-"), (F.col("l_partkey") % 9).cast("string"))).alias("rule_id"),
        F.when(ln != 3, F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "warning")
               .otherwise("suggestion")).alias("severity"),
        _pick(CATEGORIES, F.col("l_partkey") % 5).alias("category"),
        F.concat(F.lit("src/f"), (F.col("l_suppkey") % 2).cast("string"), F.lit(".py")).alias("file_path"),
        q.alias("line_start"),
        F.when(ln != 4, q + ln).alias("line_end"),
        F.concat(F.lit("Finding "), F.col("rn").cast("string")).alias("title"),
        F.concat(F.lit("Details for part "), F.col("l_partkey").cast("string")).alias("description"),
        F.when(ln % 2 == 1, F.concat(F.lit("use safe call "), F.col("rn").cast("string"))).alias("suggestion"),
        F.when(F.col("l_suppkey") % 7 != 0, (F.lit(50) + F.lit(5) * k).cast("double") / 100).alias("confidence"))
    per_order = (li.select("l_orderkey", "rn", "l_partkey", F.to_json(item).alias("j"))
                 .groupBy(F.col("l_orderkey").alias("review_id"))
                 .agg(F.array_sort(F.collect_list(F.struct("rn", "j"))).alias("items"),
                      F.count(F.lit(1)).alias("n_items"), F.min("l_partkey").alias("min_part")))
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_id")).join(per_order, "review_id", "left")
    rid = F.col("review_id")
    empty = F.array().cast("array<string>")
    dirs = (F.when(rid % 5 == 0, empty).when(rid % 5 == 1, F.array(F.lit("security")))
             .when(rid % 5 == 2, F.array(F.lit("logic"), F.lit("style")))
             .when(rid % 5 == 3, F.array(F.lit("security"), F.lit("bogus"), F.lit("security"))))
    p1 = F.to_json(F.struct(
        F.concat(F.lit("Change "), rid.cast("string"), F.lit(" has "),
                 F.coalesce(F.col("n_items"), F.lit(0)).cast("string"), F.lit(" items")).alias("summary"),
        F.when(rid % 7 != 0, _pick(["low", "medium", "high"], rid % 3)).alias("risk_level"),
        F.array(F.concat(F.lit("part "), F.coalesce(F.col("min_part"), F.lit(0)).cast("string")), F.lit("tests")).alias("key_changes"),
        dirs.alias("analysis_directions")))
    all_items = F.coalesce(F.array_join(F.col("items")["j"], ", "), F.lit(""))
    even_items = F.coalesce(F.array_join(F.filter(F.col("items"), lambda s: s["rn"] % 2 == 0)["j"], ", "), F.lit(""))
    sec = F.concat(F.lit('{"findings": ['), all_items, F.when(((rid + 2) % 6 == 5) & (all_items != ""), F.lit(", 42")).otherwise(F.lit("")), F.lit("]}"))
    logic = F.concat(F.lit('{"findings": ['), even_items, F.lit("]}"))

    def usage(seq):
        base = [F.lit("prompt_tokens"), (1000 + rid % 100), F.lit("completion_tokens"), (300 + rid % 50)]
        full = F.create_map(*base, F.lit("total_tokens"), (1300 + rid % 100 + rid % 50 + seq))
        return F.when(rid % 9 == 0, F.create_map(*base)).otherwise(full).cast("map<string,bigint>")

    rows = [
        (F.lit("phase1"), 0, _wrap_json(p1, rid % 6, rid)),
        (F.lit("security"), 1, _wrap_json(sec, (rid + 2) % 6, rid)),
        (F.lit("logic"), 2, _wrap_json(logic, (rid + 4) % 6, rid)),
    ]
    out = None
    for phase, seq, text in rows:
        df = o.select("review_id", phase.alias("phase"), F.lit(seq).cast("long").alias("seq"), text.alias("text"),
                      usage(seq).alias("usage"))
        out = df if out is None else out.unionByName(df)
    repeat = o.filter(rid % 4 == 0).select("review_id", F.lit("security").alias("phase"), F.lit(3).cast("long").alias("seq"),
                                           F.lit("{}").alias("text"), usage(3).alias("usage"))
    return out.unionByName(repeat)


def direction_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order a focus override: null, [], ['style'] or ['logic', 'security']."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_id"))
    rid = F.col("review_id")
    ov = (F.when(rid % 4 == 1, F.array().cast("array<string>")).when(rid % 4 == 2, F.array(F.lit("style")))
           .when(rid % 4 == 3, F.array(F.lit("logic"), F.lit("security"))))
    return o.select("review_id", ov.alias("directions"))


def context_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per conversation with a token budget (null -> default) and a
    changed-files list that is null, empty or given."""
    c = _t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("review_id")).agg(
        F.count(F.lit(1)).alias("n_turns"))
    rid = F.col("review_id")
    budget = F.when(rid % 4 == 0, 4000).when(rid % 4 == 1, 1000).when(rid % 4 == 2, 333)
    files = (F.when(rid % 3 == 1, F.array().cast("array<string>"))
              .when(rid % 3 == 2, F.array(F.lit("src/f1.py"), F.lit("docs/readme.md"))))
    return c.select("review_id", budget.cast("long").alias("token_budget"),
                    F.concat(F.lit("Conversation "), rid.cast("string")).alias("title"),
                    F.concat(F.lit("Turns of conversation "), rid.cast("string")).alias("description"),
                    files.alias("changed_files"))


def context_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as the review's files (every fifth from turn 3 missing)."""
    c = _t(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("review_id"), F.col("turn").alias("file_seq"),
                    F.concat(F.lit("doc/"), F.col("role"), F.lit("_"), F.col("turn").cast("string"), F.lit(".md")).alias("path"),
                    F.when(F.col("turn") % 5 != 3, F.col("text")).alias("content"))


def summary_entries(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """Dict-shaped summaries: one entry per turn of the given role."""
    c = _t(spark, sf_dir, "conversations").filter(F.col("role") == role)
    return c.select(F.col("conv_id").alias("review_id"), F.col("turn").alias("ord"),
                    F.concat(F.lit(role + "_"), F.col("turn").cast("string")).alias("key"),
                    F.col("text").alias("value"))


# File names planted in the repository listings.
REPO_FILE_NAMES = ["requirements.txt", "Pipfile", "setup.cfg", "pyproject.toml", "pom.xml", "package.json",
                   "go.sum", "Cargo.lock", "Makefile", "main.py", "README.md", "App.java",
                   ".github/workflows/ci.yml", "docs", "requirements-dev.txt", "package-lock.json"]


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository listings from `part`: depth p_size % 8, name by p_partkey % 16."""
    p = _t(spark, sf_dir, "part")
    depth = F.col("p_size") % 8
    name = _pick(REPO_FILE_NAMES, F.col("p_partkey") % 16)
    dirs = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(depth - 1, F.lit(0))),
                                    lambda i: F.concat(F.lit("lvl"), i.cast("string"))), "/")
    path = F.when(depth > 0, F.concat(dirs, F.lit("/"), name)).otherwise(name)
    return p.select((F.col("p_partkey") % 25).alias("repository_id"), F.col("p_partkey").alias("file_id"),
                    path.alias("path"), (name == "docs").alias("is_dir"),
                    F.concat(F.lit("# "), F.col("p_name")).alias("content"))


# Python statement templates for generated sources, by l_partkey % 9. Each is
# (text, line count); '{r}' is the line item's rn.
PY_STATEMENTS = [
    ("    eval(a)", 1),
    ("    data = pickle.loads(b)", 1),
    ("    subprocess.run(a, shell=True)", 1),
    ('    cursor.execute("SELECT * FROM t WHERE id = " + a)', 1),
    ("    try:\n        x = int(a)\n    except:\n        pass", 4),
    ('    password = "s3cr3t-{r}"', 1),
    ("    fh = open(a)", 1),
    ("    with open(a) as fh:\n        x = fh.read()", 2),
    ('    api_token = "changeme"', 1),
]
LONG_FN_BODY = 54      # lines of `v = v + 1` in the long function
BRANCHY_IFS = 16       # sequential ifs in the complex function


def _py_block() -> Column:
    kind = F.col("l_partkey") % 9
    r = F.col("rn").cast("string")
    stmt = F.lit(None).cast("string")
    pad = F.lit(None).cast("int")
    for i, (txt, n) in reversed(list(enumerate(PY_STATEMENTS))):
        parts = txt.split("{r}")
        t = F.concat(*[x for p in parts for x in (F.lit(p), r)][:-1]) if len(parts) > 1 else F.lit(txt)
        stmt = F.when(kind == i, t).otherwise(stmt)
        pad = F.when(kind == i, F.lit(7 - n)).otherwise(pad)
    return F.concat(F.lit("def f_"), r, F.lit("(a, b):\n    x = a\n"), stmt, F.lit("\n    return x\n"),
                    F.repeat(F.lit("\n"), pad))


def python_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Python module per order: a 10-line function per line item whose
    statement is chosen by l_partkey % 9, then a trailer with a 56-line
    function (orders % 7 == 0), a 16-branch function (% 11 == 0), three
    imports, a decorated class (% 3 == 0) or an async function (% 3 == 1),
    and a syntax error (% 17 == 0)."""
    li = lineitem_rn(spark, sf_dir)
    blocks = (li.select("l_orderkey", "rn", _py_block().alias("b"))
              .groupBy(F.col("l_orderkey").alias("file_id"))
              .agg(F.array_join(F.array_sort(F.collect_list(F.struct("rn", "b")))["b"], "").alias("body")))
    o = F.col("file_id")
    long_fn = F.concat(F.lit("def long_"), o.cast("string"), F.lit("(v):\n"),
                       F.repeat(F.lit("    v = v + 1\n"), LONG_FN_BODY), F.lit("    return v\n"))
    branchy = F.concat(F.lit("def branchy(v):\n"), F.lit("".join(
        f"    if v == {i}:\n        v = 0\n" for i in range(1, BRANCHY_IFS + 1))), F.lit("    return v\n"))
    imports = F.lit("import os\nfrom . import sibling\nfrom pkg.sub import thing as t\n")
    extra = (F.when(o % 3 == 0, F.concat(F.lit("@dataclass\nclass Model_"), o.cast("string"),
                                        F.lit("(Base, mixins.Audit):\n    pass\n")))
              .when(o % 3 == 1, F.concat(F.lit("async def fetch_"), o.cast("string"),
                                         F.lit("(u):\n    return await get(u)\n"))).otherwise(""))
    text = F.concat("body", F.when(o % 7 == 0, long_fn).otherwise(""), F.when(o % 11 == 0, branchy).otherwise(""),
                    imports, extra, F.when(o % 17 == 0, F.lit("def broken(:\n")).otherwise(""))
    return blocks.select("file_id", F.concat(F.lit("pkg/m"), o.cast("string"), F.lit(".py")).alias("path"),
                         text.alias("content"))


# Java statement templates for generated sources, by l_partkey % 7: (text, lines).
JAVA_STATEMENTS = [
    ("        Runtime.getRuntime().exec(cmd);", 1),
    ("        Object o = in.readObject();", 1),
    ('        stmt.executeQuery("SELECT * FROM t WHERE id = " + cmd);', 1),
    ("        FileReader fr = new FileReader(cmd);", 1),
    ('        String password = "s3cr3t{r}";', 1),
    ("        try (BufferedReader br = new BufferedReader(new FileReader(cmd))) {\n"
     "            x = br.readLine();\n        }", 3),
    ('        Runtime.getRuntime().exec("ls");', 1),
]
JAVA_HEADER_LINES = 4
JAVA_LONG_BODY = 53
JAVA_BRANCHES = 11


def java_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Java class per order: a 10-line method per line item whose
    statement is chosen by l_partkey % 7, then a 55-line method (orders % 7 ==
    0), an 11-branch method (% 11 == 0) and an undeclared throw (% 13 == 0)."""
    li = lineitem_rn(spark, sf_dir)
    kind = F.col("l_partkey") % 7
    r = F.col("rn").cast("string")
    stmt = F.lit(None).cast("string")
    pad = F.lit(None).cast("int")
    for i, (txt, n) in reversed(list(enumerate(JAVA_STATEMENTS))):
        parts = txt.split("{r}")
        t = F.concat(F.lit(parts[0]), r, F.lit(parts[1])) if len(parts) > 1 else F.lit(txt)
        stmt = F.when(kind == i, t).otherwise(stmt)
        pad = F.when(kind == i, F.lit(6 - n)).otherwise(pad)
    block = F.concat(F.lit("    public String m"), r, F.lit("(String cmd, int n) throws Exception {\n"
                                                              "        String x = cmd;\n"),
                     stmt, F.lit("\n        return x;\n    }\n"), F.repeat(F.lit("\n"), pad))
    blocks = (li.select("l_orderkey", "rn", block.alias("b"))
              .groupBy(F.col("l_orderkey").alias("file_id"))
              .agg(F.array_join(F.array_sort(F.collect_list(F.struct("rn", "b")))["b"], "").alias("body")))
    o = F.col("file_id")
    header = F.concat(F.lit("package demo;\nimport java.io.*;\nimport java.util.List;\npublic class C"), o.cast("string"),
                      F.lit(" extends Base implements Runnable, Serializable {\n"))
    long_m = F.lit("    public void longOne() {\n" + "        count++;\n" * JAVA_LONG_BODY + "    }\n")
    branchy = F.lit("    public int branchy(int v) {\n" + "".join(
        f"        if (v == {i}) {{ v = 0; }}\n" for i in range(1, JAVA_BRANCHES + 1)) + "        return v;\n    }\n")
    fail = F.lit('    public void fail() {\n        throw new IllegalStateException("x");\n    }\n')
    text = F.concat(header, F.col("body"), F.when(o % 7 == 0, long_m).otherwise(""),
                    F.when(o % 11 == 0, branchy).otherwise(""), F.when(o % 13 == 0, fail).otherwise(""), F.lit("}\n"))
    return blocks.select("file_id", F.concat(F.lit("src/C"), o.cast("string"), F.lit(".java")).alias("path"),
                         text.alias("content"))


JAVA_FILE_ID_OFFSET = 1_000_000_000_000


def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python modules, Java classes and the raw web pages as .html / .PY files:
    a corpus where dispatch by suffix matters. File ids are unique within a
    language (each language is scanned on its own); pages are offset."""
    py = python_sources(spark, sf_dir)
    jv = java_sources(spark, sf_dir)
    pages = _t(spark, sf_dir, "pages").select(
        F.col("page_id").alias("file_id"),
        F.concat(F.lit("pages/p"), F.col("page_id").cast("string"),
                 F.when(F.col("page_id") % 2 == 0, F.lit(".html")).otherwise(F.lit(".PY"))).alias("path"),
        F.col("html").alias("content")).withColumn("file_id", F.col("file_id") + 2 * JAVA_FILE_ID_OFFSET)
    return py.unionByName(jv).unionByName(pages)


# Comment bodies of the generated issue comments (by k % 8).
COMMENT_BODIES = ["/review", "/review focus:security", "/review focus:security,logic", "/REVIEW focus:bogus",
                  " looks good ", "/review please", "/Review focus:Style", "  /review focus:style,bogus\n"]


def webhook_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook deliveries from `events`: purchase -> pull_request (opened /
    reopened / closed by k % 3), click -> synchronize, view -> issue_comment,
    error -> installation(_repositories), signup -> ping. k comes from props."""
    e = _t(spark, sf_dir, "events")
    n = _t(spark, sf_dir, "nation")
    r = _t(spark, sf_dir, "region")
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").cast("long").alias("nkey"), F.lower("r_name").alias("g_owner"), F.lower("n_name").alias("g_repo"))
    k = F.regexp_extract(F.col("props"), r"(\d+)", 1).cast("long")
    e = e.withColumn("k", k).withColumn("nkey", F.col("user_id") % 30).join(geo, "nkey", "left")
    et = F.col("event_type")
    ev_type = (F.when(et.isin("purchase", "click"), "pull_request").when(et == "view", "issue_comment")
                .when(et == "error", F.when(F.col("k") % 2 == 0, "installation_repositories").otherwise("installation"))
                .otherwise("ping"))
    kk = F.col("k")
    action = (F.when(et == "purchase", _pick(["opened", "reopened", "closed"], kk % 3))
               .when(et == "click", F.lit("synchronize"))
               .when(et == "view", F.when(kk % 2 == 0, "created").otherwise("edited"))
               .when(et == "error", F.lit("created")))
    repo = F.struct(F.coalesce(F.col("g_repo"), F.concat(F.lit("repo"), F.col("nkey").cast("string"))).alias("name"),
                    F.struct(F.coalesce(F.col("g_owner"), F.lit("ghost")).alias("login")).alias("owner"))
    sender = F.struct(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("login"))
    install = F.when(kk % 4 != 0, F.struct(kk.alias("id")))
    pr = F.struct(F.when(kk % 4 != 0, F.col("event_id")).otherwise(F.lit(0)).alias("number"),
                  F.concat(F.lit("Change "), F.col("event_id").cast("string")).alias("title"))
    url = F.concat(F.lit("https://api.example/repos/x/y/pulls/"),
                   F.when(kk % 5 == 0, F.lit("abc")).otherwise(F.col("event_id").cast("string")))
    issue = F.struct(F.col("event_id").alias("number"),
                     F.when(kk % 7 != 0, F.struct(url.alias("url"))).alias("pull_request"))
    comment = F.struct(_pick(COMMENT_BODIES, kk % len(COMMENT_BODIES)).alias("body"), F.col("event_id").alias("id"))
    is_pr = et.isin("purchase", "click")
    payload = F.to_json(F.struct(
        action.alias("action"),
        F.when(is_pr, F.col("event_id") + 1000000).alias("number"),
        F.when(is_pr, pr).alias("pull_request"),
        F.when(et == "view", issue).alias("issue"),
        F.when(et == "view", comment).alias("comment"),
        F.when(et != "error", repo).alias("repository"),
        F.when(et != "signup", sender).alias("sender"),
        F.when(et != "signup", install).alias("installation"),
        F.when(et == "signup", F.lit("Keep it logically awesome.")).alias("zen")))
    return e.select(F.col("event_id").alias("delivery_id"), ev_type.alias("event_type"), payload.alias("payload"),
                    F.col("ts"))


def collaborators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collaborators per repository: users whose id is even, for every nation
    repository (a stream-static join partner)."""
    n = _t(spark, sf_dir, "nation")
    r = _t(spark, sf_dir, "region")
    c = _t(spark, sf_dir, "customer").filter(F.col("c_custkey") % 2 == 0).select("c_custkey", "c_nationkey")
    return (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.lower("r_name").alias("owner"), F.lower("n_name").alias("repo"),
                    F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("login")))


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review status changes: every order starts pending at its date and, unless
    still open, ends completed (F) or failed (P) a day later."""
    o = _t(spark, sf_dir, "orders")
    start = o.select(F.col("o_orderkey").alias("review_id"), F.lit("pending").alias("status"),
                     F.lit(None).cast("string").alias("error_message"), F.col("o_orderdate").alias("ts"),
                     F.lit(0).alias("seq"))
    end = o.filter(F.col("o_orderstatus") != "O").select(
        F.col("o_orderkey").alias("review_id"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"),
        F.when(F.col("o_orderstatus") == "P", F.lit("analysis failed")).alias("error_message"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit(1).alias("seq"))
    return start.unionByName(end)
