"""Diff parser edge cases (shapes follow the reference's diff-parser tests)."""

from crx.operators import diffs as DF

TWO_FILES = "\n".join([
    "diff --git a/app/a.py b/app/a.py",
    "--- a/app/a.py",
    "+++ b/app/a.py",
    "@@ -1,3 +1,4 @@ def f():",
    " x = 1",
    "-y = 2",
    "+y = 3",
    "+z = 4",
    " return x",
    "@@ -10,2 +11,3 @@",
    " a",
    "+b",
    "-- removed sql comment",
    "--- removed sql comment",
    "diff --git a/bin.png b/bin.png",
    "Binary files differ",
    'diff --git "a/my file.py" "b/my file.py"',
    "@@ -5 +5 @@",
    "+only",
    "\\ No newline at end of file",
])


def _df(spark, text, rid=1):
    return spark.createDataFrame([(rid, text)], "review_id long, diff_text string")


def test_files_hunks_and_quoted_path(spark):
    p = DF.parsed_diff(_df(spark, TWO_FILES))
    hunks = DF.diff_hunks(None, p).orderBy("hunk_line").collect()
    assert [(h.file_path, h.old_start, h.hdr_old_count, h.new_start, h.new_count) for h in hunks] == [
        ("app/a.py", 1, 3, 1, 4), ("app/a.py", 10, 2, 11, 3), ('file.py"', 5, 1, 5, 1)]
    stats = {(r.file_path): (r.added, r.removed) for r in DF.diff_stats(None, p).collect()}
    # the binary file has no hunk and vanishes; '--- removed' is dropped
    assert stats == {"app/a.py": (3, 2), 'file.py"': (1, 0)}


def test_ref_numbering_counts_per_file_not_per_hunk(spark):
    p = DF.parsed_diff(_df(spark, TWO_FILES))
    ref = DF.diff_lines(None, "ref", p).filter("kind = '+'").orderBy("line_no").collect()
    # second hunk: new_start 11 + 3rd added line of the file - 1 = 13
    assert [(r.content, r.new_line) for r in ref] == [("y = 3", 1), ("z = 4", 2), ("b", 13), ("only", 5)]
    git = DF.diff_lines(None, "git", p).filter("kind = '+'").orderBy("line_no").collect()
    assert [(r.content, r.new_line) for r in git] == [("y = 3", 2), ("z = 4", 3), ("b", 12), ("only", 5)]


def test_walk_positions_and_anchor(spark):
    p = DF.parsed_diff(_df(spark, TWO_FILES))
    walk = DF.diff_walk(None, p)
    pos = {(r.file_path, r.content): r.position for r in walk.collect()}
    assert pos[("app/a.py", "x = 1")] == 2
    assert pos[("app/a.py", "y = 3")] == 4
    assert pos[("app/a.py", "a")] == 8   # 6 lines + 2 headers before it
    f = spark.createDataFrame(
        [(1, 1, "app/a.py", 3, 3), (1, 2, "app/a.py", 12, 40), (1, 3, "app/a.py", 6, 9), (1, 4, "zzz.py", 1, 1)],
        "review_id long, seq long, file_path string, line_start int, line_end int")
    got = {r.seq: r.diff_position for r in DF.anchor_findings(f, walk).collect()}
    assert got == {1: 5, 2: 9, 3: None, 4: None}


def test_old_count_adjusted_at_context_lines(spark):
    text = "diff --git a/x b/x\n@@ -7 +7,3 @@\n+a\n ctx\n+b\n ctx2"
    h = DF.diff_hunks(None, DF.parsed_diff(_df(spark, text))).collect()[0]
    # candidates at context lines: 7 + 0 and 7 + 1 non-'+' lines before -> 8
    assert (h.hdr_old_count, h.old_count) == (1, 8)


def test_empty_and_blank_text(spark):
    df = spark.createDataFrame([(1, ""), (2, "  \n\t\n"), (3, "a\r\nb\x1cc d\n")], "review_id long, diff_text string")
    rows = DF.diff_lines_raw(df).orderBy("review_id", "line_no").collect()
    assert [(r.review_id, r.line) for r in rows] == [(3, "a"), (3, "b"), (3, "c"), (3, "d")]


def test_size_gate(spark):
    df = spark.createDataFrame([(1, "é" * 3), (2, "abc")], "review_id long, diff_text string")
    got = {r.review_id: (r.diff_bytes, r.accepted) for r in DF.diff_size_gate(df, max_bytes=5).collect()}
    assert got == {1: (6, False), 2: (3, True)}


def _walk(review_id, text):
    """The parse as one loop over the lines: what each hunk header and body line gets."""
    import re
    from collections import Counter
    out, file, hunk, positions = [], None, None, Counter()
    for no, line in enumerate(text.splitlines()):
        head = re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line)
        if line.startswith("diff --git "):
            parts = line.split()
            path = parts[3].removeprefix("b/") if len(parts) >= 4 else ""
            file, hunk, added, removed = (no, path), None, 0, 0
        elif line.startswith(("--- ", "+++ ")):
            continue
        elif head:
            if file is not None:
                hunk, new, old = (no, int(head[3])), int(head[3]), int(head[1])
                start_new, start_old = new, old
                positions[file[1]] += 1
                out.append((review_id, no, file, None, None, None, None, None, positions[file[1]]))
        elif line and line[0] in " +-" and hunk is not None:
            positions[file[1]] += 1
            added, removed = added + (line[0] == "+"), removed + (line[0] == "-")
            new, old = new + (line[0] != "-"), old + (line[0] != "+")
            out.append((review_id, no, file, line[0], start_new + added - 1 if line[0] == "+" else None, start_old + removed - 1 if line[0] == "-" else None,
                        new - 1 if line[0] != "-" else None, old - 1 if line[0] != "+" else None, positions[file[1]]))
    return out


def test_scan_in_chunks_equals_the_loop(spark):
    """Headers, bodies and stray lines in any order, chunks of any size."""
    import random
    rng = random.Random(1)

    def line():
        return rng.choice([f"diff --git a/x b/{rng.choice('abc')}", f"diff --git a/x b/{rng.choice('abc')}", "diff --git bad", "--- a/x", "+++ b/x", "@@ -3 +4 @@",
                           f"@@ -{rng.randrange(9)},{rng.randrange(5)} +{rng.randrange(9)},{rng.randrange(5)} @@ s", "+a", "+b", "-c", " d", " e", "-f", "", "\\ No newline", "+++x"])
    texts = [(i, "\n".join(line() for _ in range(rng.randrange(60)))) for i in range(150)]
    df = spark.createDataFrame(texts, "review_id long, diff_text string")
    want = sorted((r for i, t in texts for r in _walk(i, t)), key=str)
    for chunk in (None, 1, 3, 20_000):
        rows = DF.parsed_diff(df, chunk).collect()
        got = [(r.review_id, r.line_no, (r.file_line, r.file_path), r.kind, r.ref_new_line, r.ref_old_line, r.new_line, r.old_line, r.position) for r in rows]
        assert sorted(got, key=str) == want, chunk


def test_one_long_review_is_spread_over_tasks(spark):
    text = "diff --git a/x b/x\n@@ -1,1 +1,90000 @@\n" + "\n".join(f"+line {i}" for i in range(90_000))
    df = spark.createDataFrame([(1, text)], "review_id long, diff_text string")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = DF.parsed_diff(df, 3_000).groupBy(DF.F.spark_partition_id().alias("p")).agg(DF.F.count("*").alias("n"), DF.F.max("position").alias("last"), DF.F.max("new_line").alias("line")).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert sum(r.n for r in rows) == 90_001 and max(r.n for r in rows) < 45_000
    assert max(r.last for r in rows) == 90_001 and max(r.line or 0 for r in rows) == 90_000


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hunks_are_counted_where_their_lines_are(spark):
    # one parse, one shuffle by review: no join of the headers with their counts
    df = spark.createDataFrame([(i, TWO_FILES) for i in range(3)], "review_id long, diff_text string").repartition(4)
    plan = _plan(DF.diff_hunks(df))
    assert "Join" not in plan and plan.count("Generate posexplode") == 1
    assert plan.count("Exchange hashpartitioning") == 1
    got = sorted((h.review_id, h.hunk_idx, h.hdr_old_count, h.old_count, h.n_lines, h.header) for h in DF.diff_hunks(df).collect())
    assert got[:3] == [(0, 1, 1, 1, 1, "@@ -5 +5 @@"), (0, 1, 3, 3, 5, "@@ -1,3 +1,4 @@ def f():"), (0, 2, 2, 10, 3, "@@ -10,2 +11,3 @@")]
