"""Unified-diff operators (§2.2).

The diff text is exploded into numbered lines once; the parser's state (current
file, current hunk, running counters) is recovered with window functions over
(review_id ORDER BY line_no), which share one shuffle; or, for diffs of any length, by
a prefix scan over chunks of lines in two levels: windows inside a chunk, and a summary
per chunk, so that a long review is spread over many tasks. `gated_diff_text` drops reviews whose diff is
over the limit before any text is assembled; on its output a review has at most
500,000 bytes of lines. `parsed_diff` itself takes any diff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crx.functions.common import count_if
from crx.functions.text import is_blank, py_split_ws, splitlines

MAX_DIFF_BYTES = 500_000
CHUNK_LINES = 20_000
PARSED = ["review_id", "line_no", "line", "file_path", "file_line", "hunk_line", "is_hunk", "is_body", "kind", "old_start", "hdr_old_count", "new_start",
          "new_count", "section", "ref_new_line", "ref_old_line", "new_line", "old_line", "old_count_cand", "position"]
HUNK_RE = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$"


def build_diff_text(pr_files: DataFrame) -> DataFrame:
    """Per review, in file order, skipping null/empty patches: the three
    header lines then the patch, all joined by newlines."""
    parts = (pr_files.filter(F.col("patch").isNotNull() & (F.col("patch") != ""))
             .select("review_id", "file_seq", F.concat_ws(
                 "\n",
                 F.concat(F.lit("diff --git a/"), F.col("filename"), F.lit(" b/"), F.col("filename")),
                 F.concat(F.lit("--- a/"), F.col("filename")),
                 F.concat(F.lit("+++ b/"), F.col("filename")),
                 F.col("patch")).alias("part")))
    return (parts.groupBy("review_id")
            .agg(F.array_sort(F.collect_list(F.struct("file_seq", "part"))).alias("p"))
            .select("review_id", F.array_join(F.col("p.part"), "\n").alias("diff_text")))


def diff_size_gate(diffs: DataFrame, max_bytes: int = MAX_DIFF_BYTES) -> DataFrame:
    """Adds `diff_bytes` and `accepted` (UTF-8 size not above the limit)."""
    return diffs.withColumn("diff_bytes", F.octet_length("diff_text").cast("long")) \
                .withColumn("accepted", F.col("diff_bytes") <= max_bytes)


def gated_diff_text(pr_files: DataFrame, max_bytes: int = MAX_DIFF_BYTES) -> DataFrame:
    """`build_diff_text` of the reviews whose text is not above the limit. Sizes are
    summed first, so the text of a review beyond the limit is never gathered:
    the three header lines with the name four times, the patch, and newlines."""
    size = F.octet_length("patch") + 4 * F.octet_length("filename") + len("diff --git a/ b/") + len("--- a/") + len("+++ b/") + 3
    present = F.col("patch").isNotNull() & (F.col("patch") != "")
    small = (pr_files.filter(present).groupBy("review_id").agg((F.sum(size.cast("long") + 1) - 1).alias("n"))
             .filter(F.col("n") <= max_bytes).select("review_id"))
    return build_diff_text(pr_files.join(small, "review_id", "left_semi"))


def diff_lines_raw(diffs: DataFrame) -> DataFrame:
    """(review_id, line_no, line) with Python splitlines semantics; blank-only
    text gives no lines."""
    return (diffs.filter(~is_blank(F.col("diff_text")))
            .select("review_id", F.posexplode(splitlines(F.col("diff_text"))).alias("line_no", "line")))


def _classified(raw: DataFrame) -> DataFrame:
    """What each line is by itself: `file` (its own line and path), `hunk` (its own line
    and fields) and `sign` of a line that is a body line wherever a hunk is open."""
    line = F.col("line")
    is_file = line.startswith("diff --git ")
    is_skip = ~is_file & (line.startswith("--- ") | line.startswith("+++ "))
    is_hunk = ~is_file & ~is_skip & line.startswith("@@ -") & line.rlike(HUNK_RE)
    toks = py_split_ws(line)
    path = F.when(F.size(toks) >= 4, F.regexp_replace(F.element_at(toks, 4), "^b/", "")).otherwise(F.lit(""))
    first = F.substring(line, 1, 1)

    def grp(i):
        return F.regexp_extract(line, HUNK_RE, i)

    def count(i):
        return F.coalesce(F.nullif(grp(i), F.lit("")), F.lit("1")).cast("long")
    fields = F.struct(F.col("line_no").alias("at"), grp(1).cast("long").alias("old_start"), count(2).alias("old_count"),
                      grp(3).cast("long").alias("new_start"), count(4).alias("new_count"), grp(5).alias("section"))
    return raw.select("review_id", "line_no", "line", F.when(is_file, F.struct(F.col("line_no").alias("at"), path.alias("path"))).alias("file"),
                      F.when(is_hunk, fields).alias("hunk"),
                      F.when(~is_file & ~is_skip & ~is_hunk & (F.length(line) > 0) & first.isin(" ", "+", "-"), first).alias("sign"))


_COUNTS = ("added", "removed", "kept", "rows")  # rows: body lines and hunk headers


def _weights(sign: Column, body: Column, header: Column) -> dict[str, Column]:
    """What a line adds to each count: a body line by its sign, a header to rows."""
    one = lambda c: F.when(c, 1).otherwise(0)
    return {"added": one(body & (sign == "+")), "removed": one(body & (sign == "-")), "kept": one(body & (sign == " ")), "rows": one(body | header)}


def _minus(a: Column, b: Column) -> Column:
    return F.struct(*[(a[n] - b[n]).alias(n) for n in _COUNTS])


def _plus(a: Column, b: Column) -> Column:
    return F.struct(*[(a[n] + b[n]).alias(n) for n in _COUNTS])


def _none() -> Column:
    return F.struct(*[F.lit(0).cast("long").alias(n) for n in _COUNTS])


def _chunk_states(rows: DataFrame) -> DataFrame:
    """The parser's state before each chunk of a review, from one summary per chunk.

    A chunk's lines before its first header are body lines if a hunk was open before
    (`early`); those after a hunk header but before the chunk's first file header are if a
    file was (`middle`); from its first file header on a chunk knows by itself. So a
    summary holds the counts of both kinds and the counts since the last file and the last
    header, and states follow by sums and last values over the chunks of a review."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    end = lambda c: F.max_by(c, "line_no")
    chunks = rows.groupBy("review_id", "chunk").agg(
        last("file").alias("file"), last("hunk").alias("hunk"), end("early").alias("early"), end("middle").alias("middle"),
        end("since_file").alias("since_file"), end("since_header").alias("since_header"), F.max(F.col("line_no")).alias("line_no"))
    order = Window.partitionBy("review_id").orderBy("chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.last(c, ignorenulls=True).over(before)
    chunks = chunks.withColumns({"file_in": earlier("file"), "hunk_in": earlier("hunk")})
    chunks = chunks.withColumn("open_in", _is_open("file_in", "hunk_in"))
    zero = _none()
    moved = _plus(F.when(F.col("open_in"), F.col("early")).otherwise(zero), F.when(F.col("file_in").isNotNull(), F.col("middle")).otherwise(zero))
    chunks = chunks.withColumns({"moved": F.when(F.col("file").isNull(), moved).otherwise(zero),
                                 "quiet": F.when(F.col("file").isNull() & F.col("hunk").isNull(), F.col("early")).otherwise(zero)})

    def carried(reset: Column, at_reset: str, added: str) -> Column:
        """The count since the last reset in an earlier chunk."""
        total = F.struct(*[F.sum(f"{added}.{n}").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in _COUNTS])
        base = F.last(F.when(reset, _minus(F.col(at_reset), total)), ignorenulls=True).over(before)
        so_far = F.struct(*[F.coalesce(F.sum(f"{added}.{n}").over(before), F.lit(0)).alias(n) for n in _COUNTS])
        return _plus(F.coalesce(base, zero), so_far)
    return chunks.select(
        "review_id", "chunk", "file_in", "hunk_in", "open_in",
        carried(F.col("file").isNotNull(), "since_file", "moved").alias("file_counts_in"),
        carried(F.col("file").isNotNull() | F.col("hunk").isNotNull(), "since_header", "quiet").alias("hunk_counts_in"))


def _is_open(file: str, hunk: str) -> Column:
    """Whether a hunk is open: its header came after the file's."""
    return F.coalesce(F.col(f"{hunk}.at") > F.col(f"{file}.at"), F.lit(False))


def _scan_chunks(diffs: DataFrame, chunk_lines: int) -> DataFrame:
    """The parse as a segmented prefix scan: counts that start anew at file and hunk headers. Lines are
    dealt by (review, chunk of lines) and scanned inside their chunk; the state that a
    chunk begins with comes from the summaries of those before it (`_chunk_states`), so
    a review of any length is spread over tasks. All windows over lines share one
    shuffle and one sort."""
    c = _classified(diff_lines_raw(diffs)).withColumn("chunk", F.floor(F.col("line_no") / chunk_lines).cast("long"))
    run = Window.partitionBy("review_id", "chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({"own_file": F.last("file", ignorenulls=True).over(run), "own_hunk": F.last("hunk", ignorenulls=True).over(run)})
    has_file, has_hunk = F.col("own_file").isNotNull(), F.col("own_hunk").isNotNull()
    signed, header = F.col("sign").isNotNull(), F.col("hunk").isNotNull()

    def counted(body: Column, heads: Column) -> Column:
        return F.struct(*[F.sum(w).over(run).alias(n) for n, w in _weights(F.col("sign"), body, heads).items()])
    c = c.withColumns({
        "early": counted(signed & ~has_file & ~has_hunk, F.lit(False)),
        "middle": counted(signed & ~has_file & has_hunk, header & ~has_file),
        "known": counted(signed & has_file & _is_open("own_file", "own_hunk"), header & has_file),
        "any": counted(signed, header)})
    at_file = F.last(F.when(F.col("file").isNotNull(), F.col("known")), ignorenulls=True).over(run)
    at_header = F.last(F.when(F.col("file").isNotNull() | header, F.col("any")), ignorenulls=True).over(run)
    c = c.withColumns({"since_file": _minus(F.col("known"), F.coalesce(at_file, _none())), "since_header": _minus(F.col("any"), F.coalesce(at_header, _none()))})
    c = c.join(_chunk_states(c), ["review_id", "chunk"])
    c = c.withColumns({"in_file": F.coalesce("own_file", "file_in"), "in_hunk": F.coalesce("own_hunk", "hunk_in")})
    c = c.withColumns({"is_hunk": header & F.col("in_file").isNotNull(), "is_body": signed & _is_open("in_file", "in_hunk")}).filter("is_hunk OR is_body")
    # counts since the file's header, and since the hunk's
    before_file = _plus(F.col("file_counts_in"), _plus(F.when(F.col("open_in"), F.col("early")).otherwise(_none()), F.col("middle")))
    n = F.when(has_file, F.col("since_file")).otherwise(before_file)
    h = F.when(has_file | has_hunk, F.col("since_header")).otherwise(_plus(F.col("hunk_counts_in"), F.col("early")))
    c = c.withColumns({"n": n, "h": h})
    # a path may have several sections: positions go on from one to the next. What comes
    # before a section is looked up by chunk, where the lines already are
    sections = (c.groupBy("review_id", "chunk", F.col("in_file.path").alias("file_path"), F.col("in_file.at").cast("long").alias("at"))
                .agg(F.max("n.rows").alias("rows")))
    inside = Window.partitionBy("review_id", "at").orderBy("chunk")
    before = Window.partitionBy("review_id", "file_path").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    again = (sections.withColumn("rows", F.col("rows") - F.lag("rows", 1, 0).over(inside)).withColumn("rows_before", F.sum("rows").over(before))
             .filter("rows_before IS NOT NULL").groupBy("review_id", "chunk")
             .agg(F.map_from_entries(F.collect_list(F.struct("at", "rows_before"))).alias("rows_before")))
    k, hunk = F.when(F.col("is_body"), F.col("sign")), F.col("in_hunk")
    c = c.select(
        "review_id", "line_no", "line", F.col("in_file.path").alias("file_path"), F.col("in_file.at").alias("file_line"), F.col("in_hunk.at").alias("hunk_line"),
        "is_hunk", "is_body", k.alias("kind"), hunk["old_start"].alias("old_start"), hunk["old_count"].alias("hdr_old_count"),
        hunk["new_start"].alias("new_start"), hunk["new_count"].alias("new_count"), hunk["section"].alias("section"),
        F.when(k == "+", hunk["new_start"] + F.col("n.added") - 1).alias("ref_new_line"),
        F.when(k == "-", hunk["old_start"] + F.col("n.removed") - 1).alias("ref_old_line"),
        F.when(k.isin(" ", "+"), hunk["new_start"] + F.col("h.kept") + F.col("h.added") - 1).alias("new_line"),
        F.when(k.isin(" ", "-"), hunk["old_start"] + F.col("h.kept") + F.col("h.removed") - 1).alias("old_line"),
        # at context lines: old_start + earlier non-'+' lines of the hunk
        F.when(k == " ", hunk["old_start"] + F.col("h.kept") + F.col("h.removed") - 1).alias("old_count_cand"),
        "chunk", F.col("n.rows").alias("rows"))
    earlier = F.coalesce(F.try_element_at("rows_before", F.col("file_line").cast("long")), F.lit(0))
    return c.join(again, ["review_id", "chunk"], "left").withColumn("position", F.col("rows") + earlier).select(*PARSED)


def _scan_reviews(diffs: DataFrame) -> DataFrame:
    """The parse by windows over a whole review. All but the last share (review_id
    ORDER BY line_no), so Spark sorts once; the last adds the file path to the
    partition key (same shuffle)."""
    raw = diff_lines_raw(diffs)
    w = Window.partitionBy("review_id").orderBy("line_no")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line")
    is_file = line.startswith("diff --git ")
    is_skip = ~is_file & (line.startswith("--- ") | line.startswith("+++ "))
    is_hunk = ~is_file & ~is_skip & line.startswith("@@ -") & line.rlike(HUNK_RE)
    toks = py_split_ws(line)
    path = F.when(F.size(toks) >= 4, F.regexp_replace(F.element_at(toks, 4), "^b/", "")).otherwise(F.lit(""))
    first = F.substring(line, 1, 1)
    body_like = ~is_file & ~is_skip & ~is_hunk & (F.length(line) > 0) & first.isin(" ", "+", "-")
    c = raw.select("review_id", "line_no", "line", is_file.alias("is_file"), is_hunk.alias("is_hunk"),
                   body_like.alias("body_like"), F.when(is_file, path).alias("_path"))
    # pass 1: current file header and latest hunk header
    c = c.select(
        "*",
        F.last(F.when(F.col("is_file"), F.col("line_no")), ignorenulls=True).over(run).alias("file_line"),
        F.last("_path", ignorenulls=True).over(run).alias("file_path"),
        F.last(F.when(F.col("is_hunk"), F.col("line_no")), ignorenulls=True).over(run).alias("hunk_line"))
    # A hunk counts only inside a file; a body line only inside a hunk that
    # started after the current file header.
    valid_hunk = F.col("is_hunk") & F.col("file_line").isNotNull()
    in_hunk = F.col("hunk_line").isNotNull() & F.col("file_line").isNotNull() & (F.col("hunk_line") > F.col("file_line"))
    is_body = F.col("body_like") & in_hunk
    c = c.select("*", valid_hunk.alias("valid_hunk"), is_body.alias("is_body"),
                 F.when(is_body, F.substring("line", 1, 1)).alias("kind"))
    k = F.col("kind")

    def cum(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).over(run)

    def at(flag, col):
        return F.last(F.when(F.col(flag), col), ignorenulls=True).over(run)

    def grp(i):
        return F.regexp_extract("line", HUNK_RE, i)

    # pass 2: running counters of retained body lines
    c = c.select("*", cum(k == "+").alias("cum_add"), cum(k == "-").alias("cum_del"),
                 cum(k.isin(" ", "-")).alias("cum_old"), cum(k.isin(" ", "+")).alias("cum_new"))
    # pass 3: counters at the file header and at the hunk header; hunk fields
    c = c.select(
        "*",
        at("is_file", F.col("cum_add")).alias("add_at_file"),
        at("is_file", F.col("cum_del")).alias("del_at_file"),
        at("valid_hunk", F.col("cum_old")).alias("old_at_hunk"),
        at("valid_hunk", F.col("cum_new")).alias("new_at_hunk"),
        at("valid_hunk", grp(1).cast("long")).alias("old_start"),
        at("valid_hunk", F.coalesce(F.nullif(grp(2), F.lit("")), F.lit("1")).cast("long")).alias("hdr_old_count"),
        at("valid_hunk", grp(3).cast("long")).alias("new_start"),
        at("valid_hunk", F.coalesce(F.nullif(grp(4), F.lit("")), F.lit("1")).cast("long")).alias("new_count"),
        at("valid_hunk", grp(5)).alias("section"))
    c = c.filter(F.col("valid_hunk") | F.col("is_body"))
    pw = Window.partitionBy("review_id", "file_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return c.select(
        "review_id", "line_no", "line", "file_path", "file_line", "hunk_line",
        F.col("valid_hunk").alias("is_hunk"), "is_body", "kind",
        "old_start", "hdr_old_count", "new_start", "new_count", "section",
        F.when(k == "+", F.col("new_start") + F.col("cum_add") - F.col("add_at_file") - 1).alias("ref_new_line"),
        F.when(k == "-", F.col("old_start") + F.col("cum_del") - F.col("del_at_file") - 1).alias("ref_old_line"),
        F.when(k.isin(" ", "+"), F.col("new_start") + F.col("cum_new") - F.col("new_at_hunk") - 1).alias("new_line"),
        F.when(k.isin(" ", "-"), F.col("old_start") + F.col("cum_old") - F.col("old_at_hunk") - 1).alias("old_line"),
        # at context lines: old_start + earlier non-'+' lines of the hunk
        F.when(k == " ", F.col("old_start") + F.col("cum_old") - F.col("old_at_hunk") - 1).alias("old_count_cand"),
        F.count(F.lit(1)).over(pw).alias("position"))


def parsed_diff(diffs: DataFrame, chunk_lines: int | None = None) -> DataFrame:
    """One row per hunk header and per body line with file, hunk fields and
    both numberings (`ref_*` as the reference numbers lines, `new_line`/
    `old_line`/`position` as the true unified-diff walk).

    Diffs that passed the size gate are parsed a review at a time. For others give
    `chunk_lines` (CHUNK_LINES, say): a review is then spread over as many tasks as it
    has chunks, for one more shuffle of summaries. The rows are the same."""
    return (_scan_reviews(diffs) if chunk_lines is None else _scan_chunks(diffs, chunk_lines)).select(*PARSED)


def diff_hunks(diffs: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """One row per hunk: header, starts, counts (old_count adjusted as the
    reference does), hunk index within its path and the body line count."""
    p = parsed if parsed is not None else parsed_diff(diffs)
    # the header is picked in the same pass as the counts: no join, so lines are parsed once
    # and, dealt by review, neither shuffled again
    header = F.struct("file_path", F.col("line").alias("header"), "old_start", "hdr_old_count", "new_start", "new_count", "section",
                      F.col("position").alias("header_position"))
    h = (p.groupBy("review_id", "hunk_line")
         .agg(F.max(F.when(F.col("is_hunk"), header)).alias("h"), F.max("old_count_cand").alias("cand"), count_if(F.col("is_body")).alias("n_lines"))
         .filter(F.col("h").isNotNull()).select("review_id", "hunk_line", "h.*", "cand", "n_lines"))
    w = Window.partitionBy("review_id", "file_path").orderBy("hunk_line")
    return h.select("review_id", "file_path", F.row_number().over(w).alias("hunk_idx"), "hunk_line",
                    "header", "old_start", "hdr_old_count",
                    F.greatest("hdr_old_count", F.coalesce("cand", "hdr_old_count")).alias("old_count"),
                    "new_start", "new_count", "section", "n_lines", "header_position")


def diff_lines(diffs: DataFrame, mode: str = "ref", parsed: DataFrame | None = None) -> DataFrame:
    """Body lines with kind, content and numbers. mode='ref' numbers as the
    reference (per-file counters, context unnumbered); mode='git' gives the true
    new/old line of every line."""
    p = parsed if parsed is not None else parsed_diff(diffs)
    b = p.filter("is_body")
    if mode == "ref":
        nums = [F.col("ref_new_line").alias("new_line"), F.col("ref_old_line").alias("old_line")]
    elif mode == "git":
        nums = [F.col("new_line"), F.col("old_line")]
    else:
        raise ValueError("mode must be 'ref' or 'git'")
    return b.select("review_id", "file_path", "hunk_line", "line_no", "kind",
                    F.substring("line", 2, 1 << 30).alias("content"), *nums)


def diff_line_numbers(diffs: DataFrame, mode: str = "ref", chunk_lines: int | None = CHUNK_LINES) -> DataFrame:
    """`diff_lines` of diffs of any length."""
    return diff_lines(diffs, mode, parsed_diff(diffs, chunk_lines))


def hunk_old_count(diffs: DataFrame) -> DataFrame:
    return diff_hunks(diffs).select("review_id", "file_path", "hunk_idx", "hdr_old_count", "old_count")


def diff_stats(diffs: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Added and removed lines per file that has at least one hunk."""
    p = parsed if parsed is not None else parsed_diff(diffs)
    return (p.groupBy("review_id", "file_path")
            .agg(count_if(F.col("kind") == "+").alias("added"),
                 count_if(F.col("kind") == "-").alias("removed")))


def diff_totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("files_changed"),
        F.sum("added").cast("long").alias("total_additions"),
        F.sum("removed").cast("long").alias("total_deletions"))


def hunks_by_file(hunks: DataFrame) -> DataFrame:
    """File -> ordered list of its hunks, gathered per file."""
    return (hunks.groupBy("review_id", "file_path")
            .agg(F.array_sort(F.collect_list(F.struct(
                "hunk_idx", "header", "old_start", "old_count", "new_start", "new_count"))).alias("hunks")))


def changed_lines(lines_ref: DataFrame) -> DataFrame:
    """(new_line, content) of added lines only."""
    return lines_ref.filter(F.col("kind") == "+").select("review_id", "file_path", "hunk_line",
                                                         "new_line", "content")


def diff_walk(diffs: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Every non-removed body line with its true new-file line and its
    position in the file's unified diff (hunk headers count)."""
    p = parsed if parsed is not None else parsed_diff(diffs)
    return (p.filter(F.col("is_body") & (F.col("kind") != "-"))
            .select("review_id", "file_path", "hunk_line", "line_no", "kind",
                    F.substring("line", 2, 1 << 30).alias("content"), "new_line", "position",
                    "new_start", "new_count", "file_line"))


FINDING_KEY = ["review_id", "src_rank", "seq"]


def anchor_findings(findings: DataFrame, walk: DataFrame) -> DataFrame:
    """Adds `diff_position`: the position of the first non-removed line whose new
    line lies in [line_start, line_end], looking only in hunks that overlap the
    finding; null when none (fallback comment). A finding is (review_id, src_rank,
    seq); src_rank is 0 where the column is missing.

    An as-of lookup: lines and findings of a file section are sorted by line
    together, and each finding takes the next line at or after its start, which is
    then tested against its end. A line beyond its hunk's declared length is never
    the answer: a finding that overlaps the hunk and such a line also covers an
    earlier line. A path that occurs in several sections is looked up in each."""
    has_rank = "src_rank" in findings.columns
    f = findings if has_rank else findings.withColumn("src_rank", F.lit(0))
    lines = walk.filter(F.col("new_line") <= F.col("new_start") + F.col("new_count") - 1)
    where = ["review_id", "file_path", "file_line"]
    sections = lines.select(*where).distinct()
    probes = (f.select(*FINDING_KEY, "file_path", "line_start", "line_end").join(sections, ["review_id", "file_path"])
              .select(*where, F.col("line_start").cast("long").alias("at"), F.lit(1).alias("is_probe"), "src_rank", "seq",
                      F.col("line_end").cast("long").alias("until"), F.lit(None).cast("struct<line:long,position:long>").alias("hit")))
    none = F.lit(None)
    targets = lines.select(*where, F.col("new_line").cast("long").alias("at"), F.lit(0).alias("is_probe"),
                           none.cast(dict(f.dtypes)["src_rank"]).alias("src_rank"), none.cast(dict(f.dtypes)["seq"]).alias("seq"),
                           none.cast("long").alias("until"),
                           F.struct(F.col("new_line").cast("long").alias("line"), F.col("position").cast("long").alias("position")).alias("hit"))
    # from the last line back: the latest line seen is the next one at or after the probe;
    # of several lines with one number the first in the diff comes last
    back = (Window.partitionBy(*where).orderBy(F.desc("at"), "is_probe", F.desc("hit.position"))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = (targets.unionByName(probes).withColumn("next", F.last("hit", ignorenulls=True).over(back))
             .filter((F.col("is_probe") == 1) & (F.col("next.line") <= F.col("until")))
             .groupBy(*FINDING_KEY).agg(F.min("next.position").alias("diff_position")))
    out = f.join(found, FINDING_KEY, "left")
    return out if has_rank else out.drop("src_rank")
