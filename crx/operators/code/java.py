"""Java token table and lexical rules (§2.3, §2.5).

No Java parser is available, so sources are tokenised, on the JVM with
`regexp_extract_all` + `posexplode` (`java_tokens`) or by the same patterns in one pass
with what follows (`file_marks`), and structure is recovered from runs of tokens: bracket levels are running sums, a bracket's partner is the next
bracket at the same level (`lead` over (file, level)), and "inside a span" is a
prefix sum of +1/-1 marks, so no rule pairs tokens with spans.

These are LEXICAL APPROXIMATIONS of tree rules: positions are token lines
(the method name, the `class` keyword, the call name), a literal is a single
literal token (optionally signed), and comments, strings and text blocks are
told apart by one alternation over the whole file.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crx.operators.code.java_runs import Tokens, features, marked, texts_of, whole_files

# What may hide a comment's start, and comments: text blocks, strings, characters,
# line comments, block comments. The leftmost one wins, as in a Java lexer.
LITERAL_OR_COMMENT = (r'"""[\s\S]*?"""' r'|"(?:\\.|[^"\\\n])*+"' r"|'(?:\\.|[^'\\\n])*+'" r"|//[^\n]*+" r"|/\*[\s\S]*?\*/")
# The most common tokens first: no two of the first five begin alike.
TOKEN_RE = (r"[A-Za-z_$][A-Za-z0-9_$]*+|[(){};.,]|\d[A-Za-z0-9_.]*+" r'|"(?:\\.|[^"\\])*+"' r"|'(?:\\.|[^'\\])*+'" r"|//.*"
            r"|&&|\|\||==|!=|<=|>=|\+\+|--|->|::|\+=|-=|[^\s\w]")

# Java reserved words and primitive types.
KEYWORDS = ["abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class", "const", "continue",
            "default", "do", "double", "else", "enum", "extends", "final", "finally", "float", "for", "goto", "if",
            "implements", "import", "instanceof", "int", "interface", "long", "native", "new", "package", "private",
            "protected", "public", "return", "short", "static", "strictfp", "super", "switch", "synchronized",
            "this", "throw", "throws", "transient", "try", "void", "volatile", "while", "true", "false", "null"]
PRIMITIVES = ["boolean", "byte", "char", "short", "int", "long", "float", "double"]

# Vocabularies of the Java rules.
SQL_METHODS = ["executeQuery", "executeUpdate", "execute", "addBatch"]
DESERIAL_METHODS = ["readObject", "readUnshared"]
RESOURCE_TYPES = ["FileInputStream", "FileOutputStream", "FileReader", "FileWriter", "BufferedReader",
                  "BufferedWriter", "InputStreamReader", "OutputStreamWriter", "PrintWriter", "PrintStream",
                  "Socket", "ServerSocket"]
SECRET_WORDS = ["password", "passwd", "pwd", "secret", "api_key", "apikey", "api_token", "apitoken", "token",
                "access_key", "accesskey", "private_key", "privatekey", "credential"]
TEST_VALUES = ["", "test", "password", "secret", "changeme", "null", "example"]
COMPLEXITY_LIMIT = 10
LENGTH_LIMIT = 50

# Rule ids, severities, categories, titles and descriptions.
RULES = {
    "command_injection": ("java-command-injection", "critical", "security", "Runtime.exec() command injection risk",
                          "Using Runtime.exec() with untrusted input can lead to command injection. Use "
                          "ProcessBuilder with a list of arguments instead of passing a command string."),
    "unsafe_deserial": ("java-unsafe-deserial", "critical", "security", "Unsafe deserialization via ObjectInputStream",
                        "Deserializing untrusted data with ObjectInputStream can lead to remote code execution. "
                        "Validate or filter input before deserialization, or use a type-checking ObjectInputFilter."),
    "sql_concat": ("java-sql-concat", "warning", "security", "SQL string concatenation may cause SQL injection",
                   "Building SQL queries via string concatenation can lead to SQL injection. Use "
                   "PreparedStatement with parameterized queries instead."),
    "resource_leak": ("java-resource-leak", "warning", "best_practice", "Resource opened without try-with-resources",
                      "Opening a resource outside of try-with-resources may lead to resource leaks. Use "
                      "try-with-resources to ensure the resource is properly closed."),
    "hardcoded_secret": ("java-hardcoded-secret", "warning", "security", "Hardcoded secret in variable '{}'",
                         "Variable '{}' appears to contain a hardcoded secret. Use environment variables or a "
                         "secrets manager instead."),
    "complexity": ("java-complexity", "warning", "style", "High cyclomatic complexity ({}) in method '{}'",
                   "Method '{}' has a cyclomatic complexity of {} (threshold: {}). Consider refactoring into "
                   "smaller methods."),
    "method_length": ("java-method-length", "suggestion", "style", "Method '{}' is too long ({} lines)",
                      "Method '{}' spans {} lines (threshold: {}). Consider breaking it into smaller methods."),
    "unhandled_exception": ("java-unhandled-exception", "suggestion", "style",
                            "Exception thrown without handling",
                            "A throw statement is neither inside a try block nor declared with a throws clause "
                            "on its method. Handle the exception or declare it."),
}


def _fmt(template: str, *args: Column) -> Column:
    parts = template.split("{}")
    out: list[Column] = []
    for i, p in enumerate(parts):
        if p:
            out.append(F.lit(p))
        if i < len(parts) - 1:
            out.append(args[i].cast("string"))
    return F.concat(*out)


def _finding(df: DataFrame, key: str, title_args=(), desc_args=(), line_end: str = "line") -> DataFrame:
    rid, sev, cat, title, desc = RULES[key]
    return df.select("file_id", F.col("idx").alias("node_id"), F.lit(rid).alias("rule_id"),
                     F.lit(sev).alias("severity"), F.lit(cat).alias("category"), F.col("path").alias("file_path"),
                     F.col("line").alias("line_start"), F.col(line_end).alias("line_end"),
                     _fmt(title, *title_args).alias("title"), _fmt(desc, *desc_args).alias("description"))


def _blank_block_comments(text: Column) -> Column:
    """The source with comments replaced by the newlines they contain, and text
    blocks by one-line strings followed by theirs; strings stay. Line numbers stay."""
    pieces = F.arrays_zip(F.split(text, LITERAL_OR_COMMENT, -1).alias("gap"),
                          F.regexp_extract_all(text, F.lit(LITERAL_OR_COMMENT), F.lit(0)).alias("hit"))

    def newlines(hit: Column) -> Column:
        return F.regexp_replace(hit, "[^\n]+", "")

    def shown(p: Column) -> Column:
        hit = F.coalesce(p["hit"], F.lit(""))
        block = F.concat(F.lit('"'), F.regexp_replace(F.substring(hit, 4, 1 << 30), '["\\\\\n]', " "), F.lit('"'), newlines(hit))
        return F.concat(p["gap"], F.when(hit.startswith("/*") | hit.startswith("//"), newlines(hit))
                        .when(hit.startswith('"""'), block).otherwise(hit))
    return F.array_join(F.transform(pieces, shown), "")


def java_tokens(sources: DataFrame) -> DataFrame:
    """(file_id, path, idx, line, tok, kind). idx orders the tokens of a file
    (line in the high 32 bits, position in the line below); it is not dense,
    so neighbours are taken with lead/lag, never idx +/- 1, and no window is
    needed to number the tokens."""
    content = F.col("content")
    odd = (F.instr(content, "/*") > 0) | (F.instr(content, '"""') > 0)
    text = F.when(odd, _blank_block_comments(content)).otherwise(content)
    lines = sources.select("file_id", "path", F.posexplode(F.split(text, "\n", -1)).alias("ln", "text"))
    toks = lines.select("file_id", "path", (F.col("ln") + 1).alias("line"),
                        F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN_RE), 0)).alias("col", "tok"))
    toks = toks.filter(~F.col("tok").startswith("//"))
    t = F.col("tok")
    first = F.ascii(t)  # its code point

    def within(a: str, b: str) -> Column:
        return first.between(ord(a), ord(b))
    word = within("a", "z") | within("A", "Z") | first.isin(ord("_"), ord("$"))
    kind = (F.when(word, F.when(~within("a", "z"), "ident").when(t.isin("true", "false", "null"), "literal").when(t.isin(KEYWORDS), "keyword").otherwise("ident"))
             .when(first.isin(ord('"'), ord("'")), "string").when(within("0", "9"), "number").otherwise("op"))
    idx = F.shiftleft(F.col("line").cast("long"), 32) + F.col("col").cast("long")
    return toks.select("file_id", "path", idx.alias("idx"), "line", "tok", kind.alias("kind"))


def _is_literal(kind: Column) -> Column:
    return kind.isin("string", "number", "literal")


_FEATURES = ["file_id", "path", "idx", "line", "tok", "kind", "prev", "prev_kind", "prev2", "next", "next_kind", "next2", "next2_kind", "next3", "prev_line",
             "next_idx", "pd", "bd", "plevel", "blevel", "pmatch", "after_close", "after_close_idx", "bmatch"]


def _bracket_levels(f: DataFrame) -> DataFrame:
    """Level of a bracket: after opening for an opener, before closing for a closer."""
    t = F.col("tok")
    return (f.withColumn("plevel", F.when(t == "(", F.col("pd")).when(t == ")", F.col("pd") + 1))
            .withColumn("blevel", F.when(t == "{", F.col("bd")).when(t == "}", F.col("bd") + 1))
            .withColumn("_bk", F.when(t.isin("(", ")"), F.lit("p")).when(t.isin("{", "}"), F.lit("b")))
            .withColumn("_lv", F.coalesce(F.col("plevel"), F.col("blevel"))))


def _with_partners(f: DataFrame, after: Column, before: Column) -> DataFrame:
    """From the next and previous bracket of the same kind and level: the partner; for
    '(' also the token after its ')'; for '}' whether its '{' follows `do`."""
    t = F.col("tok")
    pair, block = (t == "(") & (after["tok"] == ")"), (t == "{") & (after["tok"] == "}")
    return f.select(
        "*", F.when(pair, after["idx"]).alias("pmatch"), F.when(pair, after["next"]).alias("after_close"),
        F.when(pair, after["next_idx"]).alias("after_close_idx"), F.when(block, after["idx"]).alias("bmatch"),
        ((t == "}") & (before["tok"] == "{") & (before["prev"] == "do")).alias("_do_close"))


def _running() -> tuple[dict[str, Column], dict[str, Column], dict[str, Column]]:
    """What rules and structure share: running counts, the last place of a token up to
    here, and before here."""
    t, prev = F.col("tok"), F.coalesce(F.col("prev"), F.lit(""))
    one = lambda c: F.when(c, 1).otherwise(0)
    is_class = (t == "class") & (F.col("next_kind") == "ident") & (prev != ".")
    counts = {"C": _decision_weight(), "plus_pc": one(t == "+"), "nonlit_pc": one(~_is_literal(F.col("kind")) & ~t.isin(",", "-", "+")),
              "binop_pc": one(t.isin("-", "+") & ~prev.isin("(", ",")), "ad": F.when(t == "<", 1).when(t == ">", -1).otherwise(0)}
    places = {"class_last": is_class, "lbrace_last": t == "{", "import_last": t == "import", "semi_last": t == ";"}
    return counts, places, {"rparen_before": t == ")", "stmt_end_before": t.isin(";", "{", "}")}


_LONGS = ["pd", "bd", "plevel", "blevel", "pmatch", "after_close_idx", "bmatch", "next_idx"]
_RUNNING = ["C", "plus_pc", "nonlit_pc", "binop_pc", "ad", "class_last", "lbrace_last", "import_last", "semi_last", "rparen_before", "stmt_end_before"]
# of an identifier before '(': that list's partner, the token after it, the list's level and
# angle depth, '+' before the list and tokens in it; the '{' that follows, its partner,
# the decisions and the last line between
_CALLED = ["call_close", "call_after", "list_level", "list_ad", "plus_at", "args_plus", "args_nonlit", "args_binop", "body_open", "body_close",
           "body_decides", "body_last"]
# of an import: its tokens joined; of a class: its bases; of a declared name: its parameters'
# names and its annotations
_OWNED = {"import_text": "string", "bases": "array<string>", "args": "array<string>", "annotated": "array<string>"}
_ALL = [*_FEATURES, *_RUNNING, *_CALLED, *_OWNED]


def token_features(tokens: DataFrame) -> DataFrame:
    """Neighbours, bracket levels and partners, and the running counts and
    positions the rules share, of tokens as `java_tokens` gives them: a file's in
    one partition, one after another. They pass once through numpy, many files at
    a time (`java_runs`), without a shuffle, sort or window. `chunked_features`
    gives the same rows for tokens that lie in any way, and spreads a file."""
    columns = ["file_id", "path", "idx", "line", "tok", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_files(batches):
            t = Tokens.of_rows(batch)
            found = dict(zip(columns, batch.columns, strict=True)) | {c: column(t.at) for c, column in features(t, PRIMITIVES)[0].items()}
            yield pa.RecordBatch.from_arrays([found[c] for c in _ALL], _ALL)
    return tokens.select(*columns).mapInArrow(run, _typed(tokens, _ALL))


def _typed(given: DataFrame, columns: list[str]) -> str:
    kinds = {c: "string" for c in _FEATURES} | {c: "bigint" for c in ["idx", *_LONGS, *_RUNNING, *_CALLED]} | {"line": "int", "prev_line": "int", "body_last": "int", "call_after": "string"}
    kinds |= _OWNED | {f.name: f.dataType.simpleString() for f in given.schema}
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def file_marks(sources: DataFrame) -> DataFrame:
    """`rule_marks(token_features(java_tokens(sources)))` in one pass over the files: their
    text is handed over once, is cut into tokens, and only the rows kept, with the columns
    kept, come back."""
    columns = [c for c in _ALL if c not in _UNREAD]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, paths, texts in texts_of(batches):
            t = Tokens.of_texts(texts, frozenset(KEYWORDS))
            found, declares = features(t, PRIMITIVES)
            marks = marked(t, declares, RESOURCE_TYPES, ["exec", *SQL_METHODS])
            at = np.flatnonzero(marks["kept"])
            file = pa.array(t.file[at])
            rows = {"file_id": ids.take(file), "path": paths.take(file), "idx": t.idx.take(pa.array(at)), "line": t.line.take(pa.array(at)), "tok": t.words(at), "kind": t.words(at, "kind")}
            for c in columns[len(rows):]:
                rows[c] = found[c](at)
                if c in _READ:
                    rows[c] = pc.if_else(pa.array(np.logical_or.reduce([marks[n][at] for n in _READ[c]])), rows[c], pa.scalar(None, rows[c].type))
            yield pa.RecordBatch.from_arrays([rows[c] for c in columns], columns)
    return sources.select("file_id", "path", "content").mapInArrow(run, _typed(sources.select("file_id", "path"), columns))


CHUNK_LINES = 4_096
LARGE_CHARS = 1_000_000  # files beyond it are scanned in chunks


def chunked_features(tokens: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """`token_features` of files of any length: the same rows and columns, with the
    windows over a file replaced by windows over chunks of its lines and over
    summaries of the chunks.

    Three summaries carry what a chunk needs from the others: the tokens next to its
    ends and the bracket depths before it; the first and last bracket of each kind and
    level, for partners in other chunks; the running counts and last places before it. A
    summary has one row per chunk, or per bracket level in it, so windows over a file
    see chunks, not tokens."""
    t, here = F.col("tok"), ["file_id", "_chunk"]
    rows = tokens.withColumn("_chunk", F.floor(F.col("line") / chunk_lines).cast("long"))
    w = Window.partitionBy(*here).orderBy("idx")
    run, back = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    chunks = Window.partitionBy("file_id").orderBy("_chunk")
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
    none = F.array().cast("array<struct<idx:long,line:int,tok:string,kind:string>>")
    me = F.struct("idx", "line", "tok", "kind")

    def depth(opening: str, closing: str) -> Column:
        return F.when(t == opening, 1).when(t == closing, -1).otherwise(0)

    def gathered(missing: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col(missing).isNull(), me)))

    def near(column: str, steps: int, move) -> list[Column]:
        return [F.coalesce(move(column, i).over(chunks), none) for i in range(1, steps + 1)]

    # 1: neighbours and depths; a chunk's first three and last two tokens
    f = rows.select("*", *[F.lag(me, i).over(w).alias(f"_p{i}") for i in (1, 2, 3)], *[F.lead(me, i).over(w).alias(f"_n{i}") for i in (1, 2, 3)],
                    F.sum(depth("(", ")")).over(run).alias("_pd"), F.sum(depth("{", "}")).over(run).alias("_bd"))
    ends = f.groupBy(*here).agg(gathered("_p3").alias("_head"), gathered("_n2").alias("_tail"),
                                F.sum(depth("(", ")")).alias("_ps"), F.sum(depth("{", "}")).alias("_bs"))
    ends = ends.select(
        *here, F.reverse(F.concat(*reversed(near("_tail", 2, F.lag)))).alias("_before"), F.concat(*near("_head", 3, F.lead)).alias("_after"),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_in") for c in ("_ps", "_bs")])
    f = f.join(ends, here)
    b, a = (lambda i: F.get("_before", F.lit(i))), (lambda i: F.get("_after", F.lit(i)))
    p1, n1 = F.coalesce("_p1", b(0)), F.coalesce("_n1", a(0))
    p2 = F.coalesce("_p2", F.when(F.col("_p1").isNotNull(), b(0)).otherwise(b(1)))
    n2 = F.coalesce("_n2", F.when(F.col("_n1").isNotNull(), a(0)).otherwise(a(1)))
    n3 = F.coalesce("_n3", F.when(F.col("_n2").isNotNull(), a(0)).when(F.col("_n1").isNotNull(), a(1)).otherwise(a(2)))
    f = f.select(*tokens.columns, "_chunk", p1["tok"].alias("prev"), p1["kind"].alias("prev_kind"), p2["tok"].alias("prev2"), n1["tok"].alias("next"),
                 n1["kind"].alias("next_kind"), n2["tok"].alias("next2"), n2["kind"].alias("next2_kind"), n3["tok"].alias("next3"), p1["line"].alias("prev_line"),
                 n1["idx"].alias("next_idx"), (F.col("_ps_in") + F.col("_pd")).alias("pd"), (F.col("_bs_in") + F.col("_bd")).alias("bd"))
    f = _bracket_levels(f)
    # 2: partners inside the chunk; a level's first and last bracket for those in others
    level = ["file_id", "_bk", "_lv"]
    inside = Window.partitionBy(*here, "_bk", "_lv").orderBy("idx")
    mark = F.struct("tok", "idx", "next", "next_idx", "prev")
    f = f.withColumns({"_after": F.lead(mark).over(inside), "_before": F.lag(mark).over(inside)})
    across = Window.partitionBy(*level).orderBy("_chunk")
    edges = (f.filter(F.col("_bk").isNotNull()).groupBy(*level, "_chunk").agg(F.min_by(mark, "idx").alias("_first"), F.max_by(mark, "idx").alias("_last"))
             .select(*level, "_chunk", F.lead("_first").over(across).alias("_first_after"), F.lag("_last").over(across).alias("_last_before")))
    f = f.join(edges, [*level, "_chunk"], "left")
    f = _with_partners(f, F.coalesce("_after", "_first_after"), F.coalesce("_before", "_last_before"))
    # 3: running counts and last places
    counts, places, places_before = _running()
    f = f.withColumns({f"_in_{n}": F.sum(c).over(run) for n, c in counts.items()}
                      | {f"_in_{n}": F.max(F.when(c, F.col("idx"))).over(run) for n, c in places.items()}
                      | {f"_in_{n}": F.max(F.when(c, F.col("idx"))).over(back) for n, c in places_before.items()})
    sums = f.groupBy(*here).agg(*[F.sum(c).alias(n) for n, c in counts.items()],
                                *[F.max(F.when(c, F.col("idx"))).alias(n) for n, c in (places | places_before).items()])
    sums = sums.select(*here, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_to_{n}") for n in counts],
                       *[F.max(n).over(earlier).alias(f"_to_{n}") for n in places | places_before])
    f = f.join(sums, here)
    f = f.select(*_FEATURES, *[(F.col(f"_to_{n}") + F.col(f"_in_{n}")).alias(n) for n in counts],
                 *[F.coalesce(f"_in_{n}", f"_to_{n}").alias(n) for n in places | places_before])
    return _with_owned(_with_lists(f)).select(*_ALL)


def _with_lists(f: DataFrame) -> DataFrame:
    """The columns of `_CALLED`, by joins. A body is the '{' whose latest ')' before it is
    the list's with no ';' / '{' / '}' in between (a throws list may sit there)."""
    t, idx = F.col("tok"), F.col("idx")
    called = f.filter((F.col("kind") == "ident") & (F.col("next") == "(")).select("file_id", "idx", "next_idx")
    opening = f.filter(t == "(").select("file_id", idx.alias("next_idx"), F.col("pmatch").alias("call_close"), F.col("after_close").alias("call_after"),
                                        F.col("plevel").alias("list_level"), F.col("ad").alias("list_ad"), F.col("plus_pc").alias("plus_at"),
                                        F.col("nonlit_pc").alias("_n"), F.col("binop_pc").alias("_b"))
    # counts at the ')' include the ')' itself (one non-literal token)
    closing = f.filter(t == ")").select("file_id", idx.alias("call_close"), F.col("plus_pc").alias("_p1"), (F.col("nonlit_pc") - 1).alias("_n1"),
                                        F.col("binop_pc").alias("_b1"))
    bodies = (f.filter((t == "{") & F.col("rparen_before").isNotNull() & (F.coalesce("stmt_end_before", F.lit(-1)) < F.col("rparen_before")))
              .select("file_id", F.col("rparen_before").alias("call_close"), idx.alias("body_open"), F.col("bmatch").alias("body_close"), F.col("C").alias("_c")))
    ends = f.filter(t == "}").select("file_id", idx.alias("body_close"), F.col("C").alias("_c1"), F.col("prev_line").alias("body_last"))
    lists = (called.join(opening, ["file_id", "next_idx"]).join(closing, ["file_id", "call_close"], "left").join(bodies, ["file_id", "call_close"], "left")
             .join(ends, ["file_id", "body_close"], "left").withColumns({"args_plus": F.col("_p1") - F.col("plus_at"), "args_nonlit": F.col("_n1") - F.col("_n"),
                                                                         "args_binop": F.col("_b1") - F.col("_b"), "body_decides": F.col("_c1") - F.col("_c")}))
    return f.join(lists.select("file_id", "idx", *_CALLED), ["file_id", "idx"], "left")


def _with_owned(f: DataFrame) -> DataFrame:
    """The columns of `_OWNED`: what opens and closes them and what may stand in them, a
    small union, is put in order once, then gathered by owner and joined on."""
    t, ident, prev = F.col("tok"), F.col("kind") == "ident", F.coalesce(F.col("prev"), F.lit(""))
    is_class = (t == "class") & (F.col("next_kind") == "ident") & (prev != ".")
    flags = {"_import": _in_import() & (t != "static"), "_base": _in_class_header() & ident & prev.isin("extends", "implements", ","), "_class": is_class,
             "_named": ident & F.coalesce(F.col("next").isin(",", ")"), F.lit(False)), "_mark": ident & (prev == "@"), "_declared": _declares()}
    rows = f.select("file_id", "idx", "tok", "pd", "ad", "import_last", "class_last", "stmt_end_before", "next_idx", "call_close", "list_level", "list_ad",
                    *[c.alias(n) for n, c in flags.items()]).filter(" OR ".join(flags))
    # the row itself, and the brackets of a declared list
    opened = F.struct(F.col("idx").alias("name_idx"), "list_level", "list_ad")
    events = [F.struct(F.col("idx").alias("at"), F.lit(0).alias("m"), F.lit(None).cast("struct<name_idx:bigint,list_level:bigint,list_ad:bigint>").alias("list"))]
    events += [F.when(F.col("_declared"), F.struct(F.col(c).alias("at"), F.lit(m).alias("m"), F.when(F.lit(m > 0), opened).alias("list")))
               for c, m in (("next_idx", 1), ("call_close", -1))]
    rows = rows.withColumn("_e", F.explode(F.filter(F.array(*events), lambda e: e.isNotNull())))
    upto = Window.partitionBy("file_id").orderBy("_e.at", F.desc("_e.m")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_open": F.sum("_e.m").over(upto), "_list": F.last("_e.list", ignorenulls=True).over(upto),
                             "_ad0": F.last(F.when(F.col("_class"), F.col("ad")), ignorenulls=True).over(upto)}).filter("_e.m = 0")
    # annotations: '@' names in the member's header (same statement, before the name)
    header = Window.partitionBy("file_id", "stmt_end_before").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_marks", F.collect_list(F.when(F.col("_mark"), t)).over(header))
    # bases stand at their class's angle depth, parameters directly in the list opened last
    inside = (F.col("_open") > 0) & (F.col("pd") == F.col("_list.list_level")) & (F.col("ad") == F.col("_list.list_ad"))
    held = [("import_text", F.col("_import"), F.col("import_last")), ("bases", F.col("_base") & (F.col("ad") == F.col("_ad0")), F.col("class_last")),
            ("args", F.col("_named") & inside, F.col("_list.name_idx")), ("annotated", F.col("_declared") & F.col("stmt_end_before").isNotNull(), F.col("idx"))]
    rows = rows.withColumn("_h", F.explode(F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("kind"), owner.alias("idx"))) for n, c, owner in held]),
                                                    lambda h: h.isNotNull())))

    def gathered(name: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("_h.kind") == name, F.struct("idx", "tok"))))["tok"]
    owned = rows.groupBy("file_id", F.col("_h.idx").alias("_owner")).agg(
        *[gathered(n).alias(n) for n, _, _ in held[:3]], F.first(F.when(F.col("_h.kind") == "annotated", F.col("_marks")), ignorenulls=True).alias("annotated"))
    owned = owned.select("file_id", F.col("_owner").alias("idx"), F.when(F.size("import_text") > 0, F.array_join("import_text", "")).alias("import_text"),
                         *[F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("bases", "args", "annotated")])
    return f.join(owned, ["file_id", "idx"], "left")


# Columns that rules and structure read on some tokens only, and on none.
_READ = ({"prev_kind": ("called", "assigned", "plus"), "next_kind": ("class", "plus"), "prev2": ("plus",), "next2": ("counted", "assigned", "plus"),
          "next2_kind": ("assigned",), "next3": ("assigned",), "plus_pc": ("plus",)}
         | {c: ("counted",) for c in ("call_close", "plus_at", "args_plus", "args_nonlit", "args_binop")}
         | {c: ("declared",) for c in ("list_level", "body_open", "body_close", "body_decides", "body_last")})
_UNREAD = ["bd", "pd", "plevel", "blevel", "prev_line", "next_idx", "C", "nonlit_pc", "binop_pc", "ad", "after_close", "rparen_before", "class_last", "lbrace_last",
           "import_last", "semi_last", "stmt_end_before", "list_ad"]


def rule_marks(feat: DataFrame) -> DataFrame:
    """Of the feature rows, those that a rule or the structure reads, each with the columns
    read on a token of its kind (others are null): what is worth keeping of a scan. Rules
    and structure give the same rows on it as on all tokens."""
    t, prev, nxt = F.col("tok"), F.coalesce(F.col("prev"), F.lit("")), F.coalesce(F.col("next"), F.lit(""))
    ident = F.col("kind") == "ident"
    assigned = ident & (nxt == "=") & _is_literal(F.col("next2_kind")) & F.col("next3").isin(";", ",")
    plus = (t == "+") & _is_literal(F.col("prev_kind")) & _is_literal(F.col("next_kind"))
    called, declared, counted = ident & (nxt == "(") & (prev != "new"), _declares(), t.isin("exec", *SQL_METHODS)
    opened = ((t == "(") & (prev == "try")) | ((t == "{") & prev.isin("try", ")"))
    kept = opened | t.isin("import", "throw") | ((t == "new") & nxt.isin(RESOURCE_TYPES)) | ((t == "class") & (F.col("next_kind") == "ident")) | called | assigned | plus
    of = {"called": called, "assigned": assigned, "plus": plus, "counted": counted, "declared": declared, "class": t == "class"}
    read = {c: reduce(lambda a, b: a | b, [of[n] for n in names]) for c, names in _READ.items()}
    kept_rows = feat.filter(kept)
    return kept_rows.select(*[F.when(read[c], F.col(c)).alias(c) if c in read else F.col(c) for c in kept_rows.columns if c not in _UNREAD])


def _in_import() -> Column:
    """Tokens of an import statement: after an `import` with no ';' since it."""
    return (F.col("import_last").isNotNull() & (F.col("idx") > F.col("import_last"))
            & (F.col("semi_last").isNull() | (F.col("semi_last") < F.col("import_last"))))


def _in_class_header() -> Column:
    """Tokens after a class keyword, before the next '{'."""
    return (F.col("class_last").isNotNull() & (F.col("idx") > F.col("class_last"))
            & (F.col("lbrace_last").isNull() | (F.col("lbrace_last") < F.col("class_last"))))


def _declares() -> Column:
    """An identifier before '(' whose matching ')' is followed by '{', 'throws' or
    (abstract) ';' after a type."""
    prev = F.col("prev")
    typeish = F.col("prev_kind").isin("ident") | prev.isin(PRIMITIVES + ["void", ">", "]"])
    ctor_ctx = F.coalesce(prev, F.lit("")).isin("public", "private", "protected", "{", "}", ";", "")
    decl = (F.col("call_after").isin("{", "throws") & (typeish | ctor_ctx)) | ((F.col("call_after") == ";") & typeish & (prev != "return"))
    named = (F.col("kind") == "ident") & (F.col("next") == "(") & ~F.coalesce(prev, F.lit("")).isin("new", ".", "::")
    return F.coalesce(named & decl & (prev != "return") & (prev != "else"), F.lit(False))


def java_methods(feat: DataFrame) -> DataFrame:
    """Method and constructor declarations, rows of their names.
    Output: name, line, level of the parameter list, its names and annotations, body
    braces, decisions and last line of the body."""
    body = F.col("call_after").isin("{", "throws")
    return feat.filter(_declares()).select(
        "file_id", "path", F.col("idx").alias("name_idx"), F.col("tok").alias("name"), "line", "prev",
        F.col("call_after").alias("after_close"), *[F.when(body, F.col(c)).alias(c) for c in ("body_open", "body_close", "body_decides", "body_last")],
        (F.col("call_after") == "throws").alias("has_throws"), "list_level", "args", "annotated")


def _decision_weight() -> Column:
    """+1 at if/for/while/do/catch/&&/||/case groups/ternaries; the '}' that
    closes a do-block and is followed by `while` carries -1, so the loop's
    closing `while` does not count twice."""
    t, prev, nxt = F.col("tok"), F.coalesce(F.col("prev"), F.lit("")), F.coalesce(F.col("next"), F.lit(""))
    case_group = (t == "case") & (prev != ":") | ((t == "default") & (nxt == ":") & (prev != ":"))
    ternary = (t == "?") & ~prev.isin("<", ",") & ~nxt.isin(">", "extends", "super", ",")
    return (F.when(t.isin("if", "for", "while", "do", "catch", "&&", "||") | case_group | ternary, 1)
             .when(F.col("_do_close") & (nxt == "while"), -1).otherwise(0))


def java_complexity(feat: DataFrame, methods: DataFrame) -> DataFrame:
    """1 + decision tokens and && / || inside each method body (nested
    bodies included), from the running count at the two braces."""
    return methods.withColumn("complexity", (F.coalesce("body_decides", F.lit(0)) + 1).cast("int"))


def _calls(feat: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Method invocations: identifier + '(' that is not a declaration, not a
    constructor call and not a keyword construct."""
    c = feat.filter((F.col("kind") == "ident") & (F.col("next") == "(")
                    & ~F.coalesce(F.col("prev"), F.lit("")).isin("new") & ~_declares())
    return c if names is None else c.filter(F.col("tok").isin(names))


def _call_args(calls: DataFrame) -> DataFrame:
    """Per call: argument token count, whether every argument token is a
    (signed) literal, and the number of '+' tokens in the argument span, from
    the running counts at the two parentheses (no call x token pairs)."""
    return calls.filter(F.col("call_close").isNotNull()).select(
        "file_id", "path", "idx", "tok", "line", "plus_at", F.when(F.col("next2") != ")", 1).otherwise(0).alias("n_arg_tokens"),
        F.col("args_plus").alias("n_plus"), (F.col("args_nonlit") == 0).alias("all_literal_tokens"), F.col("args_binop").alias("n_binop"))


def rule_java_command_injection(feat: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    c = _call_args(_calls(feat, ["exec"]))
    unsafe = (F.col("n_arg_tokens") > 0) & ~(F.col("all_literal_tokens") & (F.col("n_binop") == 0))
    return _finding(c.filter(unsafe), "command_injection")


def rule_java_unsafe_deserial(feat: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    return _finding(_calls(feat, DESERIAL_METHODS), "unsafe_deserial")


def rule_java_sql_concat(feat: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """A '+' in the arguments, unless it is a single '+' between two literal
    tokens that make up the whole argument."""
    c = _call_args(_calls(feat, SQL_METHODS))
    lit_plus = feat.filter((F.col("tok") == "+") & _is_literal(F.col("prev_kind")) & _is_literal(F.col("next_kind"))
                           & F.col("prev2").isin("(", ",") & F.col("next2").isin(")", ",")).select("file_id", F.col("plus_pc").alias("nth"))
    lit_pair = (c.filter(F.col("n_plus") == 1).select("file_id", "idx", (F.col("plus_at") + 1).alias("nth"))
                .join(lit_plus, ["file_id", "nth"]).select("file_id", "idx"))
    flagged = c.filter(F.col("n_plus") >= 1).join(lit_pair, ["file_id", "idx"], "left_anti")
    return _finding(flagged, "sql_concat")


def _inside_marks(probes: DataFrame, opens: DataFrame, name: str) -> DataFrame:
    """For each probe token (file_id, idx, ...), whether it lies strictly inside
    one of the spans (open_idx, close_idx). The probes and the +1/-1 marks are
    unioned and a running sum is taken over that small union only."""
    marks = (opens.select("file_id", F.col("open_idx").alias("idx"), F.lit(1).alias("m"))
             .unionByName(opens.select("file_id", F.col("close_idx").alias("idx"), F.lit(-1).alias("m"))))
    ev = probes.select("file_id", "idx", F.lit(0).alias("m"), F.lit(True).alias("_probe")).unionByName(
        marks.withColumn("_probe", F.lit(False)))
    w = Window.partitionBy("file_id").orderBy("idx", "_probe").rowsBetween(Window.unboundedPreceding, -1)
    ev = ev.withColumn(name, F.coalesce(F.sum("m").over(w), F.lit(0)) > 0)
    return ev.filter("_probe").select("file_id", "idx", name)


def rule_java_resource_leak(feat: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """`new` of a resource type not inside a try-with-resources header."""
    tr = feat.filter((F.col("tok") == "(") & (F.col("prev") == "try")).select(
        "file_id", F.col("idx").alias("open_idx"), F.col("pmatch").alias("close_idx"))
    news = feat.filter((F.col("tok") == "new") & F.col("next").isin(RESOURCE_TYPES))
    inside = _inside_marks(news, tr, "in_try_res")
    return _finding(news.join(inside, ["file_id", "idx"]).filter(~F.col("in_try_res")), "resource_leak")


def rule_java_hardcoded_secret(feat: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """A declared variable (type before the name) whose name contains a secret
    word, initialised by one literal token (numbers count); the value, with
    quotes stripped, is longer than one character and not a test value."""
    typeish = (F.col("prev_kind") == "ident") | F.col("prev").isin(PRIMITIVES + [">", "]"])
    d = feat.filter((F.col("kind") == "ident") & (F.col("next") == "=") & typeish
                    & _is_literal(F.col("next2_kind")))
    d = d.filter(F.col("next3").isin(";", ","))
    words = F.array(*[F.lit(w) for w in SECRET_WORDS])
    value = F.regexp_replace(F.regexp_replace(F.col("next2"), '^"+|"+$', ""), "^'+|'+$", "")
    d = d.filter(F.exists(words, lambda w: F.instr(F.lower(F.col("tok")), w) > 0)
                 & ~F.lower(value).isin(TEST_VALUES) & (F.length(value) > 1))
    return _finding(d, "hardcoded_secret", [F.col("tok")], [F.col("tok")])


def _method_rows(feat: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    m = methods if methods is not None else java_methods(feat)
    return java_complexity(feat, m).withColumns({"end_line": F.col("body_last"), "idx": F.col("name_idx")})


def _method_findings(feat: DataFrame, methods: DataFrame | None, keys: list[str],
                     complexity_limit: int = COMPLEXITY_LIMIT, length_limit: int = LENGTH_LIMIT) -> DataFrame:
    """Findings of the named method rules (complexity, method_length), one pass over
    the methods. A method's length is the last token line of its body minus its
    start line (no +1)."""
    m = _method_rows(feat, methods).withColumn("span", F.col("end_line") - F.col("line"))
    name, cx, span = F.col("name"), F.col("complexity"), F.col("span")
    rules = {"complexity": (cx > complexity_limit, F.col("line"), [cx, name], [name, cx, F.lit(complexity_limit)]),
             "method_length": (span > length_limit, F.col("end_line"), [name, span], [name, span, F.lit(length_limit)])}
    found = []
    for key in keys:
        when, line_end, title_args, desc_args = rules[key]
        rid, sev, cat, title, desc = RULES[key]
        found.append(F.when(when, F.struct(
            F.lit(rid).alias("rule_id"), F.lit(sev).alias("severity"), F.lit(cat).alias("category"), line_end.alias("line_end"),
            _fmt(title, *title_args).alias("title"), _fmt(desc, *desc_args).alias("description"))))
    hits = m.withColumn("_f", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())))
    return hits.select("file_id", F.col("idx").alias("node_id"), "_f.rule_id", "_f.severity", "_f.category", F.col("path").alias("file_path"),
                       F.col("line").alias("line_start"), "_f.line_end", "_f.title", "_f.description")


def rule_java_complexity(feat: DataFrame, methods: DataFrame | None = None,
                         limit: int = COMPLEXITY_LIMIT) -> DataFrame:
    return _method_findings(feat, methods, ["complexity"], complexity_limit=limit)


def rule_java_method_length(feat: DataFrame, methods: DataFrame | None = None,
                            limit: int = LENGTH_LIMIT) -> DataFrame:
    return _method_findings(feat, methods, ["method_length"], length_limit=limit)


def rule_java_methods(feat: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """Complexity and length of methods together."""
    return _method_findings(feat, methods, ["complexity", "method_length"])


def rule_java_unhandled_exception(feat: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """`throw` whose innermost enclosing method has no throws clause and that
    is not inside a try block. Computed over a small event union per file
    (method body opens/closes, try block opens/closes, throw tokens): the
    method depth at a token is a running sum, and the innermost enclosing
    method of a token at depth d is the latest method opened at level d."""
    m = (methods if methods is not None else java_methods(feat)).filter(F.col("body_open").isNotNull())
    throws = feat.filter(F.col("tok") == "throw").select("file_id", "idx", "path", "line")
    opens = m.select("file_id", F.col("body_open").alias("idx"), F.lit(1).alias("m"),
                     F.col("has_throws").alias("mthrows"))
    closes = m.select("file_id", F.col("body_close").alias("idx"), F.lit(-1).alias("m"),
                      F.lit(None).cast("boolean").alias("mthrows"))
    ev = (throws.select("file_id", "idx", F.lit(0).alias("m"), F.lit(None).cast("boolean").alias("mthrows"))
          .unionByName(opens).unionByName(closes))
    w = Window.partitionBy("file_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("depth", F.sum("m").over(w))
    lw = Window.partitionBy("file_id", "depth").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("enclosing_throws", F.last("mthrows", ignorenulls=True).over(lw))
    th = ev.filter((F.col("m") == 0) & (F.col("depth") > 0)).select("file_id", "idx", "enclosing_throws")
    # try blocks: the '{' after `try` or after a try-with-resources header
    try_open = feat.filter((F.col("tok") == "{") & ((F.col("prev") == "try") | (F.col("prev") == ")")))
    tr_close = feat.filter((F.col("tok") == "(") & (F.col("prev") == "try")).select(
        "file_id", F.col("after_close_idx").alias("idx"))
    res_open = try_open.filter(F.col("prev") == ")").join(tr_close, ["file_id", "idx"], "left_semi")
    tb = (try_open.filter(F.col("prev") == "try").unionByName(res_open)
          .select("file_id", F.col("idx").alias("open_idx"), F.col("bmatch").alias("close_idx")))
    in_try = _inside_marks(th, tb, "in_try")
    out = (th.join(in_try, ["file_id", "idx"]).join(throws, ["file_id", "idx"])
           .filter(~F.col("in_try") & ~F.coalesce(F.col("enclosing_throws"), F.lit(False))))
    return _finding(out, "unhandled_exception")


JAVA_RULES = [rule_java_command_injection, rule_java_unsafe_deserial, rule_java_sql_concat,
              rule_java_resource_leak, rule_java_hardcoded_secret, rule_java_methods, rule_java_unhandled_exception]


def rule_scan_java(feat: DataFrame) -> DataFrame:
    """All Java rules; the declarations they share are rows of the table."""
    methods = java_methods(feat)
    return reduce(lambda a, b: a.unionByName(b), [r(feat, methods) for r in JAVA_RULES])


def java_structure(feat: DataFrame, methods: DataFrame | None = None) -> dict[str, DataFrame]:
    """imports, classes (bases: extends first, then implements), methods and
    constructors (parameter names, return type), calls. Lines are token lines;
    line_end = line_start and complexity 1, as the reference. Everything is a
    filter on the feature table: what a statement holds stands on its first row."""
    t, none = F.col("tok"), F.array().cast("array<string>")
    imports = feat.filter((t == "import") & F.col("import_text").isNotNull()).select(
        "file_id", "path", F.col("idx").alias("seq"), "line", F.regexp_replace("import_text", r"\.\*$", "").alias("import_path"))
    m = methods if methods is not None else java_methods(feat)
    # constructors carry no annotations, as in the reference
    typeish = F.col("prev").isin(*PRIMITIVES, "void", ">", "]") | (
        ~F.col("prev").isin("public", "private", "protected", "{", "}", ";") & F.col("prev").rlike(r"^[A-Za-z_$]"))
    annotations = F.transform("annotated", lambda a: F.concat(F.lit("@"), a))
    meths = m.select("file_id", "path", "name_idx", "name", F.col("line").alias("line_start"),
                     F.col("line").alias("line_end"),
                     F.coalesce("args", none).alias("args"),
                     F.when(F.col("prev").isin("void", "public", "private", "protected", "{", "}", ";"), F.lit(None))
                      .when(F.col("prev").isin(">", "]"), F.lit(None)).otherwise(F.col("prev")).alias("returns"),
                     F.when(typeish, F.coalesce(annotations, none)).otherwise(none).alias("annotations"),
                     F.lit(1).alias("complexity"))
    cls = feat.filter((t == "class") & (F.col("next_kind") == "ident") & ~F.coalesce(F.col("prev"), F.lit("")).isin("."))
    classes = cls.select("file_id", F.col("idx").alias("class_idx"), "path", F.col("next").alias("name"),
                         F.col("line").alias("line_start"), F.col("line").alias("line_end"), F.coalesce("bases", none).alias("bases"))
    calls = _calls(feat).select("file_id", "path", F.col("idx").alias("seq"), F.col("tok").alias("member"),
                                         F.col("line"))
    return {"imports": imports, "methods": meths, "classes": classes, "calls": calls}
