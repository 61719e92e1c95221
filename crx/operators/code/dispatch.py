"""Language detection, the extractor registry and the combined rule scan
(§2.3, §2.5, §2.13). Each registered language contributes a scan (source rows
-> its own table) and a rule function (table -> finding rows); dispatch is a
filter by language plus a union of the branches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from crx.functions.text import line_count
from crx.operators.code import java as J
from crx.operators.code import nodes as N
from crx.operators.code import python as P
from crx.plans.materialize import input_stamp, stored

# File suffixes per language (case-sensitive).
LANGUAGE_SUFFIXES = {"python": [".py", ".pyx", ".pyi"], "java": [".java"]}


def detect_language(files: DataFrame, path_col: str = "path") -> DataFrame:
    lang = F.lit(None).cast("string")
    for name, sufs in reversed(list(LANGUAGE_SUFFIXES.items())):
        cond = reduce(lambda a, b: a | b, [F.col(path_col).endswith(s) for s in sufs])
        lang = F.when(cond, F.lit(name)).otherwise(lang)
    return files.withColumn("language", lang)


@dataclass
class Extractor:
    scan: Callable[[DataFrame], DataFrame]       # sources -> language table
    rules: Callable[[DataFrame], DataFrame]      # language table -> findings


REGISTRY: dict[str, Extractor] = {}


def register_extractor(language: str, scan: Callable[[DataFrame], DataFrame],
                       rules: Callable[[DataFrame], DataFrame], suffixes: list[str] | None = None) -> None:
    """Plug in a language; registering a language again replaces it."""
    REGISTRY[language] = Extractor(scan, rules)
    if suffixes:
        LANGUAGE_SUFFIXES[language] = list(suffixes)


def table_function_scan(spark: SparkSession, name: str, parse: Callable[[int, str, str], Iterable[tuple]],
                        schema: str) -> Callable[[DataFrame], DataFrame]:
    """Register `parse(file_id, path, content)`, a plain function that gives a file's
    rows, as the SQL table function `name`, and return the scan that calls it. Queries can
    call it too: `FROM files f, LATERAL name(f.file_id, f.path, f.content)`, or
    `FROM name(TABLE(files) PARTITION BY file_id)`, which hands over whole rows."""
    class Parser:
        def eval(self, *args):  # noqa: ANN002, ANN201
            row = args[0] if len(args) == 1 else dict(zip(("file_id", "path", "content"), args, strict=True))
            yield from parse(row["file_id"], row["path"], row["content"] or "")
    spark.udtf.register(name, udtf(Parser, returnType=schema))

    def scan(sources: DataFrame) -> DataFrame:
        return sources.sparkSession.sql(f"SELECT n.* FROM {{files}} f, LATERAL {name}(f.file_id, f.path, f.content) n", files=sources)
    scan.__qualname__ = f"{name}-{uuid.uuid4().hex}"  # a name registered again is another scan
    return scan


FILE_SPREAD, ENOUGH_PARTS = 16, 2_000  # tokens with their features are that much wider than their text


def dealt_files(sources: DataFrame) -> DataFrame:
    """Sources dealt by file before they are taken apart: rows made of a file stay where
    it is, so windows and groups by file need no shuffle of tokens, only of the text.
    As many more parts than a shuffle has otherwise keep their sorts in memory; a session
    that has thousands already needs no more."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sources.select("file_id", "path", "content").repartition(max(parts, min(FILE_SPREAD * parts, ENOUGH_PARTS)), "file_id")


def java_scan(sources: DataFrame, large_chars: int = J.LARGE_CHARS) -> DataFrame:
    """The tokens that rules and structure read, with their features. Files are taken
    apart where they lie, through tokens, features and marks in one pass: nothing is
    shuffled. A file of more than `large_chars` is scanned in chunks, so that its windows
    are spread over tasks; the rows are the same either way. Large files are written apart
    first, as the chunked scan reads them several times; without any it has no part in the
    plan."""
    large = F.coalesce(F.length("content"), F.lit(0)) > large_chars
    apart = stored(sources.sparkSession, "large_files", None, lambda: sources.filter(large))
    small = J.file_marks(sources.filter(~large))
    if apart.isEmpty():
        return small
    return small.unionByName(J.rule_marks(J.chunked_features(J.java_tokens(apart.repartition("file_id")))))


def python_rules(scan: DataFrame) -> DataFrame:
    return P.rule_scan_python(N.code_nodes(scan=scan))


register_extractor("python", N.code_scan, python_rules)
register_extractor("java", java_scan, J.rule_scan_java)


def language_table(files: DataFrame, lang: str, registry: dict[str, Extractor] | None = None) -> DataFrame:
    """The extractor table (syntax nodes, tokens, ...) of the files routed to
    `lang`, written once to the shared checkpoint folder. The same files routed
    by the same suffixes to the same extractor reuse the table within the
    session, whatever the language is called, until one of the files changes.
    Rows that come from no file are scanned anew each time."""
    reg = REGISTRY if registry is None else registry
    ex = reg[lang]
    langs = list(LANGUAGE_SUFFIXES)
    branch = detect_language(files).filter(F.col("language") == lang).select("file_id", "path", "content")
    pos = langs.index(lang) if lang in langs else -1
    stamp = input_stamp(files)
    key = None if stamp is None else "|".join([stamp, repr([LANGUAGE_SUFFIXES[x] for x in langs]), str(pos),
                    f"{getattr(ex.scan, '__module__', '')}.{getattr(ex.scan, '__qualname__', repr(ex.scan))}"])
    return stored(files.sparkSession, "language_scan", key, lambda: ex.scan(branch))


def analyzer_dispatch(files: DataFrame, registry: dict[str, Extractor] | None = None) -> DataFrame:
    """Send every file to its language's extractor and rules; languages with no
    extractor get none. Output: finding rows with the file's language. Every
    rule reads the language table, which is written once (`language_table`)
    instead of re-running the scan per rule."""
    reg = REGISTRY if registry is None else registry
    parts = [reg[lang].rules(language_table(files, lang, reg)).withColumn("language", F.lit(lang)) for lang in reg]
    return reduce(lambda a, b: a.unionByName(b), parts)


def rule_scan(sources: DataFrame) -> DataFrame:
    """All rules of each file's language, unioned; parse failures give none."""
    return analyzer_dispatch(sources)


def lines_of_code(sources: DataFrame) -> DataFrame:
    return sources.select("file_id", "path", line_count(F.col("content")).alias("lines_of_code"))


def structure_summary(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """One nested row per Python file: lines of code, imports, functions,
    classes, calls, assignments and exception blocks (each list in source
    order; a file's lists are bounded by the file)."""
    def nest(df: DataFrame, name: str, cols: list[str], order: str) -> DataFrame:
        return df.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias(name))

    loc = lines_of_code(sources)
    parts = [
        nest(P.py_imports(nodes), "imports", ["import_name"], "seq"),
        nest(P.py_functions(nodes).withColumnRenamed("node_id", "seq"), "functions",
             ["name", "line_start", "line_end", "args", "returns", "decorators", "complexity"], "seq"),
        nest(P.py_classes(nodes).withColumnRenamed("node_id", "seq"), "classes",
             ["name", "line_start", "line_end", "bases", "decorators"], "seq"),
        nest(P.py_calls(nodes).withColumnRenamed("node_id", "seq"), "calls",
             ["callee", "line", "args", "keyword_args"], "seq"),
        nest(P.py_assignments(nodes), "assignments", ["target"], "seq"),
        nest(P.py_exception_blocks(nodes), "exception_blocks", ["line_start", "line_end"], "seq"),
    ]
    out = nodes.select("file_id").distinct().join(loc, "file_id")
    for p in parts:
        out = out.join(p, "file_id", "left")
    return out.withColumn("language", F.lit("python"))


def java_structure_summary(feat: DataFrame, sources: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """One nested row per Java file: lines of code, imports, classes (with
    their bases), methods (parameters, return type, annotations) and calls,
    each list in token order and bounded by the file."""
    s = J.java_structure(feat, methods)

    def nest(df: DataFrame, name: str, order: str, cols: list[str]) -> DataFrame:
        return df.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias(name))

    parts = [nest(s["imports"], "imports", "seq", ["import_path"]),
             nest(s["classes"], "classes", "class_idx", ["name", "line_start", "bases"]),
             nest(s["methods"], "functions", "name_idx", ["name", "line_start", "args", "returns", "annotations"]),
             nest(s["calls"], "calls", "seq", ["member", "line"])]
    out = lines_of_code(sources)
    for p in parts:
        out = out.join(p, "file_id", "left")
    return out.withColumn("language", F.lit("java"))
