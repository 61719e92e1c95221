"""Java lexical rules on trigger / non-trigger snippets."""

import pytest

from crx.operators.code import java as J


def _feat(spark, src):
    df = spark.createDataFrame([(1, "A.java", src)], "file_id long, path string, content string")
    return J.token_features(J.java_tokens(df))


def _lines(spark, rule, src):
    return sorted(r.line_start for r in rule(_feat(spark, src)).collect())


CLASS = "public class A {{\n{body}\n}}\n"

CASES = [
    (J.rule_java_command_injection,
     'void a() throws Exception {\n Runtime.getRuntime().exec(cmd);\n r.exec("ls");\n r.exec();\n r.exec("a" + b);\n}',
     [3, 6]),
    (J.rule_java_unsafe_deserial,
     "private void readObject(ObjectInputStream in) {\n Object o = in.readObject();\n in.readUnshared();\n}", [3, 4]),
    (J.rule_java_sql_concat,
     'void q() {\n s.executeQuery("a" + b);\n s.executeQuery("a" + "b");\n s.execute("a" + "b" + "c");\n'
     ' s.executeQuery(sql);\n s.addBatch(x + y);\n}', [3, 5, 7]),
    (J.rule_java_resource_leak,
     "void r() throws Exception {\n FileReader f = new FileReader(p);\n"
     " try (BufferedReader b = new BufferedReader(new FileReader(p))) { }\n Object o = new Object();\n}", [3]),
    (J.rule_java_hardcoded_secret,
     'String password = "hunter2";\nString apiToken = "test";\nint pwd = 12345;\nString name = "x";\n'
     'private static final String SECRET_KEY = "s";\nString token = "ab";', [2, 4, 7]),
]


@pytest.mark.parametrize("rule,body,expected", CASES, ids=[c[0].__name__ for c in CASES])
def test_rule(spark, rule, body, expected):
    assert _lines(spark, rule, CLASS.format(body=body)) == expected


def test_complexity_and_length(spark):
    ifs = "\n".join(f"  if (v == {i} && w) {{ v = 0; }}" for i in range(5))   # 5 ifs + 5 &&
    body = ("int m(int v, boolean w) {\n" + ifs + "\n  return v > 0 ? 1 : 2;\n}\n"
            "void n() {\n  do { x++; } while (x < 3);\n  switch (x) { case 1: case 2: y(); break; default: z(); }\n}")
    f = _feat(spark, CLASS.format(body=body))
    got = {r.title for r in J.rule_java_complexity(f).collect()}
    assert got == {"High cyclomatic complexity (12) in method 'm'"}
    cx = {r.name: r.complexity for r in J.java_complexity(f, J.java_methods(f)).collect()}
    assert cx == {"m": 12, "n": 4}     # do + one case group + default
    long_body = "void big() {\n" + "  x++;\n" * 52 + "}"
    assert [r.title for r in J.rule_java_method_length(_feat(spark, CLASS.format(body=long_body))).collect()] == [
        "Method 'big' is too long (52 lines)"]


def test_unhandled_exception(spark):
    body = ('void a() {\n throw new RuntimeException("x");\n}\nvoid b() throws IOException {\n throw new IOException();\n}\n'
            'void c() {\n try {\n  throw new IllegalStateException();\n } catch (Exception e) { }\n}')
    assert _lines(spark, J.rule_java_unhandled_exception, CLASS.format(body=body)) == [3]


def test_structure(spark):
    src = ("package p;\nimport java.util.List;\nimport static java.lang.Math.max;\nimport java.io.*;\n"
           "public class A extends Base<T> implements Runnable, Comparable<A> {\n"
           "  public A(int x) { }\n  @Override\n  public List<String> names(Map<String, Integer> m, final int[] n) { return null; }\n}\n")
    s = J.java_structure(_feat(spark, src))
    assert sorted(r.import_path for r in s["imports"].collect()) == ["java.io", "java.lang.Math.max", "java.util.List"]
    c = s["classes"].collect()[0]
    assert (c.name, c.bases) == ("A", ["Base", "Runnable", "Comparable"])
    ms = {r.name: (r.args, r.annotations) for r in s["methods"].collect()}
    assert ms == {"A": (["x"], []), "names": (["m", "n"], ["@Override"])}


def test_block_comments_keep_line_numbers(spark):
    src = ("public class A {\n/* a comment\n   over three\n   lines with exec(x) */\n"
           "  void a() throws Exception { Runtime.getRuntime().exec(cmd); } // exec(y)\n}\n")
    assert _lines(spark, J.rule_java_command_injection, src) == [5]


def test_comment_marks_inside_strings_hide_nothing(spark):
    """A path pattern or address in a string opens no comment; a text block is one
    string; comments keep the line numbers of what follows."""
    from crx.operators.code import java as J
    src = ('class A {\n  String css = "/css/**";\n  String url = "http://x/*y";\n  /* real\n     comment "open */ int a = 1;\n'
           '  char q = \'"\'; // tail /* not\n  String t = """\n    a "quoted" /* text\n    """;\n  void m() { st.executeQuery("a" + b); }\n}\n')
    df = spark.createDataFrame([(1, "A.java", src)], "file_id long, path string, content string")
    toks = [(r.line, r.tok) for r in J.java_tokens(df).orderBy("idx").collect()]
    assert (2, '"/css/**"') in toks and (3, '"http://x/*y"') in toks
    assert (5, "int") in toks and (10, "executeQuery") in toks
    assert not any(t in ("real", "comment", "tail", "quoted") for _, t in toks)
    assert sum(t.startswith('"') for _, t in toks) == 4
    long = spark.createDataFrame([(1, "B.java", 'class B { String s = "' + "x" * 60_000 + '"; }')], df.schema)
    assert J.java_tokens(long).count() == 9


_TOKENS = ["class", "A", "(", ")", "{", "}", ";", "do", "while", "if", "+", "-", "x", "1", '"s"', "import", "case", ":", "?", "<", ">", ",", "new", ".", "b",
           "(", "{", "}", ")", "\n", "\n", "\n", "\n\n\n"]


def test_features_in_chunks_equal_the_windows_over_files(spark):
    """Brackets, neighbours and running values across chunk borders, for chunks of any
    size: unbalanced brackets, empty chunks and files, two files side by side."""
    import random
    rng = random.Random(1)
    rows = [(i, f"p{i}", " ".join(rng.choice(_TOKENS) for _ in range(rng.randrange(150)))) for i in range(80)] + [(900, "e", ""), (901, "n", None)]
    tokens = J.java_tokens(spark.createDataFrame(rows, "file_id long, path string, content string"))
    whole = J.token_features(tokens)
    want = sorted(map(str, whole.collect()))
    for chunk in (1, 4, 4096):
        got = J.chunked_features(tokens, chunk)
        assert got.dtypes == whole.dtypes
        assert sorted(map(str, got.collect())) == want, chunk


def test_large_files_take_the_chunked_scan_and_spread(spark):
    from pyspark.sql import functions as F

    from crx.operators.code.dispatch import java_scan
    body = "\n".join(f"    void m{i}(int a) {{ if (a > {i}) {{ run(a + 1); }} }}" for i in range(6_000))
    src = spark.createDataFrame([(1, "Big.java", f"class Big {{\n{body}\n}}"), (2, "Small.java", "class S { void m() { } }")], "file_id long, path string, content string")
    keep = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = (J.chunked_features(J.java_tokens(src), 300).groupBy(F.spark_partition_id().alias("p"), "file_id").count().filter("file_id = 1").collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", keep)
    total = sum(r["count"] for r in spread)
    assert total > 120_000 and max(r["count"] for r in spread) < total / 2
    both = [sorted(map(str, java_scan(src, limit).collect())) for limit in (1_000, 10_000_000)]
    assert both[0] == both[1]
    methods = J.java_methods(java_scan(src, 1_000))
    assert methods.filter("file_id = 1").count() == 6_000 and methods.filter("body_close IS NULL").count() == 0


def test_the_scan_shuffles_text_and_keeps_what_rules_read(spark, tmp_path):
    """Files are dealt before they are taken apart, so no shuffle stands above a Generate;
    on the rows kept, rules and structure give what they give on all tokens."""
    import random

    from crx.operators.code.dispatch import dealt_files, java_scan
    rng = random.Random(2)
    words = _TOKENS + ["void", "int", "m", "exec", "execute", "Socket", "try", "catch", "throw", "throws", "extends", "implements", "@", "=", "token", '"abcd"', "static", "return"]
    rows = [(i, f"p{i}", " ".join(rng.choice(words) for _ in range(400))) for i in range(60)]
    rows += [(100, "q", "import a.b.*; class Q extends R<T> implements S, U { @Override public int m(int a, List<B> b) throws E { return r.exec(a + b); } }")]
    src = spark.createDataFrame(rows, "file_id long, path string, content string")
    J.token_features(J.java_tokens(src)).coalesce(1).write.parquet(f"{tmp_path}/whole")
    java_scan(src).coalesce(1).write.parquet(f"{tmp_path}/kept")
    whole, kept = spark.read.parquet(f"{tmp_path}/whole"), spark.read.parquet(f"{tmp_path}/kept")
    keep = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = J.token_features(J.java_tokens(dealt_files(src)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", keep)
    assert "Exchange" not in plan[:plan.rindex("Generate")] and "Exchange" in plan
    assert kept.count() < whole.count()

    def outputs(feat):
        methods = J.java_methods(feat).cache()
        return [r(feat, methods) for r in J.JAVA_RULES] + list(J.java_structure(feat, methods).values())
    for got, want in zip(outputs(kept), outputs(whole), strict=True):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_files_of_small_size_pass_without_sort_shuffle_or_window(spark):
    """The scan needs none of them for its features; a file that Arrow cuts into batches
    stays whole, and its lists and bodies are known on the name's row."""
    import pyarrow as pa

    from crx.operators.code import java_runs
    src = "class A {\n int m(int a, int b) throws E {\n  if (a > 1 && b > 2) { r.exec(a + b); }\n  return 1;\n }\n abstract void n();\n}"
    tokens = J.java_tokens(spark.createDataFrame([(i, f"{i}.java", src) for i in range(200)], "file_id long, path string, content string"))
    feat = J.token_features(tokens)
    plan = feat._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Window", "Sort", "Exchange"))
    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = {(r.name, r.line, r.after_close, r.body_decides, r.body_last, r.list_level) for r in J.java_methods(feat).collect()}
        assert rows == {("m", 2, "throws", 2, 4, 1), ("n", 6, ";", None, None, 1)} and J.java_methods(feat).count() == 400
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)
    ids = [1] * 5 + [2] * 3 + [3] * 9 + [4]
    batches = [pa.RecordBatch.from_pydict({"file_id": ids[i:i + 4], "idx": list(range(i, min(i + 4, 18)))}) for i in range(0, 18, 4)]
    size, java_runs.BATCH_TOKENS = java_runs.BATCH_TOKENS, 2
    try:
        got = [b.to_pydict() for b in java_runs.whole_files(iter(batches))]
    finally:
        java_runs.BATCH_TOKENS = size
    assert len(got) > 1 and [i for b in got for i in b["idx"]] == list(range(18))
    assert all(a["file_id"][-1] != b["file_id"][0] for a, b in zip(got, got[1:], strict=False))


def test_structure_is_read_off_the_kept_rows_without_a_shuffle(spark, tmp_path):
    """An import's text, a class's bases and a method's parameters and annotations stand on its
    first row, in both scans; their tokens are not kept."""
    from crx.operators.code.dispatch import java_scan
    text = "import a.b.*; class Q extends R<T> implements S, U {\n @Override @X(1) public int m(int a, Map<K, V> b) throws E { return r.exec(a + b, c); }\n Q(int z) { z = 1; y = x; } }"
    src = spark.createDataFrame([(1, "Q.java", text)], "file_id long, path string, content string")
    for limit in (10, 10_000):
        java_scan(src, limit).write.parquet(f"{tmp_path}/{limit}")
        feat = spark.read.parquet(f"{tmp_path}/{limit}")
        assert sorted(feat.toPandas()["tok"]) == sorted(["import", "class", "X", "m", "exec", "Q", "{", "z"])
        s = J.java_structure(feat)
        for part in s.values():
            assert "Exchange" not in part._jdf.queryExecution().executedPlan().toString()
        assert [r.import_path for r in s["imports"].collect()] == ["a.b"]
        assert [r.bases for r in s["classes"].collect()] == [["R", "S", "U"]]
        assert [(r.name, r.args, r.annotations, r.returns) for r in s["methods"].orderBy("name_idx").collect()] == [
            ("m", ["a", "b"], ["@Override", "@X"], "int"), ("Q", ["z"], [], None)]


def test_files_are_scanned_in_one_pass_with_the_rows_of_its_steps(spark):
    """Tokens, features and marks of a file in one pass over its text, without a row per token
    in between: line ends of all kinds, hidden comments and quotes, odd letters, empty files."""
    import random

    from pyspark.sql import functions as F
    rng = random.Random(3)
    odd = ["/*", "*/", "//", '"""', '"', "'", "\\", "\r", "\r\n", "\x85", "\u2028", "\t", "\x0b", "\xa0", "é", "٠", "𝒳", "\ufffd", "_", "$x", "0x1F", "1.5e3", "<=", "->", "::", "+=", "-", "\\\"", "\\\n"]
    words = (_TOKENS + ["void", "int", "m", "exec", "execute", "Socket", "try", "catch", "throw", "throws", "extends", "implements", "@", "=", "token", '"ab"', "static",
                        "return", "import", "new"]) * 4 + odd
    rows = [(i, f"p{i}", rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.choice([0, 3, 200])))) for i in range(300)]
    rows += [(1000, "n", None), (1001, "c", "// only"), (1002, "q", "import a.b.*; class Q extends R<T> implements S, U { @Override public int m(int a) throws E { return r.exec(a + b); } }")]
    src = spark.createDataFrame(rows, "file_id long, path string, content string").union(spark.sql("SELECT 1003L, 'b', CAST(X'76C3286929FF3B' AS STRING)"))
    one, steps = J.file_marks(src), J.rule_marks(J.token_features(J.java_tokens(src)))
    assert one.dtypes == steps.dtypes
    got = sorted(map(str, one.collect()))
    assert len(got) > 500 and got == sorted(map(str, steps.collect()))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    all_ = J.Tokens.of_texts([r[2] or "" for r in rows], frozenset(J.KEYWORDS))
    want = J.java_tokens(src.filter(F.col("file_id") < 1003)).orderBy("file_id", "idx").select("idx", "line", "tok", "kind").collect()
    assert list(zip(all_.idx.to_pylist(), all_.line.to_pylist(), all_.words(all_.at).to_pylist(), all_.words(all_.at, "kind").to_pylist())) == [tuple(w) for w in want]


def test_without_large_files_the_scan_has_no_chunked_branch(spark):
    """Large files are set apart first, once; the plan of a scan that has none is one pass."""
    from crx.operators.code.dispatch import java_scan
    src = spark.createDataFrame([(1, "A.java", "class A { void m() { } }"), (2, "N.java", None)], "file_id long, path string, content string")
    plan = java_scan(src)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Window" not in plan and "Union" not in plan
    assert "Window" in java_scan(src, 10)._jdf.queryExecution().executedPlan().toString()


def test_kinds_of_tokens_are_told_by_their_first_character(spark):
    """No pattern is matched once a token is cut out; odd beginnings keep their kinds."""
    src = spark.createDataFrame([(1, "A.java", "éa Z9 _x $y nullx null 9a \"s\" 'c' @ ` { class Class ~ ٠")], "file_id long, path string, content string")
    tokens = J.java_tokens(src)
    assert "RLIKE" not in tokens._jdf.queryExecution().executedPlan().toString().upper()
    assert [(r.tok, r.kind) for r in tokens.orderBy("idx").collect()] == [
        ("é", "op"), ("a", "ident"), ("Z9", "ident"), ("_x", "ident"), ("$y", "ident"), ("nullx", "ident"), ("null", "literal"), ("9a", "number"), ('"s"', "string"),
        ("'c'", "string"), ("@", "op"), ("`", "op"), ("{", "op"), ("class", "keyword"), ("Class", "ident"), ("~", "op"), ("٠", "op")]
