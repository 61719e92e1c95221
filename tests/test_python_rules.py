"""Python rules on trigger / non-trigger snippets (shape of the reference's
analyzer tests)."""

import textwrap

import pytest

from crx.operators.code import nodes as N
from crx.operators.code import python as P


def _nodes(spark, src):
    df = spark.createDataFrame([(1, "m.py", textwrap.dedent(src))], "file_id long, path string, content string")
    return N.code_nodes(df)


def _hits(spark, rule, src):
    return sorted((r.line_start, r.line_end, r.title) for r in rule(_nodes(spark, src)).collect())


CASES = [
    (P.rule_py_exec_eval, "x = eval(s)\nexec(code)\nobj.exec(1)\n", [(1, 1, "Detected eval() call"), (2, 2, "Detected exec() call")]),
    (P.rule_py_unsafe_pickle, "import pickle\npickle.loads(b)\njson.loads(b)\ndill.load(f)\n",
     [(2, 2, "Unsafe deserialization via pickle.loads()"), (4, 4, "Unsafe deserialization via dill.load()")]),
    (P.rule_py_shell_injection,
     "os.system(c)\nsubprocess.run(c, shell=True)\nsubprocess.run(c, shell=1)\nsubprocess.run(c)\nos.popen(c)\n",
     [(1, 1, "Potential shell injection via os.system()"), (2, 2, "Potential shell injection via subprocess.run()"),
      (5, 5, "Potential shell injection via os.popen()")]),
    (P.rule_py_sql_concat,
     'cur.execute("a" + b)\ncur.execute("a %s" % b)\ncur.execute(f"a {b}")\ncur.execute("a {}".format(b))\n'
     'cur.execute("a", b)\nModel.objects.raw("x" + y)\ncur.execute(f"")\n',
     [(1, 1, "SQL string concatenation in cur.execute()"), (2, 2, "SQL string concatenation in cur.execute()"),
      (3, 3, "SQL string concatenation in cur.execute()"), (6, 6, "SQL string concatenation in Model.objects.raw()")]),
    (P.rule_py_bare_except, "try:\n    f()\nexcept:\n    pass\ntry:\n    g()\nexcept ValueError:\n    pass\n",
     [(3, 4, "Bare except clause")]),
    (P.rule_py_hardcoded_secret,
     'password = "hunter2"\nAPI_KEY = "  changeme "\ntoken = ""\nself.secret_value = "abc"\nname = "x"\n'
     'a = db_password = "pw"\nretries = 3\n',
     [(1, 1, "Hardcoded secret in variable 'password'"), (4, 4, "Hardcoded secret in variable 'secret_value'"),
      (6, 6, "Hardcoded secret in variable 'db_password'")]),
    (P.rule_py_file_leak,
     "f = open(p)\nwith open(p) as g:\n    pass\nwith closing(open(p)) as h:\n    pass\n"
     "async def r():\n    async with open(p) as k:\n        pass\n",
     [(1, 1, "open() used without with statement"), (4, 4, "open() used without with statement"),
      (7, 7, "open() used without with statement")]),
]


@pytest.mark.parametrize("rule,src,expected", CASES, ids=[c[0].__name__ for c in CASES])
def test_rule(spark, rule, src, expected):
    assert _hits(spark, rule, src) == expected


def test_complexity_counts_boolops_nested_functions_only_sync(spark):
    body = "".join(f"    if x == {i} and y or z:\n        pass\n" for i in range(5))   # 5 ifs + 5*2 boolop
    src = "def big(x, y, z):\n" + body + "    def inner():\n        while True:\n            pass\n" \
          "    return x\n" + "async def abig(x, y, z):\n" + body
    hits = _hits(spark, P.rule_py_complexity, src)
    # 1 + 5 + 10 + 1 (nested while) = 17 for the sync function; the async one is not checked
    assert hits == [(1, 15, "Function 'big' has high cyclomatic complexity (17)")]
    cx = {r.name: r.complexity for r in P.py_complexity(_nodes(spark, src)).collect()}
    assert cx == {"big": 17, "inner": 2, "abig": 16}


def test_function_length_inclusive(spark):
    src = "def f():\n" + "    x = 1\n" * 49 + "    return x\n" + "def g():\n" + "    x = 1\n" * 48 + "    return x\n"
    assert _hits(spark, P.rule_py_function_length, src) == [(1, 51, "Function 'f' is too long (51 lines)")]


def test_syntax_error_gives_status_and_no_nodes(spark):
    df = spark.createDataFrame([(1, "bad.py", "def f(:\n"), (2, "ok.py", "x = 1\n")],
                               "file_id long, path string, content string")
    scan = N.code_scan(df)
    st = {r.file_id: (r.success, r.error_message is not None) for r in N.parse_status(scan=scan).collect()}
    assert st == {1: (False, True), 2: (True, False)}
    assert N.code_nodes(scan=scan).filter("file_id = 1").count() == 0


def test_structure(spark):
    src = ("import os, sys as s\nfrom . import x\nfrom .pkg import y\n"
           "@dec\n@mod.attr(1)\nclass A(B, mod.C):\n    def m(self, a, *args, b=1, **kw) -> int:\n        return f(a, 'x', k=1, **kw)\n")
    n = _nodes(spark, src)
    assert sorted(r.import_name for r in P.py_imports(n).collect()) == [".x", "os", "pkg.y", "sys"]
    c = P.py_classes(n).collect()[0]
    assert (c.name, c.line_start, c.bases, c.decorators) == ("A", 6, ["B", "mod.C"], ["@dec", "@mod.attr(1)"])
    f = P.py_functions(n).collect()[0]
    assert (f.name, f.args, f.returns) == ("m", ["self", "a"], "int")
    call = P.py_calls(n).collect()[0]
    assert (call.callee, call.args, call.keyword_args) == ("f", ["a", "'x'"], ["k"])


def test_the_scan_hands_on_arrow_batches_of_every_node():
    """Rows leave the parser as they are, nulls and lists too, in batches of bounded size."""
    import pyarrow as pa

    from crx.operators.code import nodes as N
    text = "import os\nx = y = 'a'\nclass C(B):\n    def f(self, a=1):\n        return open(a, shell=True) and None\n"
    sources = [(1, "a.py", text), (2, "b.py", "def ("), (3, "c.py", None), *((i, "d.py", "v = 1\n" * 2_000) for i in range(4, 14))]
    batch = pa.RecordBatch.from_pylist([dict(zip(("file_id", "path", "content"), s)) for s in sources])
    got = list(N._parse_batches(iter([batch])))
    want = [row for i, p, c in sources for row in N._rows(i, p, c or "")]
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want
    assert len(got) > 1 and max(b.num_rows for b in got) < 2 * N.OUTPUT_ROWS


def test_names_and_paths_are_read_without_the_unparser(monkeypatch):
    """The common callees, targets, bases and decorators need no unparser; a callee that is a
    call has its own text, not that of the call in it; both forms of the rows agree."""
    import ast

    text = "@a.b\nclass C(m.B):\n    x.y = f(z)\nmake(1)(2)\nwith open(p) as q, t.u():\n    not (a and b or c)\n"
    want = [(r[5], r[19], r[20]) for r in N._rows(1, "m.py", text)]
    assert ("Call", "make(1)", "make") in want and ("Call", None, "make(1)") in want
    monkeypatch.setattr(ast, "unparse", lambda node: 1 / 0)
    rows = N._rows(1, "m.py", text)
    texts = {(r[7], r[19]) for r in rows if r[19]}
    assert texts == {("decorator_list", "a.b"), ("bases", "m.B"), ("targets", "x.y"), ("func", "f"), ("args", "z"), ("func", "make"), ("args", "1"),
                     ("args", "2"), ("func", "open"), ("args", "p"), ("func", "t.u")}
    held = N._Nodes()
    held.add(1, "m.py", text)
    assert [tuple(r.values()) for r in held.batch().to_pylist()] == rows


def test_findings_are_put_together_for_rows_that_meet_a_rule(spark, tmp_path):
    nodes = _nodes(spark, "x = eval(s)\nexec = 1\n")
    nodes.write.parquet(str(tmp_path / "nodes"))
    stored = spark.read.parquet(str(tmp_path / "nodes"))
    plan = P.rule_scan_python(stored)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate"):]
    conditions = below[below.index("Filter"):].splitlines()[0]
    assert "IN (exec,eval)" in conditions.split("CASE")[0]
    assert [(r.line_start, r.rule_id) for r in P.rule_scan_python(stored).collect()] == [(1, "python-exec-eval")]
