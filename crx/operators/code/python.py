"""Python structure extraction and rules, relational over the node table
(§2.3, §2.4). Matching is on literal callee text; aliases are not resolved.

Structure queries join a node with its children on (file_id, node id); rules read
single rows, on which the scan has recorded what they need of the children."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crx.functions.text import PY_WS_CLASS

# Rule vocabularies of the Python rules.
SECRET_WORDS = ["password", "passwd", "secret", "api_key", "apikey", "token", "private_key"]
PLACEHOLDER_VALUES = ["test_password", "example_key", "your_api_key", "xxx", "secret_here", "changeme",
                      "changethis", "placeholder"]
UNSAFE_LOADS = ["pickle.loads", "pickle.load", "cPickle.loads", "cPickle.load", "dill.loads", "dill.load"]
ALWAYS_SHELL = ["os.system", "os.popen"]
SUBPROCESS_SHELL = ["subprocess.call", "subprocess.Popen", "subprocess.run", "subprocess.check_call",
                    "subprocess.check_output"]
SQL_METHOD_SUFFIXES = [".execute", ".executemany", ".raw"]
COMPLEXITY_LIMIT = 15
LENGTH_LIMIT = 50

# Rule ids, titles ({} = callee or name) and descriptions.
RULES = {
    "exec_eval": ("python-exec-eval", "critical", "security", "Detected {}() call",
                  "Use of {0}() can execute arbitrary code and may lead to code injection vulnerabilities. "
                  "Avoid using {0}() with untrusted input."),
    "unsafe_pickle": ("python-unsafe-pickle", "critical", "security", "Unsafe deserialization via {}()",
                      "Deserializing untrusted data with {}() can lead to arbitrary code execution. Use a safer "
                      "serialization format like JSON or restrict pickle to trusted data sources only."),
    "shell_injection": ("python-shell-injection", "critical", "security", "Potential shell injection via {}()",
                        "Using {}() with shell commands can lead to command injection vulnerabilities if user "
                        "input is incorporated into the command string. Use subprocess with shell=False and pass "
                        "arguments as a list, or use shlex.quote() to escape user input."),
    "sql_concat": ("python-sql-concat", "warning", "security", "SQL string concatenation in {}()",
                   "Building SQL queries via string concatenation or formatting can lead to SQL injection. Use "
                   "parameterized queries with placeholders (?, :name, %s) instead."),
    "bare_except": ("python-bare-except", "warning", "best_practice", "Bare except clause",
                    "A bare except: clause catches all exceptions including KeyboardInterrupt and SystemExit, "
                    "which can make debugging difficult and prevent graceful shutdown. Specify the exception "
                    "type(s) to catch."),
    "hardcoded_secret": ("python-hardcoded-secret", "warning", "security", "Hardcoded secret in variable '{}'",
                         "Hardcoded credentials or secrets in source code can be exposed in version control. Use "
                         "environment variables or a secrets manager instead."),
    "file_leak": ("python-file-leak", "warning", "best_practice", "open() used without with statement",
                  "Using open() without a 'with' statement can lead to file resource leaks if close() is not "
                  "called or an exception occurs. Use 'with open(...) as f:' to ensure the file is always closed."),
    "complexity": ("python-complexity", "warning", "style",
                   "Function '{}' has high cyclomatic complexity ({})",
                   "Cyclomatic complexity of {} exceeds the threshold of {}. Consider refactoring the function "
                   "into smaller, more focused functions."),
    "function_length": ("python-function-length", "suggestion", "style", "Function '{}' is too long ({} lines)",
                        "Function length of {} lines exceeds the limit of {}. Consider splitting the function "
                        "into smaller, more focused functions."),
    "duplicate": ("python-duplicate-code", "suggestion", "style", "Duplicated block of {} lines",
                  "The same block of code appears more than once. Consider extracting it into a shared function."),
}

FINDING_COLS = ["file_id", "node_id", "rule_id", "severity", "category", "file_path", "line_start", "line_end",
                "title", "description"]


def _fmt(template: str, *args: Column) -> Column:
    """Python str.format for '{}'/'{0}' templates, as a Spark concat."""
    import re
    parts = re.split(r"(\{\d*\})", template)
    out: list[Column] = []
    auto = 0
    for p in parts:
        if re.fullmatch(r"\{\d*\}", p):
            idx = int(p[1:-1]) if p[1:-1] else auto
            auto += 1 if not p[1:-1] else 0
            out.append(args[idx].cast("string"))
        elif p:
            out.append(F.lit(p))
    return F.concat(*out) if out else F.lit("")


def _kids(nodes: DataFrame, slot: str, prefix: str) -> DataFrame:
    """Children in `slot`, keyed by (file_id, parent) and renamed with prefix."""
    k = nodes.filter(F.col("slot") == slot)
    return k.select("file_id", F.col("parent_id").alias("node_id"),
                    *[F.col(c).alias(f"{prefix}{c}") for c in ("node_id", "kind", "slot_idx", "name", "str_value",
                                                                "is_true", "op", "n_values", "text", "line_start",
                                                                "line_end")])


def calls(nodes: DataFrame) -> DataFrame:
    """Call nodes with their callee text (ast.unparse of the function part,
    recorded on the Call row by the scan)."""
    return nodes.filter(F.col("kind") == "Call").select(
        "file_id", "node_id", "path", "line_start", "line_end", "n_args", "callee")


# ---------------------------------------------------------------- structure

def py_imports(nodes: DataFrame) -> DataFrame:
    """import a -> 'a'; from m import x -> 'm.x' (no module -> '.x')."""
    imp = nodes.filter(F.col("kind").isin("Import", "ImportFrom")).select(
        "file_id", "node_id", "path", "kind", F.col("name").alias("module"), "line_start")
    al = _kids(nodes, "names", "a_")
    j = imp.join(al, ["file_id", "node_id"])
    name = F.when(F.col("kind") == "Import", F.col("a_name")).otherwise(
        F.concat(F.coalesce(F.col("module"), F.lit("")), F.lit("."), F.col("a_name")))
    return j.select("file_id", "path", F.col("a_node_id").alias("seq"), "line_start", name.alias("import_name"))


def py_complexity(nodes: DataFrame) -> DataFrame:
    """1 + decision nodes + (operands - 1) per and/or, over each function's whole
    subtree (nested functions included). The scan records the running weight
    in pre-order (cw) and its value at the end of each subtree (cw_end), so the
    subtree's weight is a column difference: no join and no window."""
    fn = nodes.filter(F.col("kind").isin("FunctionDef", "AsyncFunctionDef"))
    return fn.select("file_id", "node_id", "path", "kind", "name", "line_start", "line_end",
                     (F.col("cw_end") - F.col("cw") + 1).cast("int").alias("complexity"))


def py_functions(nodes: DataFrame) -> DataFrame:
    """name, lines, positional arg names, simple return name, decorators,
    complexity; sync and async, nested included."""
    cx = py_complexity(nodes)
    arguments = _kids(nodes, "args", "g_").filter(F.col("g_kind") == "arguments") \
        .select("file_id", "node_id", F.col("g_node_id").alias("args_id"))
    arg_names = (_kids(nodes, "args", "x_").filter(F.col("x_kind") == "arg")
                 .groupBy("file_id", F.col("node_id").alias("args_id"))
                 .agg(F.array_sort(F.collect_list(F.struct("x_slot_idx", "x_name"))).alias("al")))
    ret = _kids(nodes, "returns", "r_").select("file_id", "node_id",
                                               F.when(F.col("r_kind") == "Name", F.col("r_name")).alias("returns"))
    dec = (_kids(nodes, "decorator_list", "d_").groupBy("file_id", "node_id")
           .agg(F.array_sort(F.collect_list(F.struct("d_slot_idx", "d_text"))).alias("dl")))
    j = (cx.join(arguments, ["file_id", "node_id"], "left").join(arg_names, ["file_id", "args_id"], "left")
         .join(ret, ["file_id", "node_id"], "left").join(dec, ["file_id", "node_id"], "left"))
    empty = F.array().cast("array<string>")
    return j.select(
        "file_id", "node_id", "path", "name", "line_start", "line_end",
        F.coalesce(F.col("al.x_name"), empty).alias("args"), "returns",
        F.coalesce(F.transform("dl", lambda d: F.concat(F.lit("@"), d["d_text"])), empty).alias("decorators"),
        "complexity", (F.col("kind") == "AsyncFunctionDef").alias("is_async"))


def py_classes(nodes: DataFrame) -> DataFrame:
    cl = nodes.filter(F.col("kind") == "ClassDef").select("file_id", "node_id", "path", "name", "line_start", "line_end")
    bases = (_kids(nodes, "bases", "b_").groupBy("file_id", "node_id")
             .agg(F.array_sort(F.collect_list(F.struct("b_slot_idx", "b_text"))).alias("bl")))
    dec = (_kids(nodes, "decorator_list", "d_").groupBy("file_id", "node_id")
           .agg(F.array_sort(F.collect_list(F.struct("d_slot_idx", "d_text"))).alias("dl")))
    empty = F.array().cast("array<string>")
    return (cl.join(bases, ["file_id", "node_id"], "left").join(dec, ["file_id", "node_id"], "left")
            .select("file_id", "node_id", "path", "name", "line_start", "line_end",
                    F.coalesce(F.col("bl.b_text"), empty).alias("bases"),
                    F.coalesce(F.transform("dl", lambda d: F.concat(F.lit("@"), d["d_text"])), empty).alias("decorators"),
                    empty.alias("methods")))


def py_calls(nodes: DataFrame) -> DataFrame:
    """callee text, line, positional arg text, keyword names (no **)."""
    c = calls(nodes)
    args = (_kids(nodes, "args", "a_").groupBy("file_id", "node_id")
            .agg(F.array_sort(F.collect_list(F.struct("a_slot_idx", "a_text"))).alias("al")))
    kws = (_kids(nodes, "keywords", "k_").filter(F.col("k_name").isNotNull())
           .groupBy("file_id", "node_id")
           .agg(F.array_sort(F.collect_list(F.struct("k_slot_idx", "k_name"))).alias("kl")))
    empty = F.array().cast("array<string>")
    return (c.join(args, ["file_id", "node_id"], "left").join(kws, ["file_id", "node_id"], "left")
            .select("file_id", "node_id", "path", "callee", F.col("line_start").alias("line"),
                    F.coalesce(F.col("al.a_text"), empty).alias("args"),
                    F.coalesce(F.col("kl.k_name"), empty).alias("keyword_args")))


def py_assignments(nodes: DataFrame) -> DataFrame:
    """Plain assignment targets: names and attribute paths."""
    t = nodes.filter((F.col("slot") == "targets") & F.col("kind").isin("Name", "Attribute")
                     & (F.col("parent_kind") == "Assign"))
    return (t.select("file_id", "path", F.col("node_id").alias("seq"), "line_start",
                    F.when(F.col("kind") == "Name", F.col("name")).otherwise(F.col("text")).alias("target")))


def py_exception_blocks(nodes: DataFrame) -> DataFrame:
    """(start, end) of each handler of a plain try statement."""
    h = nodes.filter((F.col("kind") == "ExceptHandler") & (F.col("slot") == "handlers")
                     & (F.col("parent_kind") == "Try"))
    return h.select("file_id", "path", F.col("node_id").alias("seq"), "line_start", "line_end")


# ------------------------------------------------------------------- rules
#
# Every rule is a condition on one row of the node table: the scan records on a
# node what the rules ask of its children. So any number of rules is one pass.

def _py_strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{PY_WS_CLASS}+|{PY_WS_CLASS}+$", "")


def _secret_target() -> Column:
    """The first assigned name that contains a secret word; null without one."""
    words = F.array(*[F.lit(w) for w in SECRET_WORDS])
    named = F.filter("target_names", lambda n: F.exists(words, lambda w: F.instr(F.lower(n), w) > 0))
    return F.get(named, F.lit(0))


def _conditions(complexity_limit: int, length_limit: int) -> dict[str, tuple[Column, list[Column], list[Column]]]:
    """Rule key -> (condition on a node row, title arguments, description arguments)."""
    kind, callee = F.col("kind"), F.col("callee")
    call = kind == "Call"
    sql_call = F.lit(False)
    for suffix in SQL_METHOD_SUFFIXES:
        sql_call = sql_call | callee.endswith(suffix)
    form = F.col("arg_form")
    built = form.isin("BinOp:Add", "BinOp:Mod") | (form.startswith("JoinedStr:") & (form != "JoinedStr:0"))
    value = _py_strip(F.col("assigned"))
    target = _secret_target()
    weight = (F.col("cw_end") - F.col("cw") + 1).cast("int")
    length = F.col("line_end") - F.col("line_start") + 1
    return {
        "exec_eval": (call & callee.isin("exec", "eval"), [callee], [callee]),
        "unsafe_pickle": (call & callee.isin(UNSAFE_LOADS), [callee], [callee]),
        "shell_injection": (call & (callee.isin(ALWAYS_SHELL) | (callee.isin(SUBPROCESS_SHELL) & F.col("shell_true"))), [callee], [callee]),
        "sql_concat": (call & sql_call & built, [callee], []),
        "bare_except": ((kind == "ExceptHandler") & ~F.col("typed"), [], []),
        "hardcoded_secret": ((kind == "Assign") & F.col("assigned").isNotNull() & (value != "") & ~F.lower(value).isin(PLACEHOLDER_VALUES) & target.isNotNull(), [target], []),
        "file_leak": (call & (callee == "open") & ~F.col("in_with"), [], []),
        "complexity": ((kind == "FunctionDef") & (weight > complexity_limit), [F.col("name"), weight], [weight, F.lit(complexity_limit)]),
        "function_length": ((kind == "FunctionDef") & (length > length_limit), [F.col("name"), length], [length, F.lit(length_limit)]),
    }


def find_rules(nodes: DataFrame, keys: list[str], complexity_limit: int = COMPLEXITY_LIMIT, length_limit: int = LENGTH_LIMIT) -> DataFrame:
    """Findings of the named rules, one pass over the node table: rows that meet a
    condition are kept first, and only their findings are put together."""
    rules = _conditions(complexity_limit, length_limit)
    found = []
    for key in keys:
        when, title_args, desc_args = rules[key]
        rid, sev, cat, title, desc = RULES[key]
        found.append(F.when(when, F.struct(
            F.lit(rid).alias("rule_id"), F.lit(sev).alias("severity"), F.lit(cat).alias("category"),
            _fmt(title, *title_args).alias("title"), _fmt(desc, *desc_args).alias("description"))))
    kinds = nodes.filter(F.col("kind").isin("Call", "ExceptHandler", "Assign", "FunctionDef"))
    met = kinds.filter(reduce(lambda a, b: a | b, [rules[key][0] for key in keys]))
    hits = met.withColumn("_f", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())))
    return hits.select("file_id", "node_id", "_f.rule_id", "_f.severity", "_f.category", F.col("path").alias("file_path"),
                       "line_start", "line_end", "_f.title", "_f.description")


def rule_py_exec_eval(nodes: DataFrame) -> DataFrame:
    return find_rules(nodes, ["exec_eval"])


def rule_py_unsafe_pickle(nodes: DataFrame) -> DataFrame:
    return find_rules(nodes, ["unsafe_pickle"])


def rule_py_shell_injection(nodes: DataFrame) -> DataFrame:
    return find_rules(nodes, ["shell_injection"])


def rule_py_sql_concat(nodes: DataFrame) -> DataFrame:
    return find_rules(nodes, ["sql_concat"])


def rule_py_bare_except(nodes: DataFrame) -> DataFrame:
    return find_rules(nodes, ["bare_except"])


def rule_py_hardcoded_secret(nodes: DataFrame) -> DataFrame:
    return find_rules(nodes, ["hardcoded_secret"])


def rule_py_file_leak(nodes: DataFrame) -> DataFrame:
    """open() calls that are not directly the context expression of a sync
    `with` item."""
    return find_rules(nodes, ["file_leak"])


def rule_py_complexity(nodes: DataFrame, limit: int = COMPLEXITY_LIMIT) -> DataFrame:
    return find_rules(nodes, ["complexity"], complexity_limit=limit)


def rule_py_function_length(nodes: DataFrame, limit: int = LENGTH_LIMIT) -> DataFrame:
    return find_rules(nodes, ["function_length"], length_limit=limit)


PY_RULES = ["exec_eval", "unsafe_pickle", "shell_injection", "sql_concat", "bare_except", "hardcoded_secret", "file_leak",
            "complexity", "function_length"]


def rule_scan_python(nodes: DataFrame) -> DataFrame:
    return find_rules(nodes, PY_RULES)
