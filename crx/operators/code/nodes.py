"""Python syntax-node table (§2.3).

`code_nodes` parses each source file once with the standard-library parser
inside `mapInArrow` (Arrow batches, one partition of files at a time) and
emits one row per syntax node. `node_id..subtree_end` is a nested-set interval
over the pre-order numbering, so "inside" is a range predicate. Every rule and
structure query afterwards is relational over this table.

Each file also yields one `$file` row (node_id -1) carrying the parse status,
so status and nodes come out of the same scan.
"""

from __future__ import annotations

import ast
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "file_id long, path string, node_id int, parent_id int, subtree_end int, kind string, "
    "parent_kind string, slot string, slot_idx int, name string, str_value string, const_repr string, "
    "is_true boolean, op string, n_args int, n_values int, level int, line_start int, line_end int, "
    "text string, callee string, cw int, cw_end int, "
    # facts of a node that the rules read on its own row (see `_facts`)
    "shell_true boolean, arg_form string, typed boolean, assigned string, target_names array<string>, in_with boolean"
)
# Decision points counted by cyclomatic complexity; BoolOp adds operands - 1.
DECISION_KINDS = frozenset({"If", "For", "AsyncFor", "While", "ExceptHandler"})
FILE_ROW = "$file"
PY_VERSION = "%d.%d.%d" % sys.version_info[:3]

# Slots whose expression text (ast.unparse) is kept: callee, decorators,
# base classes, return annotation, assignment targets, positional call args.
_TEXT_SLOTS = {"func", "decorator_list", "bases", "returns", "targets"}


def _utf8(text: str | None) -> str | None:
    """The text with lone surrogates, which Arrow can't carry, replaced by '?'."""
    return text if text is None or text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def _unparsed(node: ast.AST) -> str | None:
    """`ast.unparse`; names and attribute paths, the common case, without it."""
    parts, inner = [], node
    while type(inner) is ast.Attribute:
        parts.append(inner.attr)
        inner = inner.value
    if type(inner) is ast.Name:
        return ".".join([inner.id, *reversed(parts)])
    try:
        return ast.unparse(node)
    except Exception:  # noqa: BLE001 - unparse of odd trees
        return None


# Leaf singletons carried by their parent (`ctx` of names, operators of
# expressions); they are not emitted as nodes of their own.
_SKIP = (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop)
# Plain name references are leaves that no rule or structure query reads
# except in these slots (assignment targets, callee, call arguments,
# decorators, bases, return annotation, handler type); elsewhere they are
# not emitted.
_NAME_SLOTS = frozenset({"targets", "func", "args", "decorator_list", "bases", "returns", "type"})

# What is known of a node by its class alone, looked up once per class: the number of its
# kind, the field of its own name (id / attr / arg / name; module of ImportFrom), what else
# to record, and its fields that can hold nodes, last first, each with the number of its
# slot and whether plain names are emitted there. A slot's number stands for its name and
# its parent's kind.
_KINDS: list[str] = [FILE_ROW]
_SLOTS: list[tuple[str | None, str | None]] = [(None, None)]
_PLANS: dict[type, tuple] = {}
_TEXTS: set[int] = set()  # slots whose text is kept
_IS_NODE: dict[type, bool] = {}  # whether values of a class are emitted as nodes


def _slot(name: str, kind: str) -> int:
    _SLOTS.append((name, kind))
    if name in _TEXT_SLOTS or (name == "args" and kind == "Call"):
        _TEXTS.add(len(_SLOTS) - 1)
    return len(_SLOTS) - 1


def _plan(cls: type) -> tuple:
    kind = cls.__name__
    _KINDS.append(kind)
    named = "module" if cls is ast.ImportFrom else next((a for a in ("id", "attr", "arg", "name") if a in cls._fields), None)
    types = getattr(cls, "_field_types", {})  # none before Python 3.13
    fields = tuple((f, _slot(f, kind), f in _NAME_SLOTS) for f in cls._fields if _may_hold(types.get(f, ast.AST)))[::-1]
    _PLANS[cls] = plan = len(_KINDS) - 1, named, _RECORDED.get(cls), fields
    return plan


def _may_hold(declared) -> bool:
    """Whether a field declared so (a class, a list of one, or one or none) can hold nodes."""
    inner = getattr(declared, "__args__", ())
    return any(map(_may_hold, inner)) if inner else not isinstance(declared, type) or issubclass(declared, ast.AST) and not issubclass(declared, _SKIP)


def _is_node(cls: type) -> bool:
    _IS_NODE[cls] = found = issubclass(cls, ast.AST) and not issubclass(cls, _SKIP)
    return found


_SPARSE = {"name": pa.string(), "str_value": pa.string(), "const_repr": pa.string(), "op": pa.string(), "n_args": pa.int32(), "n_values": pa.int32(),
           "level": pa.int32(), "text": pa.string(), "callee": pa.string(), "shell_true": pa.bool_(), "arg_form": pa.string(), "typed": pa.bool_(),
           "assigned": pa.string(), "target_names": pa.list_(pa.string()), "in_with": pa.bool_()}


class _Nodes:
    """Rows of whole files, by column: six numbers of every row (kind, place of the parent's
    row, slot, place in the slot or -1, first and last line or 0), and the rest only
    where there is a value."""

    def __init__(self) -> None:
        self.rows = array("i")
        self.files: list[tuple[int, str, int]] = []  # id, path, place of the status row
        self.true: list[int] = []
        self.found: dict[str, tuple[list[int], list]] = {c: ([], []) for c in _SPARSE}
        self.callee: str | None = None

    def __len__(self) -> int:
        return len(self.rows) // 6

    def put(self, column: str, at: int, value) -> None:
        if value is not None:
            places, values = self.found[column]
            places.append(at)
            values.append(value)

    def add(self, file_id: int, path: str, source: str) -> None:
        """The status row of a file and, if it can be parsed, the rows of its nodes."""
        at = len(self)
        self.files.append((file_id, path, at))
        self.rows.extend((0, -1, 0, -1, 0, 0))
        self.put("const_repr", at, PY_VERSION)
        self.put("n_args", at, len(source.splitlines()))
        try:
            tree = ast.parse(source, filename=path)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as exc:
            # the last two: nesting beyond the parser's stack; the file fails, not the job
            self.put("str_value", at, _utf8(str(exc) or type(exc).__name__))
            return
        self.true.append(at)
        self.walk(tree, at)

    def walk(self, tree: ast.AST, at: int) -> None:
        # iterative pre-order walk: (node, place of the parent's row, slot, place in the slot)
        stack = [(tree, at, 0, -1)]
        pop, push, row, plans, is_node, texts, plain = stack.pop, stack.append, self.rows.extend, _PLANS, _IS_NODE, _TEXTS, ast.Name
        named, names = self.found["name"]
        while stack:
            node, parent, slot, idx = pop()
            at += 1
            cls = node.__class__
            plan = plans.get(cls)
            kind, name, record, fields = _plan(cls) if plan is None else plan
            own = node.__dict__
            line = own.get("lineno", 0)
            row((kind, parent, slot, idx, line, own.get("end_lineno") or line))
            if name is not None:
                value = own.get(name)
                if value.__class__ is str:
                    named.append(at)
                    names.append(value)
            if slot in texts:  # before the callee is that of this row
                self.put("text", at, self.text(node, slot))
            if record is not None:
                fields = record(self, node, at, slot) or fields
            for field, inner, with_names in fields:
                value = own.get(field)
                if value.__class__ is list:
                    for i in range(len(value) - 1, -1, -1):
                        item = value[i]
                        c = item.__class__
                        if (is_node[c] if c in is_node else _is_node(c)) and (with_names or c is not plain):
                            push((item, at, inner, i))
                else:
                    c = value.__class__
                    if (is_node[c] if c in is_node else _is_node(c)) and (with_names or c is not plain):
                        push((value, at, inner, -1))

    def text(self, node: ast.AST, slot: int) -> str | None:
        name, _ = _SLOTS[slot]
        if name == "func":  # the callee of the row before
            return self.callee
        if name == "args" and type(node) is ast.Constant:
            return _utf8(repr(node.value))
        return _utf8(_unparsed(node))

    # What is recorded of some kinds: facts of a node's own, and of its children what the
    # rules ask: a call has shell=True, the form of a call's single argument (kind and operator
    # or number of parts), a handler names a type, the string an assignment assigns and the
    # names it assigns to (empty for other targets), a call is the context expression of a
    # plain `with`.

    def constant(self, node: ast.Constant, at: int, slot: int) -> None:
        value = node.value
        if isinstance(value, str):
            self.put("str_value", at, _utf8(value))
        self.put("const_repr", at, _utf8(repr(value)))
        if value is True:
            self.true.append(at)

    def operated(self, node: ast.AST, at: int, slot: int) -> None:
        self.put("op", at, type(node.op).__name__)

    def valued(self, node: ast.AST, at: int, slot: int) -> None:
        self.put("n_values", at, len(node.values))
        if type(node) is ast.BoolOp:
            self.operated(node, at, slot)

    def imported(self, node: ast.ImportFrom, at: int, slot: int) -> None:
        self.put("level", at, node.level)

    def call(self, node: ast.Call, at: int, slot: int) -> None:
        self.callee = _utf8(_unparsed(node.func))
        self.put("callee", at, self.callee)
        self.put("n_args", at, len(node.args))
        self.put("shell_true", at, any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords))
        if len(node.args) == 1:
            arg = node.args[0]
            detail = type(arg.op).__name__ if isinstance(arg, ast.BinOp) else len(arg.values) if isinstance(arg, ast.JoinedStr) else ""
            self.put("arg_form", at, f"{type(arg).__name__}:{detail}")
        self.put("in_with", at, slot == _PLAIN_CONTEXT)

    def handler(self, node: ast.ExceptHandler, at: int, slot: int) -> None:
        self.put("typed", at, node.type is not None)

    def assign(self, node: ast.Assign, at: int, slot: int) -> None:
        if isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
            self.put("assigned", at, _utf8(node.value.value))
        self.put("target_names", at, [t.id if isinstance(t, ast.Name) else t.attr if isinstance(t, ast.Attribute) else "" for t in node.targets])

    def with_item(self, node: ast.withitem, at: int, slot: int) -> tuple | None:
        return _PLAIN_ITEM if _SLOTS[slot] == ("items", "With") else None

    def numbers(self) -> tuple[np.ndarray, ...]:
        """Of every row: its six numbers, whether it is a status row, the place of its file's
        first node, the running decision weight in pre-order (nested-set prefix sum), and the
        last row of its subtree."""
        n = len(self)
        given = np.array(self.rows, dtype=np.int32).reshape(n, 6).T
        kind, parent = given[:2]
        starts = np.array([at for *_, at in self.files])
        status = np.zeros(n, dtype=bool)
        status[starts] = True
        first = np.repeat(starts + 1, np.diff(np.r_[starts, n]))
        # a subtree's last row: its last child's, and so on down
        last = np.arange(n)
        nodes = np.flatnonzero(~status)
        np.maximum.at(last, parent[nodes], nodes)
        while (down := last[last]).tobytes() != last.tobytes():
            last = down
        weight = np.isin(kind, [i for i, k in enumerate(_KINDS) if k in DECISION_KINDS]).astype(np.int64)
        places, values = (np.array(x, dtype=np.int64) for x in self.found["n_values"])
        both = kind[places] == _KINDS.index("BoolOp")
        weight[places[both]] = values[both] - 1
        total = np.cumsum(weight)
        return *given, status, first, total - total[first - 1], last

    def tuples(self) -> list[tuple]:
        """The rows, in NODE_SCHEMA's order."""
        n = len(self)
        kind, parent, slot, idx, line, end, status, first, weight, last = (x.tolist() for x in self.numbers())
        columns = {c: [None] * n for c in _SCHEMA.names}
        for name, (places, values) in self.found.items():
            column = columns[name]
            for at, value in zip(places, values):
                column[at] = value
        for place, (file_id, path, at) in enumerate(self.files):
            stop = self.files[place + 1][2] if place + 1 < len(self.files) else n
            columns["file_id"][at:stop], columns["path"][at:stop] = [file_id] * (stop - at), [path] * (stop - at)
        true = set(self.true)

        def shown(words: list, at: list) -> list:
            return [words[i] for i in at]
        columns |= {
            "node_id": [i - f for i, f in enumerate(first)], "kind": shown(_KINDS, kind), "parent_kind": shown([k for _, k in _SLOTS], slot),
            "slot": shown([s for s, _ in _SLOTS], slot), "slot_idx": [None if i < 0 else i for i in idx], "is_true": [i in true for i in range(n)],
            "line_start": [x or None for x in line], "line_end": [x or None for x in end]}
        of_nodes = {"parent_id": [p - f for p, f in zip(parent, first)], "subtree_end": [x - f for x, f in zip(last, first)],
                    "cw": weight, "cw_end": [weight[x] for x in last]}
        columns |= {name: [None if s else x for x, s in zip(values, status)] for name, values in of_nodes.items()}
        return list(zip(*columns.values()))

    def batch(self) -> pa.RecordBatch:
        n = len(self)
        kind, parent, slot, idx, line, end, status, first, weight, last = self.numbers()

        def ints(x: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
            return pa.array(x.astype(np.int32), mask=none)

        def shown(words: list, at: np.ndarray) -> pa.Array:
            return pa.array(words, pa.string()).take(pa.array(at))
        true = np.zeros(n, dtype=bool)
        true[self.true] = True
        file = np.cumsum(status) - 1
        columns = {
            "file_id": pa.array([f for f, *_ in self.files], pa.int64()).take(pa.array(file)), "path": shown([p for _, p, _ in self.files], file),
            "node_id": ints(np.arange(n) - first), "parent_id": ints(parent - first, status), "subtree_end": ints(last - first, status),
            "kind": shown(_KINDS, kind), "parent_kind": shown([k for _, k in _SLOTS], slot), "slot": shown([s for s, _ in _SLOTS], slot),
            "slot_idx": ints(idx, idx < 0), "is_true": pa.array(true), "line_start": ints(line, line == 0), "line_end": ints(end, end == 0),
            "cw": ints(weight, status), "cw_end": ints(weight[last], status)}
        for name, type_ in _SPARSE.items():
            places, values = self.found[name]
            at = np.full(n, -1)
            at[places] = np.arange(len(places))
            columns[name] = pa.array(values, type_).take(pa.array(at, mask=at < 0))
        return pa.RecordBatch.from_arrays([columns[f.name] for f in _SCHEMA], schema=_SCHEMA)


_RECORDED: dict[type, Callable] = {
    ast.Constant: _Nodes.constant, ast.BinOp: _Nodes.operated, ast.UnaryOp: _Nodes.operated, ast.AugAssign: _Nodes.operated, ast.BoolOp: _Nodes.valued,
    ast.JoinedStr: _Nodes.valued, ast.Dict: _Nodes.valued, ast.ImportFrom: _Nodes.imported, ast.Call: _Nodes.call, ast.ExceptHandler: _Nodes.handler,
    ast.Assign: _Nodes.assign, ast.withitem: _Nodes.with_item}
_plan(ast.BoolOp)
# the fields of an item of a plain `with`: its context expression has a slot of its own
_PLAIN_CONTEXT = _slot("context_expr", "withitem")
_PLAIN_ITEM = tuple((f, _PLAIN_CONTEXT if f == "context_expr" else inner, names) for f, inner, names in _plan(ast.withitem)[3])

_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in NODE_SCHEMA.split(", "))])


OUTPUT_ROWS = 20_000  # node rows held before they are handed on


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Nodes()
    for batch in batches:
        for fid, path, content in zip(*(batch.column(c).to_pylist() for c in ("file_id", "path", "content"))):
            held.add(int(fid), path, content if isinstance(content, str) else "")
            if len(held) >= OUTPUT_ROWS:
                yield held.batch()
                held = _Nodes()
    if len(held):
        yield held.batch()


def _rows(file_id: int, path: str, source: str) -> list[tuple]:
    held = _Nodes()
    held.add(file_id, path, source)
    return held.tuples()


def code_scan(sources: DataFrame) -> DataFrame:
    """Nodes and `$file` status rows of every Python source (file_id, path, content)."""
    return sources.select("file_id", "path", "content").mapInArrow(_parse_batches, NODE_SCHEMA)


def file_rows(file_id: int, path: str, content: str) -> list[tuple]:
    """Status row and node rows of one source, in NODE_SCHEMA's order."""
    return _rows(int(file_id), path, content)


def code_nodes(sources: DataFrame | None = None, scan: DataFrame | None = None) -> DataFrame:
    s = scan if scan is not None else code_scan(sources)
    return s.filter(F.col("node_id") >= 0)


def parse_status(sources: DataFrame | None = None, scan: DataFrame | None = None) -> DataFrame:
    """success, error_message, lines_of_code and parser version per file."""
    s = scan if scan is not None else code_scan(sources)
    return s.filter(F.col("node_id") == -1).select(
        "file_id", "path", F.col("is_true").alias("success"), F.col("str_value").alias("error_message"),
        F.col("n_args").alias("lines_of_code"), F.col("const_repr").alias("parser_version"))
