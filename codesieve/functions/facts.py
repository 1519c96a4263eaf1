"""Code facts: one Arrow UDF that turns Python source text into flat, typed facts.

This is the only step that needs a Python worker, because only the Python parser can read
Python.  It decides nothing: it lists calls, string additions, constant conditions, attribute
assignments, imports and functions.  Every rule is a column expression over these facts
(see ``structural.py``).
"""

from __future__ import annotations

import ast
import gc
import warnings

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

# seq numbers the nodes of a file breadth first, the order in which matches are listed
_POSITION = [("line", pa.int32()), ("col", pa.int32()), ("seq", pa.int32())]
FACTS_ARROW_TYPE = pa.struct([
    ("parsed", pa.bool_()),
    ("calls", pa.list_(pa.struct(_POSITION + [
        ("name2", pa.string()), ("name2_strict", pa.string()), ("name_full", pa.string()),
        ("attr", pa.string()), ("is_bare", pa.bool_()),
        ("args", pa.list_(pa.struct([(n, pa.string()) for n in
                                     ("kind", "const_str", "name_id", "attr_full", "op")]))),
        ("kwargs", pa.list_(pa.struct([("arg", pa.string()), ("const", pa.string())]))),
        ("handlers", pa.list_(pa.string()))]))),
    ("concats", pa.list_(pa.struct(_POSITION + [("left_str", pa.string()), ("right_str", pa.string())]))),
    ("true_ifs", pa.list_(pa.struct(_POSITION))),
    ("attr_assigns", pa.list_(pa.struct(_POSITION + [("attr", pa.string()), ("is_const", pa.bool_())]))),
    ("imports", pa.list_(pa.string())),
    ("functions", pa.list_(pa.struct([
        ("name", pa.string()), ("line_number", pa.int32()), ("args", pa.list_(pa.string())),
        ("decorators", pa.list_(pa.string())), ("has_docstring", pa.bool_()),
        ("complexity", pa.int32())]))),
])

# Facts are turned into Arrow after this many texts, so few Python objects live at a time.
CHUNK_ROWS = 256

_DECISIONS = {ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.BoolOp, ast.comprehension}
# Nodes without children or facts of their own; half of a tree, never visited.
_LEAVES = {ast.Name, ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal} | {
    kind for kind in vars(ast).values() if isinstance(kind, type)
    and issubclass(kind, (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop))}


# What a field may hold besides nodes to visit.
_NO_NODES = _LEAVES | {type(None), str, bytes, bool, int, float, complex, type(...)}
# Fields that never hold a node to visit.
_NO_FIELDS = {"ctx", "op", "ops", "id", "attr", "arg", "type_comment", "kind", "level", "module", "asname", "conversion",
              "simple", "is_async", "tag"}
# The other fields of each kind of node; nodes of most other kinds are visited without a look at what they are.
_FIELDS = {kind: tuple(name for name in kind._fields if name not in _NO_FIELDS)
           for kind in vars(ast).values() if isinstance(kind, type) and issubclass(kind, ast.AST)}
_TELLING = {ast.Call, ast.BinOp, ast.If, ast.Assign, ast.FunctionDef, ast.Import, ast.ImportFrom, ast.ExceptHandler}


def _text(value: str) -> str:
    """Arrow strings are UTF-8, so lone surrogates of escaped literals are replaced."""
    return value.encode("utf-8", "replace").decode("utf-8")


def _string(node: ast.AST) -> str | None:
    is_string = isinstance(node, ast.Constant) and isinstance(node.value, str)
    return _text(node.value) if is_string else None


def _dotted(node: ast.AST) -> str:
    """Name through attributes; the chain starts at the first part that is a name or attribute."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def _names(func: ast.AST) -> dict:
    full = _dotted(func)
    if isinstance(func, ast.Name):
        short = strict = func.id
    elif isinstance(func, ast.Attribute):
        plain = isinstance(func.value, ast.Name)
        short, strict = (full, full) if plain else (func.attr, "")
    else:
        short = strict = ""
    return {"name2": short, "name2_strict": strict, "name_full": full,
            "attr": func.attr if isinstance(func, ast.Attribute) else None,
            "is_bare": isinstance(func, ast.Name)}


def _argument(node: ast.AST) -> dict:
    fact = {"kind": "other"}
    if (value := _string(node)) is not None:
        fact = {"kind": "string", "const_str": value}
    elif isinstance(node, ast.Name):
        fact = {"kind": "name", "name_id": node.id}
    elif isinstance(node, ast.Attribute):
        fact = {"kind": "attribute", "attr_full": _dotted(node)}
    elif isinstance(node, ast.BinOp):
        fact = {"kind": "binop", "op": type(node.op).__name__}
    elif isinstance(node, ast.JoinedStr):
        fact = {"kind": "fstring"}
    elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "format":
        fact = {"kind": "format_call"}
    return fact


def _keyword(node: ast.keyword) -> dict:
    const = None
    if isinstance(node.value, ast.Constant):
        const = "true" if node.value.value is True else "other"
    return {"arg": node.arg, "const": const}


def _decorator(node: ast.AST) -> str:
    target = node.func if isinstance(node, ast.Call) else node
    return getattr(target, "attr", None) or getattr(target, "id", None) or "unknown"


def _function(node: ast.FunctionDef) -> dict:
    first = node.body[0]
    return {"name": node.name, "line_number": node.lineno, "args": [a.arg for a in node.args.args],
            "decorators": [_decorator(d) for d in node.decorator_list],
            "has_docstring": isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant),
            "complexity": 1}


def _at(node: ast.AST, seq: int) -> dict:
    return {"line": node.lineno, "col": node.col_offset, "seq": seq}


def source_facts(text: str) -> dict:
    """Facts of one source text; a text that does not parse has none."""
    facts = {"parsed": False, "calls": [], "concats": [], "true_ifs": [], "attr_assigns": [],
             "imports": [], "functions": []}
    try:
        tree = compile(text, "<unknown>", "exec", ast.PyCF_ONLY_AST)
    except Exception:  # syntax errors, but also null bytes, too deep nesting or too large numbers
        return facts
    facts["parsed"] = True
    # Each entry carries the functions it lies in and the names of enclosing exception handlers.
    # The queue grows while it is read: breadth first.
    queue = [(tree, (), ())]
    for seq, (node, inside, handlers) in enumerate(queue, 1):
        kind = type(node)
        if inside and kind in _DECISIONS:
            for fact in inside:
                fact["complexity"] += 1
        if kind not in _TELLING:
            pass
        elif kind is ast.Call:
            facts["calls"].append(_at(node, seq) | _names(node.func) | {
                "args": [_argument(a) for a in node.args],
                "kwargs": [_keyword(k) for k in node.keywords], "handlers": handlers})
        elif kind is ast.BinOp:
            if type(node.op) is ast.Add:
                left, right = _string(node.left), _string(node.right)
                if left is not None or right is not None:
                    facts["concats"].append(_at(node, seq) | {"left_str": left, "right_str": right})
        elif kind is ast.If:
            if isinstance(node.test, ast.Constant) and node.test.value is True:
                facts["true_ifs"].append(_at(node, seq))
        elif kind is ast.Assign:
            constant = isinstance(node.value, ast.Constant)
            facts["attr_assigns"] += [_at(node, seq) | {"attr": target.attr, "is_const": constant}
                                      for target in node.targets if isinstance(target, ast.Attribute)]
        elif kind is ast.FunctionDef:
            facts["functions"].append(_function(node))
            inside = inside + (facts["functions"][-1],)
        elif kind is ast.Import:
            facts["imports"] += [alias.name for alias in node.names]
        elif kind is ast.ImportFrom:
            if node.module:
                facts["imports"].append(node.module)
        elif node.name:
            handlers = handlers + (node.name,)
        for name in _FIELDS[kind]:
            value = getattr(node, name)
            if type(value) is list:
                for child in value:
                    if type(child) not in _NO_NODES:
                        queue.append((child, inside, handlers))
            elif type(value) not in _NO_NODES:
                queue.append((value, inside, handlers))
    return facts


@F.arrow_udf(from_arrow_type(FACTS_ARROW_TYPE))
def code_facts(texts: pa.Array) -> pa.Array:
    """Facts of a batch of Python sources; null text gives null facts."""
    # Trees and facts hold no cycles, so the cycle collector would only walk them in vain.
    collecting = gc.isenabled()
    gc.disable()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            parts = [pa.array([None if t is None else source_facts(t)
                               for t in texts.slice(start, CHUNK_ROWS).to_pylist()], type=FACTS_ARROW_TYPE)
                     for start in range(0, len(texts), CHUNK_ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], type=FACTS_ARROW_TYPE)
    finally:
        if collecting:
            gc.enable()
