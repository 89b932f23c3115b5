"""Python sources as tables: definitions, calls, class bodies, routers; and structural equality. The grammar needs Python on the executors.

Trees are walked with a stack and texts are cut out of the source, so that deeply nested code costs no recursion; what even
the parser can't take is an error row (or a null structure), never a failed job.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTS = "path string, kind string, name string, text string, line int, end_line int, symbol string, holder string, owner string"
_FIELDS = ("path", "kind", "name", "text", "line", "end_line", "symbol", "holder", "owner")
_KINDS = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string()] * 3
#: Calls that inject a dependency into a signature, a route or a router.
INJECTORS = ("Depends", "Security")
_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def parsed(source: str | None) -> ast.Module | None:
    try:
        return ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def canonical(source: str | None) -> str | None:
    """The structure of a module without comments, layout and bare strings; null if it does not parse."""
    tree = None if source is None else parsed(source)
    if tree is None:
        return None
    out: list[str] = []
    stack: list[tuple[bool, object]] = [(False, tree)]
    while stack:
        written, node = stack.pop()
        if written:
            out.append(node)
        elif isinstance(node, ast.AST):
            out.append(f"{type(node).__name__}(")
            stack.append((True, ")"))
            for name, value in reversed(list(ast.iter_fields(node))):
                if name == "body" and isinstance(value, list):
                    value = [s for s in value if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str))] or [ast.Pass()]
                stack += [(False, value), (True, f"{name}=")]
        elif isinstance(node, list):
            out.append("[")
            stack.append((True, "]"))
            stack += [(False, x) for x in reversed(node)]
        else:
            out.append(f"{node!r},")
    return "".join(out)


def _dotted(node: ast.AST) -> str:
    """a.b.c of a chain of attributes; what a call returns counts by the call's own name."""
    parts = []
    while isinstance(node, (ast.Attribute, ast.Call)):
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        else:
            node = node.func
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


class _Source:
    """Texts of nodes by their byte columns."""

    def __init__(self, source: str) -> None:
        # the grammar ends lines at line feeds and carriage returns alone
        self.lines = [x.encode("utf-8", "replace") for x in re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", source)] or [b""]

    def text(self, node: ast.AST) -> str:
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            return self.lines[first][node.col_offset : node.end_col_offset].decode("utf-8", "replace")
        parts = [self.lines[first][node.col_offset :], *self.lines[first + 1 : last], self.lines[last][: node.end_col_offset]]
        return b"".join(parts).decode("utf-8", "replace")


def _injected(node: ast.AST | None) -> list[str]:
    """Last names of what Depends(...) and Security(...) within a node inject, in source order."""
    calls = [n for n in ast.walk(node) if isinstance(n, ast.Call) and _dotted(n.func).rsplit(".", 1)[-1] in INJECTORS and n.args] if node is not None else []
    return [_dotted(n.args[0]).rsplit(".", 1)[-1] for n in sorted(calls, key=lambda n: (n.lineno, n.col_offset)) if _dotted(n.args[0])]


def _keyword(call: ast.Call, name: str) -> ast.AST | None:
    return next((k.value for k in call.keywords if k.arg == name), None)


def facts_of(path: str, source: str | None) -> list[tuple]:
    """FACTS rows of a file, in source order within each kind.

    symbol: the definition that holds (or is) the row, with its path, so that files of one name stay apart; holder: the
    innermost function around it, owner: the innermost class around it. kind and name: function and class (own names),
    decorator, call, attribute and assignment (dotted names), base (of a class), entry (a name in a list that a class
    assigns; text is the attribute), import (module), router (a name bound to a call; text is a dependency of its), injected
    (a dependency in a signature), route_dependency (in a decorator; text is its name), string (its lines), error.
    """
    tree = parsed(source)
    if tree is None:
        return [(path, "error", None, "does not parse", 0, 0, None, None, None)]
    src, out = _Source(source or ""), []

    def row(kind: str, name: str | None, text: str, node: ast.AST, symbol: str, holder: str | None, owner: str | None) -> None:
        out.append((path, kind, name, text, node.lineno, node.end_lineno, symbol, holder, owner))

    stack: list[tuple[ast.AST, str, str | None, str | None]] = [(tree, f"{path}:", None, None)]
    while stack:
        node, symbol, holder, owner = stack.pop()
        inner = (symbol, holder, owner)
        if isinstance(node, _DEFINITIONS):
            own = symbol + ("" if symbol.endswith(":") else ".") + node.name
            is_class = isinstance(node, ast.ClassDef)
            inner = (own, holder, node.name) if is_class else (own, own, owner)
            args = "" if is_class else ", ".join(a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs))
            row("class" if is_class else "function", node.name, args, node, own, inner[1], owner)
            for d in node.decorator_list:
                row("decorator", _dotted(d.func if isinstance(d, ast.Call) else d), src.text(d), d, own, inner[1], owner)
                if isinstance(d, ast.Call):
                    for dep in _injected(_keyword(d, "dependencies")):
                        row("route_dependency", dep, _dotted(d.func), d, own, inner[1], owner)
            if is_class:
                for b in node.bases:
                    row("base", _dotted(b), "", b, own, holder, owner)
                for s in node.body:
                    if isinstance(s, ast.Assign) and isinstance(s.value, (ast.List, ast.Tuple)):
                        for e in s.value.elts:
                            if name := _dotted(e.func if isinstance(e, ast.Call) else e):
                                row("entry", name.rsplit(".", 1)[-1], _dotted(s.targets[0]), e, own, holder, node.name)
            else:
                for default in (*node.args.defaults, *(x for x in node.args.kw_defaults if x is not None)):
                    for dep in _injected(default):
                        row("injected", dep, "", default, own, own, owner)
        elif isinstance(node, ast.Call):
            row("call", _dotted(node.func), src.text(node), node, symbol, holder, owner)
        elif isinstance(node, ast.Attribute) and isinstance(node.ctx, ast.Load):
            row("attribute", _dotted(node), "", node, symbol, holder, owner)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                row("assignment", _dotted(target), src.text(node), node, symbol, holder, owner)
                if isinstance(node.value, ast.Call) and symbol.endswith(":"):
                    for dep in _injected(_keyword(node.value, "dependencies")) or [""]:
                        row("router", _dotted(target), dep, node, symbol, holder, owner)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            for name in [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""]:
                row("import", name, "", node, symbol, holder, owner)
        elif isinstance(node, (ast.JoinedStr, ast.Constant)) and (isinstance(node, ast.JoinedStr) or isinstance(node.value, (str, bytes))):
            row("string", None, "", node, symbol, holder, owner)
        # decorators and defaults belong to what is around a definition
        outer = [*node.decorator_list, *(() if isinstance(node, ast.ClassDef) else (*node.args.defaults, *(x for x in node.args.kw_defaults if x is not None)))] if isinstance(node, _DEFINITIONS) else []
        skip = set(map(id, outer))
        children = [(c, *inner) for c in ast.iter_child_nodes(node) if id(c) not in skip and not isinstance(c, ast.arguments)]
        stack += reversed([*((c, symbol, holder, owner) for c in outer), *children])
    return out


def scan_sources(files: DataFrame) -> DataFrame:
    """FACTS of every (path, text); other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                columns = list(zip(*facts_of(path, text), strict=True)) or [[]] * len(_FIELDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=list(_FIELDS))

    return files.select("path", "text").mapInArrow(run, FACTS)


def scan_paths(files: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FACTS of the listed paths (column path) alone, and (path, problem) of those that are missing or do not parse."""
    wanted = paths.select("path").distinct()
    facts = scan_sources(files.join(wanted, "path", "left_semi"))
    missing = wanted.join(files.select("path"), "path", "left_anti").select("path", F.lit("missing").alias("problem"))
    return facts, missing.unionByName(facts.where("kind = 'error'").select("path", F.lit("does not parse").alias("problem")))


def source_trees(before: DataFrame, after: DataFrame, paths: DataFrame, same_tree: bool = False) -> DataFrame:
    """path, before, after: texts of the listed paths on either side, null where a side lacks one; before is null for all if both are one tree."""
    old = before.select("path", F.lit(None).cast("string").alias("before") if same_tree else F.col("text").alias("before"))
    return paths.select("path").distinct().join(old, "path", "left").join(after.select("path", F.col("text").alias("after")), "path", "left")


def equal_structure(pairs: DataFrame) -> DataFrame:
    """pairs (…, before, after) with equal: both parse and have one structure. A parse error is never equal."""
    schema = pairs.withColumn("equal", F.lit(True)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before, after = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("before", "after"))
            same = [(c := canonical(x)) is not None and c == canonical(y) for x, y in zip(before, after, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(same)], names=schema.names)

    return pairs.mapInArrow(run, schema)


def string_lines(facts: DataFrame) -> DataFrame:
    """path, start, end of literals that go on over several lines: what looks like a comment inside is text."""
    return facts.where("kind = 'string' and end_line > line").select("path", F.col("line").alias("start"), F.col("end_line").alias("end"))


def call_edges(facts: DataFrame) -> DataFrame:
    """src, dst: each call to the first function of its last name in the same file; calls to others, and from outside functions, have no edge."""
    f = facts.where("kind = 'function'").groupBy("path", "name").agg(F.min_by("symbol", F.struct("line", "symbol")).alias("dst"))
    calls = facts.where("kind = 'call' and holder is not null").select("path", F.element_at(F.split("name", r"\."), -1).alias("name"), F.col("holder").alias("src"))
    return calls.join(f, ["path", "name"]).select("src", "dst").distinct()
