"""What Python files say about the flow of values, as rows: definitions, uses, calls, returns, imports, constants."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from quarry.sources.python_ast import spread

#: src_kind is var, source, call or none; dst_kind is def, param, arg, ret or sink. `cleaned` are the labels that sanitisers on the way take.
FLOWS = "path string, scope string, seq int, line int, src_kind string, src string, confidence double, dst_kind string, dst string, pos int, label string, cleaned array<string>, by array<string>"
IMPORTS = "path string, alias string, module string, symbol string, level int, line int"
CONSTANTS = "path string, name string, line int"


def dotted(node) -> str:
    """a.b.c of names and attributes; an attribute of anything else is its own name."""
    import ast

    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    return ""


def _statements(tree) -> list:
    """All statements of a tree, and the handlers and cases that hold some; expressions are not walked."""
    left = [tree]
    for n in left:
        for f in ("body", "orelse", "finalbody", "handlers", "cases"):
            if (inner := getattr(n, f, None)).__class__ is list:
                left += inner
    return left


def _each(files: DataFrame, rows_of: Callable[[str, object], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that `rows_of` (path, tree) gives for each file that parses."""

    def run(batches):
        import ast

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows += rows_of(path, ast.parse(content.as_py() or ""))
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
            columns = list(zip(*rows)) if rows else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    import pyarrow as pa

    types = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
    arrow = pa.schema([(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")])
    return spread(files.select("path", "content")).mapInArrow(run, schema)


def imports(files: DataFrame) -> DataFrame:
    """A row for each imported name. `from a import b` also stands as the module a.b, with no symbol."""

    def rows_of(path, tree):
        import ast

        for n in _statements(tree):
            if isinstance(n, ast.Import):
                for a in n.names:
                    yield path, a.asname or a.name, a.name, None, 0, n.lineno
            elif isinstance(n, ast.ImportFrom):
                for a in n.names:
                    yield path, a.asname or a.name, n.module or "", a.name, n.level or 0, n.lineno
                    yield path, a.asname or a.name, f"{n.module}.{a.name}" if n.module else a.name, None, n.level or 0, n.lineno

    return _each(files, rows_of, IMPORTS)


def constants(files: DataFrame) -> DataFrame:
    """Upper-case names that are given a literal at the top of a file."""

    def rows_of(path, tree):
        import ast

        for n in tree.body:
            if isinstance(n, ast.Assign):
                v = n.value.operand if isinstance(n.value, ast.UnaryOp) and isinstance(n.value.op, ast.USub) else n.value
                literal = isinstance(v, (ast.List, ast.Dict)) or isinstance(v, ast.Constant) and v.value is not None
                yield from ((path, t.id, n.lineno) for t in n.targets if isinstance(t, ast.Name) and t.id.isupper() and literal)

    return _each(files, rows_of, CONSTANTS)


def flows(files: DataFrame, sources: tuple[str, ...], sinks: dict[str, str], sanitizers: dict[str, set[str]], confidence: float = 0.9) -> DataFrame:
    """Rows of FLOWS, in the order of the statements of each function (`seq`); scope is the function's name and line, '' outside of any.
    Each function has a param row of position -1; a param row's label is the function's name.

    A value flows from variables, sources and calls through names, +, f-strings and arguments; a sanitiser on the way takes labels.
    """

    def rows_of(path, tree):
        import ast

        out: list[tuple] = []
        seq = [0]

        def is_source(name):
            return any(name == s or name.startswith(s + ".") for s in sources)

        def carried(n, cleaned=frozenset(), by=()):
            """(kind, name, cleaned, by) of what an expression's value comes from."""
            if isinstance(n, ast.Await):
                yield from carried(n.value, cleaned, by)
            elif isinstance(n, (ast.Name, ast.Attribute)):
                name = dotted(n)
                yield ("source" if is_source(name) else "var"), name, cleaned, by
            elif isinstance(n, ast.Subscript) and is_source(dotted(n.value)):
                yield "source", dotted(n.value), cleaned, by
            elif isinstance(n, ast.JoinedStr):
                for v in n.values:
                    if isinstance(v, ast.FormattedValue):
                        yield from carried(v.value, cleaned, by)
            elif isinstance(n, ast.BinOp):
                yield from carried(n.left, cleaned, by)
                yield from carried(n.right, cleaned, by)
            elif isinstance(n, ast.Call):
                name = dotted(n.func)
                if is_source(name):
                    yield "source", name, cleaned, by
                    return
                last = name.rpartition(".")[2]
                if last in sanitizers:
                    cleaned, by = cleaned | sanitizers[last], (*by, last)
                if name:
                    yield "call", name, cleaned, by
                for a in (*n.args, *(k.value for k in n.keywords)):
                    yield from carried(a, cleaned, by)

        def flow(scope, node, values, dst_kind, dst, pos=None, label=None, bare=False):
            found = [c for v in values for c in carried(v)]
            if bare or dst_kind == "def" and not found:
                found = [("none", None, frozenset(), ())]
            for kind, name, cleaned, by in dict.fromkeys(found):
                out.append((path, scope, seq[0], getattr(node, "lineno", 0), kind, name, confidence if kind == "source" else None, dst_kind, dst, pos, label, sorted(cleaned), list(by)))

        def calls(scope, node):
            for n in ast.walk(node):
                if isinstance(n, ast.Call) and (name := dotted(n.func)):
                    for i, a in enumerate(n.args):
                        flow(scope, n, [a], "arg", name, i)
                    if label := sinks.get(name.rpartition(".")[2]):
                        flow(scope, n, [*n.args, *(k.value for k in n.keywords)], "sink", name, None, label)

        def visit(scope, body):
            for n in body:
                seq[0] += 1
                if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    outer, seq[0] = seq[0], -1
                    names = [a.arg for a in (*n.args.posonlyargs, *n.args.args) if a.arg not in ("self", "cls")]
                    inner = f"{n.name}@{n.lineno}"  # a file can have several functions of one name
                    for i, name in enumerate(["", *names]):
                        flow(inner, n, [], "param", name, i - 1, n.name, bare=True)
                    visit(inner, n.body)
                    seq[0] = outer
                    continue
                if isinstance(n, ast.ClassDef):
                    visit(scope, n.body)
                    continue
                blocks = [b for f in ("body", "orelse", "finalbody") for b in [getattr(n, f, None)] if isinstance(b, list)]
                heads = [c for c in ast.iter_child_nodes(n) if isinstance(c, (ast.expr, ast.withitem))]
                for h in heads:
                    calls(scope, h)
                if isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and n.value is not None:
                    values = [n.value, n.target] if isinstance(n, ast.AugAssign) else [n.value]
                    for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                        if name := dotted(t):
                            flow(scope, n, values, "def", name)
                if isinstance(n, ast.Return) and n.value is not None:
                    flow(scope, n, [n.value], "ret", scope)
                for b in blocks:
                    visit(scope, b)
                for h in getattr(n, "handlers", []):
                    visit(scope, h.body)
                for c in getattr(n, "cases", []):
                    visit(scope, c.body)

        visit("", tree.body)
        return out

    return _each(files, rows_of, FLOWS)
