"""Syntax trees as rows: Python sources parsed in Arrow batches, one row for each definition, reference and site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "path string, kind string, name string, parent string, line int, end_line int, n_params int, nesting int, complexity int, "
    "has_doc boolean, bases array<string>, value string"
)


def _rows(path: str, source: str | None, kinds: tuple[str, ...] = ()) -> list[tuple]:
    """kind is module, function, class, import, export, call, name, attribute, read, write, handler, dead, literal or error.

    With `kinds`, other rows can lack. A function's bases are its decorators; an import's has_doc says that only type checkers read it; exports are the names of __all__.
    """
    import ast

    out: list[tuple] = []

    def add(kind, name, parent, node, n_params=None, nesting=None, complexity=None, has_doc=None, bases=None, value=None):
        out.append((path, kind, name, parent, getattr(node, "lineno", 0), getattr(node, "end_lineno", 0), n_params, nesting, complexity, has_doc, bases, value))

    source = source or ""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [(path, "error", None, None, 0, 0, None, None, None, None, None, None)]
    blocks = (ast.If, ast.For, ast.While, ast.With, ast.Try, ast.AsyncFor, ast.AsyncWith)
    ends = (ast.Return, ast.Raise, ast.Break, ast.Continue)

    whole = not kinds or "function" in kinds

    def children(node):
        out = []
        for f in node._fields:
            v = getattr(node, f, None)
            if v.__class__ is list:
                out += [x for x in v if isinstance(x, ast.AST)]
            elif isinstance(v, ast.AST) and not isinstance(v, ast.expr_context):
                out.append(v)
        return out

    def walk(node):
        left = [node]
        for n in left:
            left += children(n)
        return left

    def deepest(node, depth=0):
        return max([depth, *(deepest(c, depth + isinstance(c, blocks)) for c in children(node) if not isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)))])

    def branches(node):
        n = 1
        for c in walk(node):
            n += isinstance(c, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.ExceptHandler, ast.Assert))
            n += len(c.values) - 1 if isinstance(c, ast.BoolOp) else 0
            n += sum(len(g.ifs) for g in c.generators) if isinstance(c, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)) else 0
        return n

    def dotted(node):
        return f"{dotted(node.value)}.{node.attr}" if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else ""

    def type_checking(node):
        return isinstance(node, ast.If) and (isinstance(node.test, ast.Name) and node.test.id or isinstance(node.test, ast.Attribute) and node.test.attr) == "TYPE_CHECKING"

    #: Lines of blocks that only type checkers read.
    typing_only = {n.lineno for block in (walk(tree) if "TYPE_CHECKING" in source or not source.isascii() else ()) if type_checking(block) for s in block.body for n in ast.walk(s) if hasattr(n, "lineno")}

    def visit(node, parent):
        if not isinstance(node, ast.expr):
            for body in (getattr(node, f, None) for f in ("body", "orelse", "finalbody")):
                if isinstance(body, list):
                    for a, b in zip(body, body[1:]):
                        if isinstance(a, ends):
                            add("dead", type(b).__name__, parent, b)
        inner = parent
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            if whole:
                a = node.args
                params = [p.arg for p in (*a.posonlyargs, *a.args, *a.kwonlyargs) if p.arg not in ("self", "cls")]
                marks = [dotted(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]
                add("function", node.name, parent, node, len(params), deepest(node), branches(node), ast.get_docstring(node) is not None, marks, ",".join(params))
            inner = f"{parent}.{node.name}" if parent else node.name
        elif isinstance(node, ast.ClassDef):
            add("class", node.name, parent, node, has_doc=ast.get_docstring(node) is not None, bases=[dotted(b) for b in node.bases])
            inner = f"{parent}.{node.name}" if parent else node.name
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            for n in node.names:
                module = n.name if isinstance(node, ast.Import) else f"{node.module or ''}.{n.name}"
                add("import", (n.asname or n.name).split(".")[0], parent, node, has_doc=node.lineno in typing_only, value=module)
        elif isinstance(node, ast.Assign) and isinstance(node.value, ast.List) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets):
            for e in node.value.elts:
                if isinstance(e, ast.Constant) and isinstance(e.value, str):
                    add("export", e.value, parent, e)
        elif isinstance(node, ast.Call):
            add("call", dotted(node.func), parent, node, len(node.args) + len(node.keywords))
        elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
            add("name", node.id, parent, node)
        elif isinstance(node, ast.Attribute):
            add("attribute", node.attr, parent, node)
            target = dotted(node)
            if target.startswith("self."):
                add("write" if isinstance(node.ctx, ast.Store) else "read", target[5:], parent, node)
        elif isinstance(node, ast.ExceptHandler):
            only_pass = all(isinstance(s, ast.Pass) for s in node.body)
            add("handler", dotted(node.type) if node.type else "bare", parent, node, value="empty" if only_pass else "body")
        elif isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str)) and not isinstance(node.value, bool):
            add("literal", type(node.value).__name__, parent, node, value=str(node.value)[:200])
        for c in children(node):
            visit(c, inner)

    try:
        visit(tree, "")
    except RecursionError:
        return [(path, "error", None, None, 0, 0, None, None, None, None, None, None)]
    add("module", path, None, tree, has_doc=ast.get_docstring(tree) is not None)
    return out


def spread(files: DataFrame) -> DataFrame:
    """The files dealt over all tasks: a table that is small on disk is read by few, and reading is far cheaper than parsing."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def parse(files: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Rows of SCHEMA for Python files (path, content), of these kinds only if any are named; a file that does not parse has one row of kind error, always."""

    def run(batches):
        import pyarrow as pa

        types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
        fields = [pa.field(c.split()[0], types[c.split()[1]]) for c in SCHEMA.split(", ")]

        def out(rows):
            columns = list(zip(*rows)) if rows else [[]] * len(fields)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))

        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = _rows(path, content.as_py(), kinds)
                rows += [r for r in found if r[1] in kinds or r[1] == "error"] if kinds else found
                if len(rows) > 20_000:
                    yield out(rows)
                    rows = []
            yield out(rows)

    return spread(files.select("path", "content")).mapInArrow(run, SCHEMA)


def terms(files: DataFrame) -> DataFrame:
    """path, kind (operator or operand), term: a row for each operator, name and constant of the files that parse."""

    def run(batches):
        import ast

        import pyarrow as pa

        signs = (ast.operator, ast.boolop, ast.cmpop, ast.Not)
        left_out = (ast.LShift, ast.RShift, ast.BitOr, ast.BitXor, ast.BitAnd, ast.MatMult)
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    tree = ast.parse(content.as_py() or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                for n in ast.walk(tree):
                    if isinstance(n, signs) and not isinstance(n, left_out):
                        rows.append((path, "operator", type(n).__name__))
                    elif isinstance(n, ast.Name):
                        rows.append((path, "operand", n.id))
                    elif isinstance(n, ast.Constant):
                        rows.append((path, "operand", str(n.value)))
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "kind", "term"])

    return spread(files.select("path", "content")).mapInArrow(run, "path string, kind string, term string")


def halstead(files: DataFrame) -> DataFrame:
    """path, vocabulary, length, volume, difficulty, effort: from the different and all operators and operands."""
    sign = F.col("kind") == "operator"
    g = terms(files).groupBy("path").agg(
        F.countDistinct(F.when(sign, F.col("term"))).alias("n1"), F.countDistinct(F.when(~sign, F.col("term"))).alias("n2"), F.count_if(sign).alias("all1"), F.count_if(~sign).alias("all2")
    )
    g = g.select("path", "n1", "n2", "all2", (F.col("n1") + F.col("n2")).alias("vocabulary"), (F.col("all1") + F.col("all2")).alias("length"))
    volume = F.when(F.col("vocabulary") > 0, F.col("length") * F.log2("vocabulary")).otherwise(0.0)
    difficulty = F.when(F.col("n2") > 0, F.col("n1") / 2 * (F.col("all2") / F.col("n2"))).otherwise(0.0)
    return g.select("path", "vocabulary", "length", volume.alias("volume"), difficulty.alias("difficulty"), (difficulty * volume).alias("effort"))
