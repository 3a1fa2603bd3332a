"""Chunking of files: by lines, by definitions, and greedy packing of units under a token budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def definitions(files: DataFrame, tree: DataFrame) -> DataFrame:
    """path, name, chunk_type, start, end, content of each top-level definition; a file without any is one module chunk."""
    d = tree.where("kind in ('function', 'class') and parent = ''").select("path", "name", F.col("kind").alias("chunk_type"), F.col("line").alias("start"), F.col("end_line").alias("end"))
    j = files.select("path", "content").join(d, "path", "left")
    n = F.size(F.split("content", "\n"))
    text = F.array_join(F.slice(F.split("content", "\n"), F.coalesce("start", F.lit(1)), F.greatest(F.coalesce(F.col("end") - F.col("start") + 1, n), F.lit(1))), "\n")
    return j.where(F.col("content").isNotNull()).select("path", F.coalesce("name", F.lit("module")).alias("name"), F.coalesce("chunk_type", F.lit("module")).alias("chunk_type"), F.coalesce("start", F.lit(1)).alias("start"), F.coalesce("end", n).alias("end"), text.alias("content"))


def packed_units(units: DataFrame, budget: int, overhead: int = 0, least: int = 0) -> DataFrame:
    """Adds chunk: units (path, line, tokens) of a file go in order into the open chunk until one does not fit.

    A chunk starts at `overhead` tokens; units under `least` tokens are left out. The fold resets at each
    chunk, so it runs over each file's units in one sorted pass.
    """
    schema = "path string, line int, tokens int, chunk int"

    def run(batches):
        now, chunk, used = None, 0, overhead
        for pdf in batches:
            out = []
            for path, line, tokens in pdf[["path", "line", "tokens"]].itertuples(index=False):
                if path != now:
                    now, chunk, used = path, 0, overhead
                if used > overhead and used + tokens > budget:
                    chunk, used = chunk + 1, overhead
                used += tokens
                out.append((path, line, tokens, chunk))
            yield pd.DataFrame(out, columns=["path", "line", "tokens", "chunk"])

    rows = units.where(F.col("tokens") >= least).select("path", F.col("line").cast("int").alias("line"), F.col("tokens").cast("int").alias("tokens"))
    return rows.repartition("path").sortWithinPartitions("path", "line").mapInPandas(run, schema)


def _ends(files: DataFrame, start: str, close) -> DataFrame:
    """path, line, last of each block that a line matching `start` opens, by `close` over a file's lines in order."""

    def run(batches):
        import re

        import pyarrow as pa

        head = re.compile(start)
        for batch in batches:
            rows = [(path, a, b) for path, content in zip(batch.column(0).to_pylist(), batch.column(1)) for a, b in close((content.as_py() or "").split("\n"), head)]
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32()))], names=["path", "line", "last"])

    return files.select("path", "content").mapInArrow(run, "path string, line int, last int")


def _by_indent(rows: list[str], head):
    open_heads: list[tuple[int, int]] = []  # (line, indent), each deeper than the one before
    filled = 0  # the last line that is not blank
    for i, row in enumerate(rows, 1):
        if not row.strip():
            continue
        indent = len(row) - len(row.lstrip())
        while open_heads and indent <= open_heads[-1][1]:
            yield open_heads.pop()[0], filled
        if head.search(row):
            open_heads.append((i, indent))
        filled = i
    yield from ((line, filled) for line, _ in open_heads)


def _by_brace(rows: list[str], head):
    open_heads: list[list] = []  # [line, depth before it, whether a brace has opened]
    depth = 0
    for i, row in enumerate(rows, 1):
        if head.search(row):
            open_heads.append([i, depth, False])
        depth += row.count("{") - row.count("}")
        for h in open_heads:
            h[2] |= "{" in row
        yield from ((h[0], i) for h in open_heads if h[2] and depth <= h[1])
        open_heads = [h for h in open_heads if not (h[2] and depth <= h[1])]
    yield from ((h[0], len(rows)) for h in open_heads)


def indented_blocks(files: DataFrame, start: str) -> DataFrame:
    """The blocks that a matching line opens by indentation: they end before the first later line that is neither
    blank nor deeper, without the blank lines before it. One pass over a file, with the open blocks on a stack."""
    return _ends(files, start, _by_indent)


def brace_blocks(files: DataFrame, start: str) -> DataFrame:
    """The blocks that a matching line opens by braces: they end on the line where, after a first brace, as many have
    closed as opened since the block's own line; else with the file. One pass over a file."""
    return _ends(files, start, _by_brace)


def sequence_ratio(a, b, least: float = 0.0):
    """Ratcliff-Obershelp similarity of two string columns, in Arrow batches; callers pass blocked pairs only.

    Zero where the letters in common, an upper bound, show that it is under `least`.
    """

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        pairs = (SequenceMatcher(None, p or "", q or "") for p, q in zip(x, y))
        return pd.Series([m.ratio() if not least or m.quick_ratio() >= least else 0.0 for m in pairs])

    return ratio(a, b)


def similar_functions(functions: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs of a file's functions (file, name, body) with token sets of Jaccard `least` or more: percent, cut down.

    Functions of equal token sets are one class. Classes are compared, not functions: two that reach `least` share a token among
    the first n - ceil(least * n) + 1 of each, so they meet by these, and the pairs found are then told out to their members.
    A file's own pairs can be as many as the square of a class; nothing larger is made.
    """
    tokens = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split(F.lower("body"), r"[^a-z0-9_]+")))))
    members = functions.groupBy("file", "name").agg(F.array_remove(tokens, "").alias("tokens")).where("size(tokens) > 0")
    n = F.size("tokens")
    classes = members.select("file", "tokens").distinct()
    keyed = classes.select("file", "tokens", F.explode(F.slice("tokens", F.lit(1), (n - F.ceil(least * n - 1e-9) + 1).cast("int"))).alias("t"))
    a, b = keyed.select("file", "t", F.col("tokens").alias("a")), keyed.select("file", "t", F.col("tokens").alias("b"))
    near = F.least(F.size("a"), F.size("b")) >= least * F.greatest(F.size("a"), F.size("b")) - 1e-9
    both = F.size(F.array_intersect("a", "b"))
    pairs = a.join(b, ["file", "t"]).where((F.col("a") < F.col("b")) & near).select("file", "a", "b").distinct().withColumn("sim", both / (F.size("a") + F.size("b") - both))
    pairs = pairs.where(F.col("sim") >= least).unionByName(classes.select("file", F.col("tokens").alias("a"), F.col("tokens").alias("b"), F.lit(1.0).alias("sim")))
    of = lambda k, name: members.select("file", F.col("tokens").alias(k), F.col("name").alias(name))
    told = pairs.join(of("a", "x"), ["file", "a"]).join(of("b", "y"), ["file", "b"]).where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return told.select("file", F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b"), F.floor(F.col("sim") * 100).alias("percent"))


def next_block_lacks(lines: DataFrame, head: str, inside: str, reach: int) -> DataFrame:
    """Lines that match `head` with nothing like `inside` in the next `reach` lines."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(1, reach)
    rows = lines.withColumn("ok", F.coalesce(F.max(F.col("text").rlike(inside)).over(w), F.lit(False)))
    return rows.where(F.col("text").rlike(head) & ~F.col("ok")).select("path", "line")
