"""File sources: a directory tree as rows, languages, binaries, ignore files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import ignore_regex

#: Extensions and their languages.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "swift": "swift", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp",
    "cs": "csharp", "rb": "ruby", "php": "php", "dart": "dart", "scala": "scala", "sh": "shell", "bash": "shell", "sql": "sql",
    "html": "html", "css": "css", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "md": "markdown",
}


def language_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension), F.lit("unknown"))


def is_binary(content: Column) -> Column:
    """Whether a zero byte stands among the first 1,024."""
    return F.locate("\x00", F.substring(content, 1, 1024).cast("string")) > 0


def read_tree(spark: SparkSession, root: str, *, max_mb: float = 100, max_depth: int | None = None, ignore: list[str] = (), glob: str | None = None) -> DataFrame:
    """path, content (text), language, size_bytes, binary: all files under a folder that no pattern ignores.

    Length and path filters reach the file listing, so what they drop is never read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/") + "/"
    rel = F.regexp_replace("path", r"^(?:[a-z]+:)?/*" + re.escape(base.lstrip("/")), "")
    files = reader.load(root).where(F.col("length") <= int(max_mb * 1024 * 1024)).withColumn("path", rel)
    if max_depth is not None:
        files = files.where(F.size(F.split("path", "/")) <= max_depth)
    if ignore:
        files = files.where(~ignored(F.col("path"), list(ignore)))
    binary = is_binary(F.col("content"))
    return files.select("path", F.when(~binary, F.col("content").cast("string")).alias("content"), language_of(F.col("path")).alias("language"), F.col("length").alias("size_bytes"), binary.alias("binary"))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Any pattern matches and no negated one (`!`) does, whatever their order."""
    any_of = lambda ps: reduce(Column.__or__, [path.rlike(ignore_regex(p)) for p in ps], F.lit(False))
    plain = [p for p in patterns if p and not p.startswith(("!", "#"))]
    return any_of(plain) & ~any_of([p[1:] for p in patterns if p.startswith("!")])


def primary_framework(files: DataFrame, evidence: dict[str, str]) -> DataFrame:
    """Files that mention each framework's pattern, with its share of all files: framework, n, confidence."""
    flags = F.array(*[F.when(F.col("content").rlike(p), F.lit(n)) for n, p in evidence.items()])
    hits = files.select(F.explode(F.array_compact(flags)).alias("framework")).groupBy("framework").agg(F.count(F.lit(1)).alias("n"))
    total = files.agg(F.count(F.lit(1)).alias("total"))
    return hits.join(F.broadcast(total)).select("framework", "n", F.round(F.col("n") / F.col("total"), 4).alias("confidence"))
