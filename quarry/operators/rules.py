"""The rule engine: files to lines to matches. Each rule's pattern is a literal of the plan, compiled once a task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import glob_regex


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str
    severity: str = "medium"
    languages: tuple[str, ...] = ()
    exceptions: tuple[str, ...] = ()
    message: str = ""


@dataclass(frozen=True)
class MetricRule:
    """Strictly more than `limit` of `metric` (size_bytes or line_count) is a match on line 0."""

    id: str
    metric: str
    limit: int
    severity: str = "medium"


#: Inline markers that switch a rule off on their line.
MARKERS = ("noqa", "quarry-ignore", "nosec", "rule-ignore")


def lines(files: DataFrame, keep: Sequence[str] = ("path", "language")) -> DataFrame:
    """A row for each line, numbered from 1; a text without newline has one line."""
    return files.select(*keep, F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("at", "text")).select(*keep, (F.col("at") + 1).alias("line"), "text")


def suppressed(text: Column) -> Column:
    return reduce(Column.__or__, [text.contains(m) for m in MARKERS])


def portable(rule: Rule) -> bool:
    """Whether a linear-time engine can run the pattern: no look-around, no back-references."""
    p = rule.pattern
    return not any(x in p for x in ("(?=", "(?!", "(?<=", "(?<!")) and not any(f"\\{i}" in p for i in range(1, 10))


def match_patterns(files: DataFrame, rules: Sequence[Rule], *, honour_markers: bool = False) -> DataFrame:
    """path, line, column (1-based, in bytes), rule_id, severity, snippet: the first match of each rule on each line.

    One array of structs with a literal pattern for each rule keeps the match inside one generated stage;
    no rule table is joined.
    """
    rows = lines(files)
    if honour_markers:
        rows = rows.where(~suppressed(F.col("text")))
    any_rule = reduce(Column.__or__, [F.col("text").rlike(r.pattern) for r in rules])
    hits = []
    for r in rules:
        ok = F.col("text").rlike(r.pattern)
        if r.languages:
            ok = ok & F.col("language").isin(*r.languages)
        for g in r.exceptions:
            ok = ok & ~F.col("path").rlike(glob_regex(g))
        before = F.regexp_extract("text", f"^(.*?)(?:{r.pattern})", 1)
        hits.append(F.when(ok, F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), (F.octet_length(before) + 1).alias("column"))))
    found = rows.where(any_rule).select("path", "line", "text", F.explode(F.array_compact(F.array(*hits))).alias("m"))
    return found.select("path", "line", "m.column", "m.rule_id", "m.severity", F.trim("text").alias("snippet"))


def file_metrics(files: DataFrame) -> DataFrame:
    """size_bytes, line_count and hash, the SHA-256 of the lines each with a line feed.

    A line feed ends a line and begins none, and a carriage return before it belongs to it; an empty file has no line. A
    binary file has no lines and the hash of its content.
    """
    content = F.coalesce(F.col("content"), F.lit(""))
    plain = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    ended = F.when((plain == "") | F.endswith(plain, F.lit("\n")), plain).otherwise(F.concat(plain, F.lit("\n")))
    binary = F.contains(content, F.lit("\0"))
    count = F.when(binary, 0).otherwise(F.length(ended) - F.length(F.replace(ended, F.lit("\n"), F.lit(""))))
    return files.withColumn("size_bytes", F.octet_length(content)).withColumn("line_count", count).withColumn("hash", F.sha2(F.encode(F.when(binary, content).otherwise(ended), "UTF-8"), 256))


def validate_metrics(files: DataFrame, rules: Sequence[MetricRule]) -> DataFrame:
    rows = file_metrics(files)
    hits = F.array(*[F.when(F.col(r.metric) > r.limit, F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.col(r.metric).cast("long").alias("value"))) for r in rules])
    return rows.select("path", F.explode(F.array_compact(hits)).alias("m")).select("path", F.lit(0).alias("line"), "m.rule_id", "m.severity", "m.value")


def first_per_line(files: DataFrame, patterns: Sequence[tuple[str, int]], name: str) -> DataFrame:
    """path, line, `name`: what the first pattern (in order) that matches captures on each line."""
    taken = F.coalesce(*[F.when(F.col("text").rlike(p), F.regexp_extract("text", p, g)) for p, g in patterns])
    return lines(files).select("path", "line", taken.alias(name)).where(F.col(name).isNotNull())


def line_window(rows: DataFrame, before: int, after: int, out: str = "window") -> DataFrame:
    """Adds the text of the lines around each line, of the same file."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("line").rowsBetween(-before, after)
    return rows.withColumn(out, F.array_join(F.collect_list("text").over(w), "\n"))


@dataclass(frozen=True)
class Conjunction:
    """A sink on the line, with a source on it too, and no guard within `reach` lines."""

    id: str
    sink: str
    source: str
    guard: str
    reach: int
    severity: str = "high"
    comments: tuple[str, ...] = field(default=("#", "//", "*"))


def conjunctions(files: DataFrame, rules: Sequence[Conjunction]) -> DataFrame:
    """Only files with a sink are windowed, and each guard is an aggregate of flags, not of text."""
    from pyspark.sql import Window

    rows = lines(files)
    out = None
    for r in rules:
        marked = rows.select("path", "line", "text", F.col("text").rlike(r.guard).alias("guard"), (F.col("text").rlike(r.sink) & F.col("text").rlike(r.source)).alias("hit"))
        w = Window.partitionBy("path").orderBy("line").rowsBetween(-r.reach, r.reach)
        comment = reduce(Column.__or__, [F.startswith(F.ltrim("text"), F.lit(c)) for c in r.comments])
        hit = marked.withColumn("near", F.max("guard").over(w)).where(F.col("hit") & ~F.col("near") & ~comment)
        part = hit.select("path", "line", F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"))
        out = part if out is None else out.unionByName(part)
    return out


# What a file needs no closer look for.
SAFE_EXTENSIONS = (
    ".md", ".txt", ".rst", ".json", ".yaml", ".yml", ".css", ".scss", ".html", ".xml", ".csv", ".lock", ".svg", ".png", ".jpg", ".jpeg", ".gif",
    ".ico", ".woff", ".woff2", ".eot", ".ttf", ".map", ".pyi", ".typed", ".toml", ".ini", ".cfg",
)
SAFE_NAMES = (
    "__init__.py", "__main__.py", "conftest.py", "_version.py", "setup.py", "setup.cfg", "pyproject.toml", "poetry.lock", "Makefile", "Dockerfile", ".dockerignore", ".gitignore",
    ".editorconfig", ".flake8", ".pylintrc", "tox.ini", "requirements.txt", "requirements-dev.txt", "MANIFEST.in", "LICENSE", "CHANGELOG.md", "CONTRIBUTING.md", "OWNERS", "CODEOWNERS",
)
GENERATED_ENDINGS = (
    ".min.js", ".min.css", ".g.dart", ".freezed.dart", "_pb2.py", "_pb2_grpc.py", "_pb.js", "_pb.ts", ".pb.go", ".pb.swift", ".pb.cc", ".pb.h", "_grpc_pb.js", "_grpc_pb.d.ts", ".graphql.ts",
)
SAFE_FOLDERS = (
    "/tests/", "/test/", "/docs/", "/migrations/", "/node_modules/", "/dist/", "/build/", "/__pycache__/", "/site-packages/", "/.git/", "/.tox/", "/.mypy_cache/", "/.pytest_cache/", "/.venv/", "/venv/",
    "/.eggs/", "/__generated__/", "/generated/", "/gen/", "/grpc_generated/",
)
LOGIC = (" if ", " if(", "\nif ", " for ", " for(", "\nfor ", " while ", " while(", "\nwhile ", " try:", "\ntry:", " except ", " except:", "\nexcept", " with ", "\nwith ", " await ", "\nawait ")
BOILERPLATE = ("abstractmethod", "dataclass", "pydantic", "basemodel", "typeddict", "namedtuple")
HEADS = ("#", "import", "from", "class ", "def ", "@")
LEAST_CHARACTERS, LEAST_LINES, DECLARATIONS = 300, 30, 2000


def heuristic_safe(path: Column, content: Column) -> Column:
    """Whether a file needs no closer look: by its ending, name, folder, size, or as declarations without logic.

    Names are compared in lower case, as they stand in the list; null content is empty.
    """
    low, text = F.lower(path), F.coalesce(content, F.lit(""))
    name = F.element_at(F.split(low, "/"), -1)
    ending = F.regexp_extract(name, r"[^./][^/]*?(\.[^./]*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_replace(F.replace(low, F.lit("\\"), F.lit("/")), "^/+", ""))
    any_of = lambda c, words: reduce(Column.__or__, [c.contains(w) for w in words])
    starts = lambda line: reduce(Column.__or__, [F.startswith(F.trim(line), F.lit(h)) for h in HEADS])
    rows = F.split(F.regexp_replace(text, "\\r\\n?", "\n"), "\n")
    declared = any_of(F.lower(text), BOILERPLATE) | F.forall(rows, lambda r: (F.trim(r) == "") | starts(r))
    return (
        ending.isin(*SAFE_EXTENSIONS)
        | name.isin(*SAFE_NAMES)
        | reduce(Column.__or__, [F.endswith(name, F.lit(e)) for e in GENERATED_ENDINGS])
        | any_of(folder, SAFE_FOLDERS)
        | any_of(name, ("config", "settings"))
        | (F.length(text) < LEAST_CHARACTERS)
        | (F.size(F.split(text, "\n")) < LEAST_LINES)
        | ((F.length(text) < DECLARATIONS) & ~any_of(text, LOGIC) & declared)
    )
