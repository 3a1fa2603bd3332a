"""What a file is for, and which checks a set of files needs, by weighted evidence.

Every detector gives a row (context, confidence) or none; the surest wins, of equals the earlier detector's. Signals of files are
flags that a group of files adds up. All detectors are columns over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What paths and contents say of a file's context, in the order in which equals win.
PATHS = {
    "test": (r"test[s]?/", r".*test_.*\.py$", r".*_test\.py$", r"spec[s]?/", r".*\.spec\.", r"__tests__/", r".*\.test\.", r"tests/unit/", r"tests/integration/", r"tests/e2e/"),
    "example": (r"example[s]?/", r"demo[s]?/", r"sample[s]?/", r"tutorial[s]?/", r".*_example\.", r".*_demo\."),
    "framework": (r".*_frame\.py$", r"frames?/"),
    "documentation": (r"\.md$", r"\.rst$", r"docs?/", r"README", r"CHANGELOG", r"CONTRIBUTING"),
    "configuration": (r"\.ya?ml$", r"\.json$", r"\.toml$", r"\.ini$", r"\.cfg$", r"\.conf$", r"config/"),
    "migration": (r"migrations?/", r"migrate/", r"alembic/", r".*_migration\.py$", r"db/migrations?/"),
    "fixture": (r"fixtures?/", r"mocks?/", r"stubs?/", r"fakes?/", r".*_fixture\.", r".*_mock\."),
    "vendor": (r"vendor/", r"node_modules/", r"bower_components/", r"third_party/", r"external/", r"\.vendor/"),
    "generated": (r"generated/", r"gen/", r"build/", r"dist/", r"_build/", r"__pycache__/", r".*\.pyc$", r".*_pb2\.py$", r".*_pb2_grpc\.py$"),
    "script": (r"scripts?/", r"bin/", r"tools?/", r"utils?/", r".*\.sh$", r".*\.bash$"),
}
CONTENTS = {
    "test": (r"import\s+pytest", r"from\s+pytest", r"import\s+unittest", r"from\s+unittest", r"class\s+Test\w+", r"def\s+test_\w+", r"@pytest\.", r"@mock\.", r"assert\s+.*==", r"self\.assert", r"describe\(", r"it\(", r"expect\("),
    "example": (r"#\s*Example:", r"#\s*Demo:", r"#\s*Sample:", r"#\s*Usage:", r"#\s*Bad:", r"#\s*Good:", r"#\s*DO NOT USE IN PRODUCTION", r"#\s*For demonstration"),
    "framework": (r"class\s+\w+Frame\(", r"ValidationFrame", r"def\s+detect_pattern", r"def\s+check_security", r"#\s*Pattern definition", r"#\s*Frame implementation"),
    "migration": (r"def\s+upgrade\(", r"def\s+downgrade\(", r"class\s+Migration", r"schema\.create_table", r"schema\.drop_table", r"ALTER\s+TABLE"),
}
TEST_IMPORTS = ("pytest", "unittest", "nose", "mock", "fixtures", "testtools", "hypothesis")
SURE = ("test", "vendor", "generated")
#: A comment that states a file's context.
MARKER = r"#\s*quarry-context:\s*(\w+)"
CONTEXTS = ("production", *PATHS)


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def _evidence(context: Column, confidence: Column) -> Column:
    return F.when(context.isNotNull(), F.struct(context.alias("context"), confidence.cast("double").alias("confidence")))


@dataclass(frozen=True)
class Project:
    """What is known of a project: folders of tests and of vendors, and whether it has a test framework or another one."""

    test_dirs: tuple[str, ...] = ()
    vendor_dirs: tuple[str, ...] = ()
    test_framework: bool = False
    framework: bool = False


def evidence(files: DataFrame, project: Project | None = None) -> DataFrame:
    """`files` (path, content) with `evidence`: an array of (place, method, context, confidence), from up to five detectors.

    By path the first context of PATHS counts; by content the one with most patterns (0.5 and 0.1 for each, 0.95 at most); Python
    imports of test tools; a stated context, marks of generated and foreign code; folders that the project names.
    """
    path, text = F.col("path"), F.coalesce("content", F.lit(""))
    by_path = F.coalesce(*[F.when(_any(path, tuple(f"(?i){p}" for p in ps)), F.lit(c)) for c, ps in PATHS.items()])
    counts = {c: reduce(Column.__add__, [text.rlike(f"(?m){p}").cast("int") for p in ps]) for c, ps in CONTENTS.items()}
    scored = F.array_max(F.array(*[F.struct(F.least(F.round(F.lit(0.5) + n * 0.1, 2), F.lit(0.95)).alias("confidence"), F.lit(-i).alias("place"), F.lit(c).alias("context"), n.alias("n")) for i, (c, n) in enumerate(counts.items())]))
    tools = F.endswith(path, F.lit(".py")) & reduce(Column.__or__, [F.contains(text, F.lit(f"{word} {tool}")) for tool in TEST_IMPORTS for word in ("import", "from")])
    stated = F.lower(F.regexp_extract(text, MARKER, 1))
    marked = F.when(stated.isin(*CONTEXTS), stated).when(F.contains(text, F.lit("# Generated by")) | F.contains(text, F.lit("# Auto-generated")), "generated").when(F.contains(text, F.lit("# Third-party")) | F.contains(text, F.lit("# External library")), "vendor")
    found = {
        "path": _evidence(by_path, F.when(by_path.isin(*SURE), 0.98).otherwise(0.95)),
        "content": F.when(scored["n"] > 0, F.struct(scored["context"].alias("context"), scored["confidence"].alias("confidence"))),
        "imports": _evidence(F.when(tools, F.lit("test")), F.lit(0.85)),
        "metadata": _evidence(marked, F.when(stated.isin(*CONTEXTS), 1.0).otherwise(0.9)),
    }
    if project:
        named = lambda dirs, c: [F.when(F.contains(path, F.lit(d)), F.lit(c)) for d in dirs]
        hint = F.coalesce(*named(project.test_dirs, "test"), *named(project.vendor_dirs, "vendor"), F.lit(None).cast("string"))
        found["project_context"] = _evidence(hint, F.when(hint == "test", 0.8).otherwise(0.9))
    rows = [F.when(e.isNotNull(), F.struct(F.lit(i).alias("place"), F.lit(m).alias("method"), e["context"].alias("context"), e["confidence"].alias("confidence"))) for i, (m, e) in enumerate(found.items())]
    return files.withColumn("evidence", F.array_compact(F.array(*rows)))


def contexts(files: DataFrame, project: Project | None = None) -> DataFrame:
    """path, context, confidence, method of each file: the surest evidence, production at 0.5 without any.

    In a project with a test framework unsure tests gain 0.3, in one with another framework unsure framework files 0.2, up to 0.95.
    """
    order = F.transform("evidence", lambda e: F.struct(e["confidence"].alias("confidence"), (-e["place"]).alias("place"), e["context"].alias("context"), e["method"].alias("method")))
    told = evidence(files, project).select("path", F.array_max(order).alias("b"))
    context, sure, method = F.coalesce("b.context", F.lit("production")), F.coalesce("b.confidence", F.lit(0.5)), F.coalesce("b.method", F.lit("default"))
    gain = F.lit(0.0)
    if project:
        gain = F.when(F.col("b").isNotNull() & (sure < 0.8), F.when((context == "test") & F.lit(project.test_framework), 0.3).when((context == "framework") & F.lit(project.framework), 0.2)).otherwise(None)
        gain = F.coalesce(gain, F.lit(0.0))
    return told.select("path", context.alias("context"), F.round(F.when(gain > 0, F.least(sure + gain, F.lit(0.95))).otherwise(sure), 2).alias("confidence"), F.when(gain > 0, F.concat(method, F.lit("+intent_boost"))).otherwise(method).alias("method"))


# Signals of a set of files, each with the check that it asks for and what it adds to the confidence.
SIGNALS = {
    "orphan": (("def ", "class "), 0.05),
    "resilience": (("import requests", "import httpx", "import aiohttp", "import grpc", "import redis", "import celery", "import pika", "import kafka", "import boto", "import pymongo", "import pymysql", "import psycopg", "import sqlalchemy", "flask", "django", "fastapi", "starlette"), 0.05),
    "fuzz": (("argparse", "click", "typer", "json.loads", "yaml.safe_load", "yaml.load", "xml.etree", "lxml", "struct.unpack", "pickle.loads"), 0.03),
    "property": (("@dataclass", "@property", "from typing import", "from dataclasses import", "from pydantic import", "TypeVar", "Protocol"), 0.03),
    "antipattern": (("global ", "exec(", "eval(", "__class__", "metaclass="), 0.02),
}
FORCED = ("password", "private_key", "hmac", "sha256", "sha512", "AES", "RSA", "jwt", "oauth", "os.system", "shell=True")
START, ENOUGH, MOST = 0.70, 0.82, 0.95


def frames_for(files: DataFrame, by: str, available: tuple[str, ...] = ("security", *SIGNALS, "architecture")) -> DataFrame:
    """`by`, frames, confidence, skip: the checks that each group of files (content) needs, and whether that is sure enough.

    Signals are searched in lower-cased texts, as they are written here. Security is always there, architecture from six files on.
    Signs of secrets or of shell calls, and a single file under 500 characters, keep the confidence below ENOUGH.
    """
    low = F.lower(F.coalesce("content", F.lit("")))
    has = lambda words: reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words])
    flags = files.select(by, F.length(low).alias("size"), *[has(w).alias(f"has_{s}") for s, (w, _) in SIGNALS.items()], has(FORCED).alias("forced"))
    g = flags.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.bool_or("forced").alias("forced"), *[F.bool_or(f"has_{s}").alias(f"has_{s}") for s in SIGNALS])
    many = F.col("n") > 5
    asked = {"security": F.lit(True)} | {s: F.col(f"has_{s}") for s in SIGNALS} | {"architecture": many}
    frames = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in asked.items() if f in available])))
    sure = reduce(Column.__add__, [F.when(F.col(f"has_{s}"), gain).otherwise(0.0) for s, (_, gain) in SIGNALS.items()], F.lit(START))
    if "architecture" in available:
        sure = sure + F.when(many, 0.02).otherwise(0.0)
    tiny = (F.col("n") == 1) & (F.col("size") < 500)
    capped = F.least(F.round(F.when(F.col("forced") | tiny, F.least(sure, F.lit(ENOUGH - 0.01))).otherwise(sure), 4), F.lit(MOST))
    return g.select(by, frames.alias("frames"), capped.alias("confidence"), (capped >= ENOUGH).alias("skip"))
