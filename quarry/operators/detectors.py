"""Detectors on syntax rows and lines: findings (path, line, rule_id, severity, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.rules import Conjunction, Rule, lines

# The patterns of the line detectors.
SQL_INJECTION = (
    Rule("sql-concat", r"(?i)[\"'](?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER).*?[\"'][\s]*\+", "critical"),
    Rule("sql-fstring", r"(?i)f[\"'](?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER).*?\{.*?\}", "critical"),
    Rule("sql-format", r"(?i)[\"'](?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER).*?[\"']\.format\(", "critical"),
    Rule("sql-percent", r"(?i)[\"'](?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER).*?[\"'][\s]*%", "critical"),
    Rule("sql-template", r"(?i)`(?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)[^`]*\$\{", "critical"),
    Rule("sql-sprintf", r"(?i)fmt\.Sprintf\s*\(\s*[\"`](?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)", "critical"),
    Rule("sql-string-format", r"(?i)String\.format\s*\(\s*[\"'](?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)", "critical"),
)
XSS = (
    Rule("xss-inner-html", r"\.innerHTML\s*=", "high"),
    Rule("xss-outer-html", r"\.outerHTML\s*=", "high"),
    Rule("xss-document-write", r"document\.write\(", "high"),
    Rule("xss-eval", r"eval\(", "high"),
    Rule("xss-react", r"dangerouslySetInnerHTML", "high"),
    Rule("xss-safe-filter", r"\|safe\b", "high"),
    Rule("xss-mark-safe", r"mark_safe\(", "high"),
    Rule("xss-template", r"<[^>]*>\$\{", "high"),
)
TODO = r"(?i)(#|//|/\*|\*|--|<!--|;)\s*(TODO|FIXME|XXX|HACK|BUG)\s*:?\s*(.*)"
USER_SOURCE = r"request\.(args|form|json|values|get_json|data|params|query)\b|req\.(query|body|params)\b|params\[|request\.GET\b|request\.POST\b|getParameter\(|@RequestParam|@PathVariable|c\.Query\(|c\.Param\(|r\.URL\.Query\(\)"
OPEN_REDIRECT = Conjunction(
    "open-redirect",
    r"\bredirect\s*\(|\bHttpResponseRedirect\s*\(|\bres\.redirect\s*\(|\bhttp\.Redirect\s*\(|\bsendRedirect\s*\(|\bnew\s+RedirectView\s*\(",
    USER_SOURCE + r"|\b(next(?:_url|_page)?|redirect(?:_url|_uri|_to)|return(?:_url|_to)|callback(?:_url|_uri)?|target(?:_url)?|goto)\b",
    r"url_has_allowed_host_and_scheme|is_safe_url|validate_redirect|allowedHosts\.includes|URL\.canParse|urllib\.parse\.urlparse|validators\.url|is_trusted|whitelist|allowlist",
    4,
)
PATH_TRAVERSAL = Conjunction(
    "path-traversal",
    r"\bopen\s*\(|\bos\.path\.join\s*\(|\bfs\.(readFile|writeFile|readFileSync|writeFileSync|stat|exists|unlink)\s*\(|\bpath\.(join|resolve)\s*\(|\bos\.(Open|Create|ReadFile|WriteFile|Stat|Remove)\s*\(|\bnew\s+File\s*\(|\bPaths\.get\s*\(",
    USER_SOURCE + r"|\b(filename|file_name|filepath|file_path|dir_path|upload_path|download_path|resource_path)\b",
    r"os\.path\.basename\s*\(|path\.basename\s*\(|sanitize_path|safe_path|validate_path|filepath\.Clean\s*\(|filepath\.Abs\s*\(|realpath\s*\(",
    2,
)
WEAK_HASH = r"hashlib\.(?:md5|sha1)\s*\(|crypto\.createHash\s*\(\s*['\"](?:md5|sha1)['\"]\s*\)|\bmd5\.New\s*\(\s*\)|\bsha1\.New\s*\(\s*\)"


def todo_comments(files: DataFrame) -> DataFrame:
    hit = F.col("text").rlike(TODO)
    detail = F.concat(F.upper(F.regexp_extract("text", TODO, 2)), F.lit(": "), F.substring(F.trim(F.regexp_extract("text", TODO, 3)), 1, 50))
    return lines(files).where(hit).select("path", "line", F.lit("todo-fixme").alias("rule_id"), F.lit("low").alias("severity"), detail.alias("detail"))


def weak_hashes(files: DataFrame, reach: int = 5) -> DataFrame:
    """A weak hash is a finding only where passwords are near and no checksum context is on its line."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(-reach, reach)
    rows = lines(files).withColumn("secret", F.max(F.col("text").rlike(r"(?i)password|passwd|pwd|credential|login|auth")).over(w))
    safe = F.col("text").rlike(r"(?i)checksum|cache|etag|fingerprint|integrity|file_hash|content_hash")
    return rows.where(F.col("text").rlike(WEAK_HASH) & F.col("secret") & ~safe).select("path", "line", F.lit("weak-hash").alias("rule_id"), F.lit("high").alias("severity"), F.trim("text").alias("detail"))


def absent_guard(files: DataFrame, trigger: str, guard: str, rule_id: str, severity: str = "medium") -> DataFrame:
    """Files that match a trigger and nowhere a guard, at the first trigger's line."""
    rows = lines(files).select("path", "line", F.col("text").rlike(trigger).alias("hit"), F.col("text").rlike(guard).alias("safe"))
    per = rows.groupBy("path").agg(F.min(F.when(F.col("hit"), F.col("line"))).alias("line"), F.bool_or("safe").alias("safe"))
    return per.where("line is not null and not safe").select("path", "line", F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"))


def _found(df: DataFrame, rule: str, severity: str, detail: Column) -> DataFrame:
    return df.select("path", "line", F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), detail.alias("detail"))


def structure_findings(tree: DataFrame, *, most_lines: int = 50, most_params: int = 5, most_nesting: int = 4, most_complexity: int = 10, class_lines: int = 500) -> DataFrame:
    """Long, wide, deep and complex functions, large classes, empty and bare handlers, dead code, missing docs."""
    f, c, h = (F.col("kind") == k for k in ("function", "class", "handler"))
    span = F.col("end_line") - F.col("line") + 1
    rules = [
        (f & (span > most_lines), "long-function", "medium"),
        (f & (F.col("n_params") > most_params), "many-parameters", "medium"),
        (f & (F.col("nesting") > most_nesting), "deep-nesting", "medium"),
        (f & (F.col("complexity") > most_complexity), "complex-function", "high"),
        (c & (span > class_lines), "god-class", "high"),
        (h & (F.col("name") == "bare"), "bare-except", "high"),
        (h & (F.col("value") == "empty"), "empty-except", "medium"),
        (F.col("kind") == "dead", "dead-code", "low"),
        (c & ~F.col("name").rlike("^_?[A-Z][A-Za-z0-9]*$"), "class-name", "low"),
        (f & (F.length("name") == 1), "function-name", "low"),
    ]
    # one pass: a row meets all rules, so the files are parsed once
    met = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"))) for hit, rule, severity in rules]))
    return tree.select("path", "line", F.explode(met).alias("m"), F.col("name").alias("detail")).select("path", "line", "m.rule_id", "m.severity", "detail")


def unused_imports(tree: DataFrame) -> DataFrame:
    """Imported names that their file neither uses nor lists in __all__; not of __future__, not *, not for type checkers only."""
    taken = F.col("kind").isin("name", "call", "export")
    asked = (F.col("kind") == "import") & ~F.startswith("value", F.lit("__future__")) & (F.col("name") != "*") & ~F.coalesce("has_doc", F.lit(False))
    # a file meets its own names in one group, which is no more than the tree that it was parsed into
    per = tree.where(taken | asked).groupBy("path").agg(
        F.collect_set(F.when(taken, F.split_part("name", F.lit("."), F.lit(1)))).alias("used"), F.collect_list(F.when(asked, F.struct("name", "line", "value"))).alias("imports")
    )
    lost = F.filter("imports", lambda i: F.col("path").isNull() | ~F.array_contains("used", i["name"]))
    return _found(per.select("path", F.explode(lost).alias("i")).select("path", "i.line", "i.value"), "unused-import", "low", F.col("value"))


def unreferenced(tree: DataFrame) -> DataFrame:
    """Functions and classes that no file refers to; dunder, private and test names are exempt."""
    used = tree.where("kind in ('name', 'call')").select(F.element_at(F.split("name", r"\."), -1).alias("name")).distinct()
    defs = tree.where("kind in ('function', 'class') and not name rlike '^(_|test)'")
    return _found(defs.join(used.hint("merge"), "name", "left_anti"), "unreferenced", "low", F.col("name"))


# Names that frameworks call, and decorators that make a function an entry point.
DISPATCHED = (
    "generic_visit", "setUp", "tearDown", "setUpClass", "tearDownClass", "setUpModule", "tearDownModule", "get_queryset", "get_context_data", "get_object", "form_valid", "form_invalid", "get_form_class",
    "get_success_url", "dispatch", "model_post_init", "main",
)
ENTRY_DECORATORS = (
    "route", "get", "post", "put", "delete", "patch", "before_request", "after_request", "teardown_request", "errorhandler", "before_app_request", "after_app_request", "app_errorhandler", "teardown_appcontext",
    "api_route", "websocket", "on_event", "middleware", "login_required", "permission_required", "csrf_exempt", "require_http_methods", "staff_member_required", "task", "shared_task", "periodic_task",
    "command", "group", "callback", "fixture", "mark", "parametrize", "abstractmethod", "staticmethod", "classmethod", "property", "cached_property", "overload", "override",
)


def unreferenced_definitions(tree: DataFrame) -> DataFrame:
    """path, kind (unreferenced_function or unreferenced_class), name, line: definitions that their own file never names.

    A name inside the definition itself does not count, any attribute of that name does. Of definitions with one name the last
    counts. Dunder names, names that frameworks call and functions with an entry decorator are exempt.
    """
    inside = F.element_at(F.split("parent", r"\."), -1)
    used = tree.where((F.col("kind") == "attribute") | ((F.col("kind") == "name") & (F.coalesce(inside, F.lit("")) != F.col("name")))).select("path", "name").distinct()
    defs = tree.where("kind in ('function', 'class')").groupBy("path", "name").agg(F.max_by(F.struct("kind", "line", "bases"), F.struct("line", "end_line")).alias("d"))
    entry = F.exists(F.coalesce(F.when(F.col("d.kind") == "function", F.col("d.bases")), F.array().cast("array<string>")), lambda m: F.lower(F.element_at(F.split(m, r"\."), -1)).isin(*ENTRY_DECORATORS))
    exempt = F.col("name").isin(*DISPATCHED) | F.startswith("name", F.lit("visit_")) | F.col("name").rlike("^__.*__$") | entry
    left = defs.where(~exempt).join(used.hint("merge"), ["path", "name"], "left_anti")
    return left.select("path", F.concat(F.lit("unreferenced_"), "d.kind").alias("kind"), "name", F.col("d.line").alias("line"))


def documentation_coverage(tree: DataFrame) -> DataFrame:
    """path, share of documented functions and classes (100 where there are none)."""
    d = tree.where("kind in ('function', 'class', 'module')")
    own = F.col("kind") != "module"
    return d.groupBy("path").agg(F.coalesce(F.try_divide(F.count_if(own & F.col("has_doc")) * 100.0, F.count_if(own)), F.lit(100.0)).alias("coverage"))


def code_graph(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (fqn, name, kind, file_path, is_test) and edges (source, target, relation) of parsed files."""
    own = F.concat("path", F.lit("::"), F.when(F.col("parent") == "", F.col("name")).otherwise(F.concat_ws(".", "parent", "name")))
    abstract = F.exists("bases", lambda b: b.rlike("(^|\\.)(ABC|Protocol)$"))
    kind = F.when(F.col("kind") == "function", "function").when(F.lower("name").contains("mixin"), "mixin").when(F.coalesce(abstract, F.lit(False)), "interface").otherwise("class")
    nodes = tree.where("kind in ('function', 'class')").select(own.alias("fqn"), "name", kind.alias("kind"), F.col("path").alias("file_path"), F.col("path").rlike(r"(^|/)test").alias("is_test"))
    inside = F.concat("path", F.lit("::"), F.col("parent"))
    edge = lambda source, target, relation: F.struct(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"))
    called = F.array(edge(inside, F.element_at(F.split("name", r"\."), -1), "calls"))
    ends = F.when((F.col("kind") == "call") & (F.col("parent") != ""), called).when(F.col("kind") == "class", F.transform("bases", lambda b: edge(own, b, "inherits"))).when(F.col("kind") == "import", F.array(edge(F.col("path"), F.col("value"), "imports")))
    return nodes, tree.select(F.explode(ends).alias("e")).select("e.*").distinct()


def data_flow(tree: DataFrame) -> DataFrame:
    """Reads and writes of fields: path, field, func_name, line, kind; those set in __init__ have kind init."""
    rows = tree.where("kind in ('read', 'write')")
    init = (F.col("kind") == "write") & F.col("parent").endswith("__init__")
    return rows.select("path", F.col("name").alias("field"), F.col("parent").alias("func_name"), "line", F.when(init, "init").otherwise(F.col("kind")).alias("kind"))
