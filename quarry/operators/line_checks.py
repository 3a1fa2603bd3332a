"""Security checks on lines with their surroundings: passwords, web settings, tokens, forgery, logs, timeouts.

A file goes on only if it matches a check's trigger at all; of its lines only those that match become rows, each with
the file's lines, so that surroundings are slices and no window shuffles text.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import likely_password
from quarry.operators.rules import Rule

FOUND = ("path", "line", "rule_id", "severity")

# The names, literals and patterns that the checks look for, and the severities they give.
PASSWORD_KEYWORDS = ("password", "passwd", "pwd", "pass", "secret", "auth", "credential", "token", "key")
WEAK_PASSWORDS = ("password", "admin", "root", "123456", "12345678", "qwerty", "abc123", "letmein", "monkey", "admin123")
ENVIRONMENT = r"os\.getenv\(|os\.environ\[|process\.env\.|System\.getenv\(|Environment\.GetEnvironmentVariable\(|input\(|getpass\("
QUOTED_LIST = r"""^(?:["'][\w\-\.@]+["'],?\s*)+$"""
CORS = (
    Rule("cors-origin-any", r"""(?i)cors\(\s*\{[^}]*origin\s*:\s*['"][*]['"]""", "high"),
    Rule("cors-default", r"(?i)\.use\(\s*cors\(\s*\)\s*\)", "high"),
    Rule("cors-django-all", r"(?i)CORS_ALLOW_ALL_ORIGINS\s*=\s*True", "high"),
    Rule("cors-django-legacy", r"(?i)CORS_ORIGIN_ALLOW_ALL\s*=\s*True", "high"),
    Rule("cors-fastapi-any", r"""(?i)allow_origins\s*=\s*\[\s*['"][*]['"]\s*\]""", "high"),
    Rule("cors-flask-any", r"""(?i)origins['"]\s*:\s*['"][*]['"]""", "high"),
    Rule("cors-header-any", r"""(?i)Access-Control-Allow-Origin['"].*['"]\*['"]""", "high"),
)
COOKIE_SETTINGS = (
    Rule("cookie-session-insecure", r"SESSION_COOKIE_SECURE\s*=\s*False", "medium"),
    Rule("cookie-csrf-insecure", r"CSRF_COOKIE_SECURE\s*=\s*False", "medium"),
    Rule("cookie-session-script", r"SESSION_COOKIE_HTTPONLY\s*=\s*False", "medium"),
    Rule("cookie-csrf-script", r"CSRF_COOKIE_HTTPONLY\s*=\s*False", "medium"),
    Rule("cookie-session-samesite", r"SESSION_COOKIE_SAMESITE\s*=\s*(?:None|False|'None')", "medium"),
)
BINDING = (
    Rule("bind-host", r"""(?i)(?:host\s*=\s*|\.host\s*=\s*)['"]0\.0\.0\.0['"]""", "medium"),
    Rule("bind-listen", r"""(?i)\.listen\s*\([^,)]+,\s*['"]0\.0\.0\.0['"]""", "medium"),
    Rule("bind-go", r"""(?i)(?:ListenAndServe|net\.Listen)\s*\(\s*["'][^"']*0\.0\.0\.0""", "medium"),
)
DEBUG_MODE = (
    Rule("debug-flask", r"app\.run\s*\([^)]*debug\s*=\s*True", "high"),
    Rule("debug-settings", r"^DEBUG\s*=\s*True\b", "high"),
    Rule("debug-reload", r"uvicorn\.run\s*\([^)]*reload\s*=\s*True", "high"),
    Rule("debug-node", r"""NODE_ENV\s*[=!]=\s*['"]development['"]""", "high"),
)
DISCLOSURE = (
    Rule("leak-return", r"(?i)return\s+(?:jsonify|str|repr)\s*\(\s*(?:e|err|error|exc|exception)\s*\)", "medium"),
    Rule("leak-traceback", r"(?i)traceback\.(?:format_exc|print_exc|format_tb)\s*\(\s*\)", "medium"),
    Rule("leak-abort", r"(?i)abort\s*\(\s*\d+\s*,\s*(?:str|repr)\s*\(\s*(?:e|err|error)\s*\)", "medium"),
    Rule("leak-express", r"(?i)res\.\s*(?:send|json)\s*\([^)]*(?:err\.message|err\.stack|error\.message)\s*\)", "medium"),
    Rule("leak-go", r"(?i)http\.Error\s*\([^,]+,\s*err\.Error\s*\(\)", "medium"),
)
HEADER_KEYS = (
    Rule("header-key-python", r"""(?i)request\.headers\s*(?:\.get\s*\(|\.getlist\s*\(|\[)\s*['"][^'"]*(?:private[_-]?key|secret[_-]?key|signing[_-]?key|priv[_-]?key)[^'"]*['"]""", "high"),
    Rule("header-key-express", r"""(?i)req\.(?:headers\s*\[|get\s*\()\s*['"][^'"]*(?:private[_-]?key|secret[_-]?key|signing[_-]?key)[^'"]*['"]""", "high"),
    Rule("header-key-go", r"""(?i)\.Header\.Get\s*\(\s*["'][^"']*(?:private[_-]?key|secret[_-]?key|signing[_-]?key)[^"']*["']\s*\)""", "high"),
)
EXPRESS = r"""require\s*\(\s*['"]express['"]\s*\)|import\s+.*\s+from\s+['"]express['"]"""
NONE_ALGORITHM = r"""(?i)algorithms\s*[:=]\s*\[?\s*['"]none['"]\s*\]?"""
NONE_IN_HEADER = r"""(?i)['"](?:alg|algorithm)['"]\s*:\s*['"]none['"]"""
LOG_CALL = (
    r"(?i)\b(logging\.(debug|info|warning|error|critical|exception)|logger\.(debug|info|warning|error|critical|exception|warn)|print)\s*\(",
    r"(?i)\b(console\.(log|error|warn|debug|info|trace)|logger\.(debug|info|warning|error|warn))\s*\(",
    r"\b(log\.(Print|Printf|Println|Fatal|Fatalf|Fatalln|Panic|Panicf)|fmt\.(Print|Printf|Println|Fprintf|Errorf))\s*\(",
    r"(?i)\b(System\.out\.print(ln|f)?|System\.err\.print(ln|f)?|Log\.(d|i|e|w|v)\s*\(|logger\.(debug|info|warn|error)\s*\()",
)
SENSITIVE = r"(?i)\b(password|passwd|pwd|secret|api_key|apikey|token|auth_token|access_token|refresh_token|private_key|privkey|credential|credit_card|card_number|cvv|ssn|social_security|dob|date_of_birth|bearer|authorization|x-api-key)\b"
SENSITIVE_IN_BRACES = r"(?i)\{[^}]*(password|passwd|pwd|secret|api_key|apikey|token|auth_token|access_token|refresh_token|private_key|credential|credit_card|card_number|cvv|ssn|bearer|authorization)[^}]*\}"
MASKED = r"(?i)\b(mask|redact|sanitize|scrub|anonymize|obfuscat|PIIMask|mask_sensitive|mask_pii|re\.sub|replace\(.*\*+|hash\(|hmac\()"
TIMEOUTS = (
    Rule("timeout-requests", r"(?is)requests\.(?:get|post|put|delete|patch)\((?:(?!timeout).)*?\)", "high"),
    Rule("timeout-httpx", r"(?is)httpx\.(?:get|post|put|delete|patch)\((?:(?!timeout).)*?\)", "high"),
    Rule("timeout-aiohttp", r"(?is)aiohttp\.ClientSession\((?:(?!timeout).)*?\)", "high"),
    Rule("timeout-fetch", r"(?is)fetch\((?:(?!signal).)*?\)", "high"),
    Rule("timeout-axios", r"(?is)axios\.(?:get|post|put|delete|patch)\((?:(?!timeout).)*?\)", "high"),
    Rule("timeout-postgres", r"(?is)psycopg2\.connect\((?:(?!connect_timeout).)*?\)", "high"),
    Rule("timeout-mongo", r"(?is)pymongo\.MongoClient\((?:(?!serverSelectionTimeoutMS).)*?\)", "high"),
    Rule("timeout-go-http", r"(?is)\bhttp\.(?:Get|Post|PostForm)\s*\(", "high"),
    Rule("timeout-go-client", r"(?is)&http\.Client\s*\{(?:[^}](?!Timeout))*\}", "high"),
    Rule("timeout-java-url", r"(?is)new\s+URL\s*\(.*\)\s*\.openConnection\s*\(", "high"),
    Rule("timeout-okhttp", r"(?is)new\s+OkHttpClient\s*\(\s*\)", "high"),
    Rule("timeout-node", r"(?is)\b(?:http|https)\.request\s*\((?:(?!timeout).)*?\)", "high"),
    Rule("timeout-got", r"(?is)\bgot\s*\((?:(?!timeout).)*?\)", "high"),
)


def _any(column: Column, patterns: Sequence[str]) -> Column:
    return reduce(Column.__or__, [column.rlike(p) for p in patterns])


def hit_lines(files: DataFrame, patterns: Sequence[str], comments: Sequence[str] = ("#", "//")) -> DataFrame:
    """path, language, line, text, all: the lines that match a pattern and start no comment, with all lines of the file."""
    every = F.split(F.coalesce("content", F.lit("")), "\n")
    numbered = F.transform(every, lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
    hits = F.filter(numbered, lambda x: _any(x["text"], patterns) & ~_any(F.ltrim(x["text"]), ["^(?:" + "|".join(c.replace("*", r"\*") for c in comments) + ")"]))
    return files.select("path", "language", every.alias("all"), F.explode(hits).alias("hit")).select("path", "language", "hit.line", "hit.text", "all")


def around(before: int, after: int) -> Column:
    """The text of the lines from `before` lines above a hit to `after` below it."""
    start = F.greatest(F.lit(1), F.col("line") - before)
    return F.array_join(F.slice("all", start, F.col("line") + after - start + 1), "\n")


def _rule(rules: Sequence[Rule]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col("text").rlike(r.pattern), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"))) for r in rules]))


def matched(files: DataFrame, rules: Sequence[Rule], comments: Sequence[str] = ("#", "//"), *, first: bool = False) -> DataFrame:
    """A finding for each rule that a line matches, or for the first one only."""
    rows = hit_lines(files, [r.pattern for r in rules], comments).withColumn("m", _rule(rules))
    return rows.select("path", "line", F.explode(F.slice("m", 1, 1) if first else F.col("m")).alias("m")).select("path", "line", "m.rule_id", "m.severity")


def _as(rows: DataFrame, rule: str | Column, severity: str) -> DataFrame:
    return rows.select("path", "line", (F.lit(rule) if isinstance(rule, str) else rule).alias("rule_id"), F.lit(severity).alias("severity"))


def missing_flags(context: Column, flags: Sequence[str]) -> Column:
    """Those of the cookie flags that the call's lines do not name."""
    return F.array_compact(F.array(*[F.when(~F.lower(context).contains(f.lower()), F.lit(f)) for f in flags]))


def http_findings(files: DataFrame) -> DataFrame:
    """Open CORS, cookies without flags, no security headers, public binding, debug mode, leaked errors, keys in headers."""
    close = ("#", "//", "*")
    script = hit_lines(files, [r"\.cookie\s*\("]).withColumn("c", around(0, 4))
    flags = F.when(~F.contains("c", F.lit("{")), F.array(*[F.lit(x) for x in ("secure", "httpOnly", "sameSite")])).otherwise(missing_flags(F.col("c"), ("secure", "httpOnly", "sameSite")))
    python = hit_lines(files, [r"set_cookie\s*\("]).withColumn("c", around(0, 4))
    web = files.where(F.col("language").isin("javascript", "typescript") & ~F.coalesce(F.col("content"), F.lit("")).rlike(r"helmet\s*\("))
    parts = [
        matched(files, CORS),
        matched(files, COOKIE_SETTINGS),
        _as(script.withColumn("f", flags).where(F.size("f") > 0), F.concat(F.lit("cookie-lacks:"), F.array_join("f", ",")), "medium"),
        _as(python.withColumn("f", missing_flags(F.col("c"), ("secure", "httponly", "samesite"))).where(F.size("f") > 0), F.concat(F.lit("set-cookie-lacks:"), F.array_join("f", ",")), "medium"),
        _as(_first_lines(web, EXPRESS), "no-helmet", "medium"),
        matched(files, BINDING, close, first=True),
        matched(files, DEBUG_MODE, close, first=True),
        matched(files, DISCLOSURE, close, first=True),
        matched(files, HEADER_KEYS, close, first=True),
    ]
    return reduce(DataFrame.unionByName, parts)


def _first_lines(files: DataFrame, pattern: str) -> DataFrame:
    """path, line: the first line of each file that matches, a comment or not."""
    every = F.split(F.coalesce("content", F.lit("")), "\n")
    at = F.filter(F.transform(every, lambda t, i: F.when(t.rlike(pattern), i + 1)), lambda i: i.isNotNull())
    return files.select("path", F.try_element_at(at, F.lit(1)).alias("line")).where("line is not null")


def csrf_findings(files: DataFrame) -> DataFrame:
    """Exempt views, settings without the middleware, and applications without protection."""
    has = lambda p: F.coalesce(F.col("content"), F.lit("")).rlike(p)
    python, web = files.where("language = 'python'"), files.where(F.col("language").isin("javascript", "typescript"))
    parts = [
        _as(hit_lines(python, ["@csrf_exempt"], ("#",)), "csrf-exempt", "high"),
        _as(_first_lines(python.where(~has(r"django\.middleware\.csrf\.CsrfViewMiddleware")), r"MIDDLEWARE\s*=\s*\["), "csrf-middleware", "critical"),
        _as(_first_lines(python.where(~has(r"CSRFProtect\s*\(|from\s+flask_wtf\.csrf\s+import\s+CSRFProtect")), r"Flask\s*\(\s*__name__\s*\)"), "csrf-flask", "high"),
        _as(_first_lines(web.where(~has("csurf|csrf|csrfProtection|csrfToken|_csrf") & has(r"\.(post|put|delete|patch)\s*\(")), EXPRESS), "csrf-express", "high"),
    ]
    return reduce(DataFrame.unionByName, parts)


def jwt_findings(files: DataFrame, reach: int = 10) -> DataFrame:
    """Tokens that never expire, decoding without stated algorithms, and the algorithm `none`."""
    near, ahead = around(reach, reach - 1), around(0, reach - 1)
    sign = hit_lines(files, [r"jwt\.sign\s*\("]).where(~near.rlike(r"(?i)expiresIn\s*:|\bexp\s*:"))
    verify = hit_lines(files, [r"jwt\.verify\s*\("]).where(near.rlike(NONE_ALGORITHM))
    encode = hit_lines(files, [r"jwt\.encode\s*\("]).where(~near.rlike(r"""['"]exp['"]\s*:|(?:timedelta|datetime\.utcnow|datetime\.now|time\.time)\s*\("""))
    decode = hit_lines(files, [r"jwt\.decode\s*\("]).withColumn("stated", ahead.rlike(r"algorithms\s*="))
    parts = [
        _as(sign, "jwt-sign-no-expiry", "high"),
        _as(verify, "jwt-verify-none", "critical"),
        _as(encode, "jwt-encode-no-expiry", "high"),
        _as(decode.where(F.col("stated") & ahead.rlike(NONE_ALGORITHM)), "jwt-decode-none", "critical"),
        _as(decode.where(~F.col("stated")), "jwt-decode-no-algorithms", "high"),
        _as(hit_lines(files, [NONE_IN_HEADER]), "jwt-none", "critical"),
    ]
    return reduce(DataFrame.unionByName, parts)


def outside_docstrings(files: DataFrame) -> DataFrame:
    """path, line, text of the lines that stand in no docstring and hold none.

    A line that opens or closes one turns the state; only counts go through the window, and only of files with quotes.
    """
    every = F.split(F.coalesce("content", F.lit("")), "\n")
    rows = files.select("path", F.posexplode(every).alias("at", "text")).withColumn("line", F.col("at") + 1)
    quotes = F.size(F.split("text", r"\"\"\"")) - 1 + F.size(F.split("text", "'''")) - 1
    state = F.sum(F.col("turns") % 2).over(Window.partitionBy("path").orderBy("line"))
    return rows.withColumn("turns", quotes).withColumn("inside", state % 2 == 1).where("not inside and turns < 2").select("path", "line", "text")


def password_findings(files: DataFrame) -> DataFrame:
    """Assigned literals that look like passwords (one a line), and common weak passwords as literals (one a line)."""
    assigned = [(k, rf"""(?i)\b{k}\s*{sign}\s*["'][^"'{{}}]+["']""") for k in PASSWORD_KEYWORDS for sign in ("=", ":")]
    weak = rf"""(?i)["'](?:{"|".join(WEAK_PASSWORDS)})["']"""
    anything = "|".join([weak, *[p for _, p in assigned]])
    rows = outside_docstrings(files.where(F.col("content").rlike(anything))).where(F.col("text").rlike(anything) & ~F.col("text").rlike(r"^\s*(#|//)"))
    value = lambda p: F.regexp_extract(F.regexp_extract("text", p, 0), r"""["']([^"']+)["']""", 1)
    values = F.array(*[F.struct(F.lit(k).alias("k"), value(p).alias("v")) for k, p in assigned])  # in the patterns' order; no match is an empty value
    likely = F.filter(values, lambda x: likely_password(x["v"]))
    hard = rows.where(~F.col("text").rlike(ENVIRONMENT)).select("path", "line", F.explode(F.slice(likely, 1, 1)).alias("m")).select("path", "line", F.col("m.k").alias("k"))
    common = rows.where(F.col("text").rlike(weak) & ~F.trim("text").rlike(QUOTED_LIST))
    return _as(hard, F.concat(F.lit("hardcoded-"), F.col("k")), "critical").unionByName(_as(common, "weak-password", "high"))


def logging_findings(files: DataFrame) -> DataFrame:
    """Log calls that name something sensitive, outside a comment at the line's end, and mask nothing."""
    code = F.split_part(F.split_part("text", F.lit("  #"), F.lit(1)), F.lit(" //"), F.lit(1))
    rows = hit_lines(files, LOG_CALL, ("#", "//", "*", r"/*")).withColumn("code", code)
    return _as(rows.where((F.col("code").rlike(SENSITIVE_IN_BRACES) | F.col("code").rlike(SENSITIVE)) & ~F.col("code").rlike(MASKED)), "sensitive-log", "medium")


def timeout_findings(files: DataFrame) -> DataFrame:
    """Calls over the network without a time limit: a finding for each pattern and line."""
    return matched(files, TIMEOUTS)
