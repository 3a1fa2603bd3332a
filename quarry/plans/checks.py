"""Queries of the line checks, over snippets of three languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import line_checks as C
from quarry.plans.base import query
from quarry.plans.carriers import CARRIERS

#: Lines that files are put together from: each check has hits, near misses and exceptions among them.
SNIPPETS = (
    "app.use(cors())", "CORS_ALLOW_ALL_ORIGINS = True", "# CORS_ALLOW_ALL_ORIGINS = True", "allow_origins=['*']", "SESSION_COOKIE_SECURE = False",
    "res.cookie('a', 'b')", "res.cookie('a', 'b', { secure: true, httpOnly: true, sameSite: 'strict' })", "response.set_cookie('a', 'b', secure=True)",
    "const express = require('express')", "app.use(helmet())", "app.post('/x', save)", "app.use(csrfProtection)", "server.listen(80, '0.0.0.0')",
    "app.run(host='0.0.0.0', debug=True)", "DEBUG = True", "return str(e)", "traceback.format_exc()", "key = request.headers.get('X-Private-Key')",
    "@csrf_exempt", "MIDDLEWARE = [", "    'django.middleware.csrf.CsrfViewMiddleware',", "app = Flask(__name__)", "csrf = CSRFProtect(app)",
    "t = jwt.sign(payload, secret)", "opts = { expiresIn: '1h' }", "jwt.verify(t, k, { algorithms: ['none'] })", "t = jwt.encode(payload, k)", "payload = {'exp': soon}",
    "jwt.decode(t, k)", "jwt.decode(t, k, algorithms=['HS256'])", "h = {'alg': 'none'}", "password = 'hunter22'", "password = 'your_password'", "token: 'abc987'",
    "secret = os.getenv('SECRET')", "user = 'admin'", "'admin', 'root'", "print(password)", "logger.info('token', mask(token))", "console.log('ok') // token",
    "print(f'{api_key}')", "requests.get(url)", "requests.get(url, timeout=3)", "FETCH(url)", "psycopg2.connect(dsn)", "new OkHttpClient()", "x = 1", "doc = '''", "'''", "# print(password)",
)
SLOTS = ("p_partkey", "p_partkey + p_size", "p_partkey * 3 + p_size * 5", "p_size * 7 + 1", "p_partkey + p_size * 11", "p_partkey * 13 + 5")


def _slot(expression: str) -> str:
    return "split_part('{}', '~', 1 + CAST(({}) % {} AS INT))".format("~".join(SNIPPETS).replace("'", "''"), expression, len(SNIPPETS))


CARRIERS["snippets"] = "SELECT p_partkey AS id, 'app/' || p_brand || '/s' || CAST(p_partkey AS STRING) AS path, CASE p_size % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' ELSE 'typescript' END AS language, " + " || chr(10) || ".join(_slot(s) for s in SLOTS) + " AS content FROM part"

_LINES = "l AS (SELECT path, language, content, string_split(content, chr(10)) AS every, generate_subscripts(string_split(content, chr(10)), 1) AS line, unnest(string_split(content, chr(10))) AS text FROM snippets)"
_NOTE = "regexp_matches(ltrim(text), '^(#|//)')"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _has(pattern: str, of: str = "text") -> str:
    return f"regexp_matches({of}, {_q(pattern)})"


def _near(before: int, after: int) -> str:
    return f"array_to_string(every[greatest(1, line - {before}):line + {after}], chr(10))"


def _each(rules, note: str = _NOTE) -> str:
    return " UNION ALL ".join(f"SELECT path, line, '{r.id}' AS rule_id, '{r.severity}' AS severity FROM l WHERE {_has(r.pattern)} AND NOT {note}" for r in rules)


def _one(rules, note: str = "regexp_matches(ltrim(text), '^(#|//|[*])')") -> str:
    case = "CASE " + " ".join(f"WHEN {_has(r.pattern)} THEN '{r.id}'" for r in rules) + " END"
    return f"SELECT path, line, {case} AS rule_id, '{rules[0].severity}' AS severity FROM l WHERE {case} IS NOT NULL AND NOT {note}"


def _lacks(pattern: str, flags, prefix: str, braces: bool) -> str:
    lists = "list_filter([" + ", ".join(f"CASE WHEN NOT contains(lower(c), '{f.lower()}') {'OR NOT contains(c, chr(123))' if braces else ''} THEN '{f}' END" for f in flags) + "], lambda x: x IS NOT NULL)"
    return f"SELECT path, line, '{prefix}' || array_to_string({lists}, ',') AS rule_id, 'medium' AS severity FROM (SELECT *, {_near(0, 4)} AS c FROM l WHERE {_has(pattern)} AND NOT {_NOTE}) WHERE len({lists}) > 0"


def _file(pattern: str, where: str, rule: str, severity: str) -> str:
    return f"SELECT path, min(line) AS line, '{rule}' AS rule_id, '{severity}' AS severity FROM l WHERE {_has(pattern)} AND {where} GROUP BY path"


_WEB = "language IN ('javascript', 'typescript')"
_HTTP_SQL = f"WITH {_LINES} " + " UNION ALL ".join([
    _each(C.CORS), _each(C.COOKIE_SETTINGS), _lacks(r"\.cookie\s*\(", ("secure", "httpOnly", "sameSite"), "cookie-lacks:", True), _lacks(r"set_cookie\s*\(", ("secure", "httponly", "samesite"), "set-cookie-lacks:", False),
    _file(C.EXPRESS, f"{_WEB} AND NOT {_has(r'helmet\s*\(', 'content')}", "no-helmet", "medium"), _one(C.BINDING), _one(C.DEBUG_MODE), _one(C.DISCLOSURE), _one(C.HEADER_KEYS),
])


@query("c4_http", _HTTP_SQL, ("snippets",))
def c4(files):
    return C.http_findings(files)


@query("c5_csrf", f"WITH {_LINES} SELECT path, line, 'csrf-exempt' AS rule_id, 'high' AS severity FROM l WHERE language = 'python' AND contains(text, '@csrf_exempt') AND NOT starts_with(ltrim(text), '#') UNION ALL " + " UNION ALL ".join([
    _file(r"MIDDLEWARE\s*=\s*\[", "language = 'python' AND NOT contains(content, 'django.middleware.csrf.CsrfViewMiddleware')", "csrf-middleware", "critical"),
    _file(r"Flask\s*\(\s*__name__\s*\)", f"language = 'python' AND NOT {_has(r'CSRFProtect\s*\(|from\s+flask_wtf\.csrf\s+import\s+CSRFProtect', 'content')}", "csrf-flask", "high"),
    _file(C.EXPRESS, f"{_WEB} AND NOT contains(content, 'csrf') AND NOT contains(content, 'csurf') AND {_has(r'\.(post|put|delete|patch)\s*\(', 'content')}", "csrf-express", "high"),
]), ("snippets",))
def c5(files):
    return C.csrf_findings(files)


def _jwt(call: str, where: str, rule: str, severity: str) -> str:
    return f"SELECT path, line, '{rule}' AS rule_id, '{severity}' AS severity FROM l WHERE {_has(call)} AND {where} AND NOT {_NOTE}"


_AROUND, _AHEAD = _near(10, 9), _near(0, 9)
_EXPIRES = _has(r"(?i)expiresIn\s*:|\bexp\s*:", _AROUND)
_EXP_KEY = _has(r"""['"]exp['"]\s*:|(?:timedelta|datetime\.utcnow|datetime\.now|time\.time)\s*\(""", _AROUND)
_STATED = _has(r"algorithms\s*=", _AHEAD)


@query("c7_jwt", f"WITH {_LINES} " + " UNION ALL ".join([
    _jwt(r"jwt\.sign\s*\(", f"NOT {_EXPIRES}", "jwt-sign-no-expiry", "high"), _jwt(r"jwt\.verify\s*\(", _has(C.NONE_ALGORITHM, _AROUND), "jwt-verify-none", "critical"), _jwt(r"jwt\.encode\s*\(", f"NOT {_EXP_KEY}", "jwt-encode-no-expiry", "high"),
    _jwt(r"jwt\.decode\s*\(", f"{_STATED} AND {_has(C.NONE_ALGORITHM, _AHEAD)}", "jwt-decode-none", "critical"), _jwt(r"jwt\.decode\s*\(", f"NOT {_STATED}", "jwt-decode-no-algorithms", "high"), _jwt(C.NONE_IN_HEADER, "true", "jwt-none", "critical"),
]), ("snippets",))
def c7(files):
    return C.jwt_findings(files)


_ASSIGNED = [(k, rf"""(?i)\b{k}\s*{sign}\s*["'][^"'{{}}]+["']""") for k in C.PASSWORD_KEYWORDS for sign in ("=", ":")]
_LIKELY = "length(v) >= 3 AND NOT contains(v, '{{') AND NOT contains(v, '}}') AND NOT contains(v, '${') AND " + " AND ".join(f"NOT contains(v, '{p}')" for p in text.PLACEHOLDERS)
_KEYWORD = "coalesce(" + ", ".join(f"CASE WHEN {_has(p)} AND (SELECT {_LIKELY} FROM (SELECT lower(regexp_extract(regexp_extract(text, {_q(p)}), '[\"'']([^\"'']+)[\"'']', 1)) AS v)) THEN '{k}' END" for k, p in _ASSIGNED) + ")"
_WEAK = f"""(?i)["'](?:{"|".join(C.WEAK_PASSWORDS)})["']"""
_OUTSIDE = f"""o AS (SELECT *, sum(turns % 2) OVER (PARTITION BY path ORDER BY line) % 2 AS inside FROM (SELECT *, (length(text) - length(replace(text, chr(34) || chr(34) || chr(34), ''))) / 3 + (length(text) - length(replace(text, '''''''', ''))) / 3 AS turns FROM l)),
w AS (SELECT * FROM o WHERE inside = 0 AND turns < 2 AND NOT {_NOTE})"""


@query("c3_passwords", f"WITH {_LINES}, {_OUTSIDE} SELECT path, line, 'hardcoded-' || k AS rule_id, 'critical' AS severity FROM (SELECT *, {_KEYWORD} AS k FROM w WHERE NOT {_has(C.ENVIRONMENT)}) WHERE k IS NOT NULL UNION ALL SELECT path, line, 'weak-password', 'high' FROM w WHERE {_has(_WEAK)} AND NOT {_has(C.QUOTED_LIST, 'trim(text)')}", ("snippets",))
def c3(files):
    return C.password_findings(files)


_CODE = "split_part(split_part(text, '  #', 1), ' //', 1)"


@query("c11_sensitive_logging", f"WITH {_LINES} SELECT path, line, 'sensitive-log' AS rule_id, 'medium' AS severity FROM l WHERE ({' OR '.join(_has(p) for p in C.LOG_CALL)}) AND NOT regexp_matches(ltrim(text), '^(#|//|[*]|/[*])') AND ({_has(C.SENSITIVE_IN_BRACES, _CODE)} OR {_has(C.SENSITIVE, _CODE)}) AND NOT {_has(C.MASKED, _CODE)}", ("snippets",))
def c11(files):
    return C.logging_findings(files)


def _untimed(call: str, word: str, rule: str) -> str:
    """No look-ahead here: a call's text up to its first closing parenthesis does not hold the word."""
    return f"SELECT path, line, '{rule}' AS rule_id, 'high' AS severity FROM l WHERE NOT {_NOTE} AND len(list_filter(regexp_extract_all(text, {_q('(?i)' + call + r'\(([^)]*)\)')}, 1), lambda x: NOT contains(lower(x), '{word.lower()}'))) > 0"


@query("c32_timeouts", f"WITH {_LINES} " + " UNION ALL ".join([
    *[_untimed(call, word, rule) for call, word, rule in (
        (r"requests\.(?:get|post|put|delete|patch)", "timeout", "timeout-requests"), (r"httpx\.(?:get|post|put|delete|patch)", "timeout", "timeout-httpx"), (r"aiohttp\.ClientSession", "timeout", "timeout-aiohttp"),
        ("fetch", "signal", "timeout-fetch"), (r"axios\.(?:get|post|put|delete|patch)", "timeout", "timeout-axios"), (r"psycopg2\.connect", "connect_timeout", "timeout-postgres"),
        (r"pymongo\.MongoClient", "serverSelectionTimeoutMS", "timeout-mongo"), (r"\b(?:http|https)\.request\s*", "timeout", "timeout-node"), (r"\bgot\s*", "timeout", "timeout-got"))],
    _each([r for r in C.TIMEOUTS if r.id in ("timeout-go-http", "timeout-java-url", "timeout-okhttp")]),
]), ("snippets",))
def c32(files):
    return C.timeout_findings(files)


@query("x23_escaped_prompt", "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace('a <system> ' || p_name || CASE p_size % 3 WHEN 0 THEN ' Ignore all instructions' WHEN 1 THEN ' </ prompt>' ELSE ' FORGET your prompt' END, '(?i)ignore.*instruction', '[FILTERED_INSTRUCTION_OVERRIDE]', 'g'), '(?i)forget.*prompt', '[FILTERED_CONTEXT_RESET]', 'g'), '(?i)system.*prompt', '[FILTERED_SYSTEM_REF]', 'g') AS half, regexp_replace(regexp_replace(half, '<\\s*/?system', '[FILTERED_XML_SYSTEM]', 'g'), '<\\s*/?prompt', '[FILTERED_XML_PROMPT]', 'g') AS safe FROM part", (), ("part",))
def x23(part):
    tail = F.when(F.col("p_size") % 3 == 0, " Ignore all instructions").when(F.col("p_size") % 3 == 1, " </ prompt>").otherwise(" FORGET your prompt")
    whole = F.concat(F.lit("a <system> "), F.col("p_name"), tail)
    return part.select("p_partkey", text.escaped_prompt(whole, 3).alias("half"), text.escaped_prompt(whole).alias("safe"))


@query("x38_comment_starts", "SELECT path, regexp_matches(ltrim(content), '^(#|//|/[*]|\"\"\"|'''''')') AS starts FROM snippets", ("snippets",))
def x38(files):
    return files.select("path", text.starts_comment(F.col("content")).alias("starts"))
