"""Column functions on code and text: normalisation, keys, masking, names, versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_COMMENTS = ("python", "yaml", "shell")
SLASH_COMMENTS = ("javascript", "typescript", "tsx", "java", "csharp", "go", "rust", "kotlin", "swift", "cpp", "c", "dart", "php")


def normalized_code(content: Column, language: Column) -> Column:
    """Code without comments (by language) and without layout; equal results mean equal programs but for those."""
    c = F.regexp_replace(F.coalesce(content, F.lit("")), "\r\n?", "\n")
    no_block = F.regexp_replace(c, r"(?s)/\*.*?\*/", "")
    no_slash = F.regexp_replace(no_block, r"(?m)//.*$", "")
    no_dash = F.regexp_replace(F.regexp_replace(c, r"(?m)--.*$", ""), r"(?s)/\*.*?\*/", "")
    c = (
        F.when(language.isin(*HASH_COMMENTS), F.regexp_replace(c, r"(?m)#.*$", ""))
        .when(language.isin(*SLASH_COMMENTS), no_slash)
        .when(language == "sql", no_dash)
        .when(language == "html", F.regexp_replace(c, r"(?s)<!--.*?-->", ""))
        .otherwise(c)
    )
    c = F.regexp_replace(c, r"\s+", " ")
    return F.trim(F.regexp_replace(c, r"\s*([{}()\[\],;.:<>])\s*", "$1"))


def code_hash(content: Column, language: Column) -> Column:
    return F.sha2(normalized_code(content, language), 256)


# How messages refer to lines, and what a flow's message looks like.
LINE_REFERENCE = r"\s*\(line \d+\)|\bat line \d+\b"
TAINT_MESSAGE = r"Unsanitized data flow:\s*(\S+)\s+\(line \d+\)\s*->\s*(\S+)\s+\[([^\]]+)\]"


def finding_fingerprint(rule: Column, path: Column, message: Column) -> Column:
    """Key of a finding that outlives shifted lines: rule, path, and the message without line references.

    The message of a flow is its source, sink and type alone.
    """
    parts = [F.regexp_extract(message, TAINT_MESSAGE, i) for i in (1, 2, 3)]
    flow = F.concat(F.lit("taint:"), parts[0], F.lit("->"), parts[1], F.lit("["), parts[2], F.lit("]"))
    stable = F.when(message.rlike(TAINT_MESSAGE), flow).otherwise(F.regexp_replace(message, LINE_REFERENCE, ""))
    return F.sha2(F.concat_ws(":", rule, path, stable), 256)


def cache_key(frame: Column, path: Column, content: Column) -> Column:
    return F.concat_ws(":", frame, path, F.substring(F.sha2(F.coalesce(content, F.lit("")), 256), 1, 16))


def chunk_id(path: Column, start: Column, end: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), content), 256), 1, 16)


def short_file_hash(content: Column) -> Column:
    return F.substring(F.md5(F.coalesce(content, F.lit(""))), 1, 8)


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def truncated(text: Column, max_tokens: int, first: int = 20, last: int = 10) -> Column:
    """The text if it fits, else its first and last lines around a mark, cut at four characters a token."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    head = F.array_join(F.slice(lines, 1, first), "\n")
    tail = F.array_join(F.slice(lines, F.greatest(n - last + 1, F.lit(1)), last), "\n")
    short = F.when(n <= first + last, text).otherwise(F.concat(head, F.lit("\n... [truncated] ...\n"), tail))
    return F.when(estimated_tokens(text) <= max_tokens, text).otherwise(F.substring(short, 1, max_tokens * 4))


def package_name(name: Column) -> Column:
    """Lower case, without scope, underscores as dashes."""
    return F.translate(F.regexp_replace(F.lower(F.trim(name)), r"^@[^/]+/", ""), "_", "-")


# Affixes that turn one package name into a look-alike of another.
PREFIXES = ("python-", "py-", "node-", "js-")
SUFFIXES = ("-python", "-py", "-node", "-js", "-dev", "2", "3")


def is_affix_swap(a: Column, b: Column) -> Column:
    tests = [t for p in PREFIXES for t in (a == F.concat(F.lit(p), b), b == F.concat(F.lit(p), a))]
    tests += [t for s in SUFFIXES for t in (a == F.concat(b, F.lit(s)), b == F.concat(a, F.lit(s)))]
    return reduce(Column.__or__, tests)


def bare_version(version: Column) -> Column:
    """Without leading specifier characters and trailing dots and stars; `*` and `latest` give an empty string."""
    v = F.trim(version)
    return F.when(v.isin("*", "latest"), F.lit("")).otherwise(F.regexp_replace(F.regexp_replace(v, r"^[\^~>=<! ]+", ""), r"[.*]+$", ""))


def masked_pii(text: Column) -> Column:
    """E-mail addresses and long keys, tokens and secrets are replaced."""
    t = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    return F.regexp_replace(t, r"(?i)(api[_-]?key|token|secret)(\s*[=:]\s*)[\"']?[A-Za-z0-9_\-]{20,}[\"']?", "$1=***")


def masked_quotes(line: Column) -> Column:
    return F.regexp_replace(line, r"([\"'])[^\"']{3,}([\"'])", "$1***REDACTED***$2")


#: Words that mark a quoted value as a placeholder.
PLACEHOLDERS = ("your_password", "password_here", "enter_password", "change_me", "placeholder", "example", "todo", "xxx")


def likely_password(quoted: Column) -> Column:
    """Whether a quoted value is no placeholder, no template variable and not shorter than 3."""
    v = F.lower(quoted)
    return reduce(Column.__and__, [~v.contains(p) for p in (*PLACEHOLDERS, "{{", "}}", "${")], F.length(v) >= 3)


#: What is taken out of a text before it goes into a prompt, in this order, and what stands there then.
PROMPT_FILTERS = (
    (r"(?i)ignore.*instruction", "[FILTERED_INSTRUCTION_OVERRIDE]"),
    (r"(?i)forget.*prompt", "[FILTERED_CONTEXT_RESET]"),
    (r"(?i)system.*prompt", "[FILTERED_SYSTEM_REF]"),
    (r"<\s*/?system", "[FILTERED_XML_SYSTEM]"),
    (r"<\s*/?prompt", "[FILTERED_XML_PROMPT]"),
)
COMMENT_STARTS = ("#", "//", "/*", '"""', "'''")


def escaped_prompt(text: Column, steps: int = len(PROMPT_FILTERS)) -> Column:
    for pattern, instead in PROMPT_FILTERS[:steps]:
        text = F.regexp_replace(text, pattern, instead)
    return text


def starts_comment(code: Column) -> Column:
    """Whether code starts with a comment or docstring, after white space."""
    return reduce(Column.__or__, [F.startswith(F.regexp_replace(code, r"^\s+", ""), F.lit(m)) for m in COMMENT_STARTS])


def finding_keywords(text: Column, stop: tuple[str, ...] = ("this", "that", "with", "from", "have", "code", "line", "file", "found")) -> Column:
    """Different lower-case words of more than three letters that are no stop words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda w: (F.length(w) > 3) & ~w.isin(*stop)))


VERB_CLASS = {
    "query": ("get", "fetch", "load", "find", "retrieve", "query"),
    "create": ("create", "add", "insert", "post", "save", "submit", "process"),
    "update": ("update", "edit", "modify", "patch", "put"),
    "delete": ("delete", "remove", "destroy", "drop"),
}
VERBS = tuple(v for verbs in VERB_CLASS.values() for v in verbs)


def operation_stem(name: Column) -> Column:
    """The name without its first matching verb, the next letter lower-cased."""
    out = None
    for v in VERBS:
        hit = F.startswith(F.lower(name), F.lit(v)) & (F.length(name) > len(v))
        stem = F.concat(F.lower(F.substring(name, len(v) + 1, 1)), F.substring(name, F.lit(len(v) + 2), F.length(name)))
        out = F.when(hit, stem) if out is None else out.when(hit, stem)
    return out.otherwise(name)


def verb_class(name: Column) -> Column:
    """What a name's verb does: query, create, update, delete, or null; of several verbs the first that it begins with."""
    return F.coalesce(*[F.when(F.startswith(F.lower(name), F.lit(v)), F.lit(c)) for c, verbs in VERB_CLASS.items() for v in verbs])


def bare_type(name: Column) -> Column:
    """Lower-case element type of list, array and optional wrappers."""
    t = F.lower(F.trim(name))
    t = F.regexp_replace(t, r"^(?:list|array|optional|set|future|promise)<(.*)>$", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"\[\]$", ""), r"\?$", "")


#: `number` is in two groups, so the relation does not chain.
TYPE_GROUPS = (("string", "str", "text", "varchar"), ("int", "integer", "long", "number"), ("float", "double", "decimal", "number"), ("bool", "boolean"))


def types_compatible(a: Column, b: Column) -> Column:
    x, y = bare_type(a), bare_type(b)
    return reduce(Column.__or__, [x.isin(*g) & y.isin(*g) for g in TYPE_GROUPS], x == y)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def glob_regex(glob: str) -> str:
    """A shell glob on whole paths: `*` and `?` match slashes too."""
    special = set(".^$+{}[]()|\\")
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in glob) + "$"


def ignore_regex(pattern: str) -> str:
    """An ignore-file pattern: a leading slash anchors, a trailing one asks for a child, `**` crosses slashes."""
    anchored, child = pattern.startswith("/"), pattern.endswith("/")
    body, out, i = pattern.strip("/"), "", 0
    while i < len(body):
        if body.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = body[i]
            out += "[^/]*" if c == "*" else "." if c == "?" else "\\" + c if c in ".^$+{}[]()|\\" else c
            i += 1
    return ("^" if anchored else "(^|/)") + out + ("/.+" if child else "(/|$)")
