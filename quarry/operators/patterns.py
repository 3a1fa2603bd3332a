"""Catalogs of line patterns, met through their literals, and the checks that are such catalogs.

A catalog can have hundreds of regular expressions while a line meets hardly any. Each expression has a literal that all
its matches hold; a whole word, if it has one, is looked up among the line's words, another literal is searched as
plain text, and the expression itself runs on what is left.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.projects import resolve_modules
from quarry.operators.rules import lines


@dataclass(frozen=True)
class Entry:
    """A pattern of a catalog. `near` must match within `reach` lines that are no comments, where it is given."""

    id: str
    pattern: str
    language: str = "any"
    severity: str = "high"
    near: str = ""
    reach: int = 10


def gate(pattern: str) -> tuple[str, str] | None:
    """What every match of a pattern holds, in lower case: ("word", w) for a whole word, ("text", t), or None if nothing is sure."""
    from re import IGNORECASE, _constants, _parser

    runs: list[list] = [[]]  # of characters, '' standing for a word boundary

    def walk(items) -> None:
        for op, value in items:
            if op is _constants.LITERAL:
                runs[-1].append(chr(value))
            elif op is _constants.AT and value is _constants.AT_BOUNDARY:
                runs[-1].append("")
            elif op is _constants.SUBPATTERN and not value[1] & IGNORECASE:
                walk(value[3])
            elif op is _constants.MAX_REPEAT and value[0] >= 1 and len(value[2]) and value[0] == value[1]:
                for _ in range(value[0]):
                    walk(value[2])
            elif op not in (_constants.AT, _constants.ASSERT, _constants.ASSERT_NOT):
                runs.append([])

    walk(_parser.parse(pattern))
    words, texts = [], []
    for run in runs:
        texts += "\0".join(c or "\0" for c in run).replace("\0\0\0", "\1").replace("\0", "").split("\1") if "" in run else ["".join(run)]
        word, bounded = "", False
        for c in [*run, None]:
            if c and (c.isalnum() or c == "_"):
                word += c
                continue
            if word and bounded and c is not None:
                words.append(word)
            word, bounded = "", c is not None
    found = max((w for w in words if len(w) > 2 and w.isascii()), key=len, default=None)
    if found:
        return "word", found.lower()
    text = max((t for t in texts if t.isascii()), key=len, default="")
    return ("text", text.lower()) if text else None


LANGUAGES = {"js": "javascript", "ts": "javascript", "typescript": "javascript", "jsx": "javascript", "tsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "python3": "python"}


def canonical(language: Column) -> Column:
    """A language by its usual name; an unknown one is itself, none is empty."""
    clean = F.lower(F.trim(F.coalesce(language, F.lit(""))))
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(names[clean], clean)


def match_catalog(rows: DataFrame, entries: Sequence[Entry]) -> DataFrame:
    """Lines (path, line, text, language) to path, line, rule_id, severity, text: a row for each entry that matches, in any order.

    An entry of a language meets lines of that language and of none; comment lines are the caller's to leave out.
    """
    gates = {e.id: gate(e.pattern) for e in entries}
    words = sorted({g[1] for g in gates.values() if g and g[0] == "word"})
    low = F.lower("text")
    held = F.array_intersect(F.regexp_extract_all(low, F.lit(r"\w+"), F.lit(0)), F.array(*map(F.lit, words))) if words else F.array().cast("array<string>")

    def hit(e: Entry) -> Column:
        g = gates[e.id]
        first = F.lit(True) if g is None else F.array_contains("held", g[1]) if g[0] == "word" else F.contains("low", F.lit(g[1]))
        own = F.lit(True) if e.language == "any" else F.col("language").isin(e.language, "")
        return F.when(own & first & F.col("text").rlike(e.pattern), F.struct(F.lit(e.id).alias("rule_id"), F.lit(e.severity).alias("severity")))

    marked = rows.withColumn("language", canonical(F.col("language"))).withColumn("low", low).withColumn("held", held)
    texts = [g[1] for g in gates.values() if g and g[0] == "text"]
    some = F.size("held") > 0
    for t in dict.fromkeys(texts):
        some = some | F.contains("low", F.lit(t))
    if all(gates.values()):
        marked = marked.where(some)
    return marked.select("path", "line", "text", F.explode(F.array_compact(F.array(*[hit(e) for e in entries]))).alias("m")).select("path", "line", "m.rule_id", "m.severity", "text")


# Calls that are out of date or unsafe, and what user input looks like near them.
USER_INPUT = r"request\s*\.\s*(?:json|form|args|data|values|get_json|files|cookies)|flask\.request|django\.http|cherrypy\.request|bottle\.request|fastapi\s*\.\s*Request|request\.POST|request\.GET|request\.body|environ\.get\s*\(|input\s*\(|sys\.argv"
STALE = (
    Entry("md5", r"hashlib\.md5\(", "python", "high"),
    Entry("sha1", r"hashlib\.sha1\(", "python", "medium"),
    Entry("os-popen", r"os\.popen\(", "python", "high"),
    Entry("cgi-parse", r"cgi\.parse\(", "python", "medium"),
    Entry("imp-load", r"imp\.load_module\(", "python", "medium"),
    Entry("optparse", r"optparse\.", "python", "low"),
    Entry("pickle-load", r"pickle\.loads?\(", "python", "high"),
    Entry("yaml-load", r"yaml\.load\((?!.*Loader)", "python", "high"),
    Entry("eval", r"(?<!\w)eval\(", "python", "high"),
    Entry("template-string", r"\.from_string\(", "python", "critical"),
    Entry("setattr-key", r"setattr\(\s*\w+,\s*(?:key|k|attr|field|name)\s*,", "python", "high"),
    Entry("yaml-unsafe", r"yaml\.unsafe_load\(", "python", "critical"),
    Entry("traceback", r"traceback\.format_exc\(\)", "python", "high"),
    Entry("shell-true", r"subprocess\.(?:call|run|Popen)\(.*shell\s*=\s*True", "python", "high"),
    Entry("debug-run", r"app\.run\(.*debug\s*=\s*True", "python", "medium"),
    Entry("random", r"random\.randint\(|random\.choice\(|random\.random\(", "python", "medium"),
    Entry("verify-false", r"verify\s*=\s*False", "python", "high"),
    Entry("cert-none", r"ssl\.CERT_NONE", "python", "high"),
    Entry("hostname", r"check_hostname\s*=\s*False", "python", "high"),
    Entry("new-buffer", r"new Buffer\(", "javascript", "high"),
    Entry("fs-exists", r"fs\.exists\(", "javascript", "medium"),
    Entry("create-cipher", r"crypto\.createCipher\(", "javascript", "high"),
    Entry("url-parse", r"url\.parse\(", "javascript", "low"),
    Entry("querystring", r"require\(['\"]querystring['\"]\)", "javascript", "low"),
    Entry("proto-guard", r'key\s*==\s*["\']__proto__["\']', "python", "high"),
    Entry("dunder-subscript", r"^\s*\w+\[(?:key|k|name|attr|field)\]\s*=\s*\w", "python", "high", USER_INPUT),
)
# Weak hashes (of any case), ciphers and modes, words that speak of passwords, and words that make a hash harmless.
WEAK_HASHES = (
    Entry("py-md5", r"(?i)hashlib\.md5\s*\("),
    Entry("py-sha1", r"(?i)hashlib\.sha1\s*\("),
    Entry("js-md5", r"(?i)crypto\.createHash\s*\(\s*['\"]md5['\"]\s*\)"),
    Entry("js-sha1", r"(?i)crypto\.createHash\s*\(\s*['\"]sha1['\"]\s*\)"),
    Entry("go-md5", r"(?i)\bmd5\.New\s*\(\s*\)"),
    Entry("go-sha1", r"(?i)\bsha1\.New\s*\(\s*\)"),
    Entry("go-md5-import", r'(?i)"crypto/md5"'),
    Entry("go-sha1-import", r'(?i)"crypto/sha1"'),
    Entry("java-digest", r'(?i)MessageDigest\.getInstance\s*\(\s*"(?:MD5|SHA-?1)"\s*\)'),
    Entry("java-instance", r'(?i)getInstance\s*\(\s*"(?:MD5|SHA1|SHA-1)"\s*\)'),
)
WEAK_CIPHERS = (
    Entry("aes-ecb", r"AES\.MODE_ECB"),
    Entry("des-mode", r"DES\.MODE_"),
    Entry("des-new", r"DES3?\.new\s*\("),
    Entry("arc4-new", r"ARC4\.new\s*\("),
    Entry("triple-des", r"algorithms\.TripleDES\s*\("),
    Entry("modes-ecb", r"modes\.ECB\s*\("),
    Entry("cipher-ecb", r"Cipher\.new\s*\([^)]*MODE_ECB"),
    Entry("js-des", r"crypto\.createCipher(?:iv)?\s*\(\s*['\"]des['\"]"),
    Entry("js-rc4", r"crypto\.createCipher(?:iv)?\s*\(\s*['\"]rc4['\"]"),
    Entry("js-des-ede", r"crypto\.createCipher(?:iv)?\s*\(\s*['\"]des-ede['\"]"),
    Entry("aes-ecb-name", r"['\"]aes-\d+-ecb['\"]"),
    Entry("ecb-name", r"['\"]ECB['\"]"),
    Entry("java-des", r'Cipher\.getInstance\s*\(\s*"DES(?:/|")'),
    Entry("java-ecb", r'Cipher\.getInstance\s*\(\s*"AES/ECB/'),
    Entry("java-rc4", r'Cipher\.getInstance\s*\(\s*"RC4"'),
    Entry("go-des", r"\bdes\.NewCipher\s*\("),
    Entry("go-rc4", r"\brc4\.NewCipher\s*\("),
)
PASSWORDS = r"(?i)password|passwd|pwd|credential|auth|login|signup|register|hash_password|check_password|verify_password|encrypt_password"
HARMLESS = r"(?i)\bchecksum\b|\bcache[_-]?key\b|\bcache\b|\betag\b|\bfingerprint\b|\bfile_hash\b|\bcontent_hash\b|\bmd5sum\b|\bsha1sum\b|\bintegrity\b|\bfile_digest\b|\bmessage_digest\b"


def stale_calls(files: DataFrame, entries: Sequence[Entry] = STALE) -> DataFrame:
    """path, line, rule_id, severity of files (path, content, language): the catalog's calls on lines that are no # comments.

    An entry with `near` counts only where that matches within its reach; only files with a match of such an entry are windowed.
    """
    rows = lines(files).where(~F.col("text").rlike(r"^\s*#"))
    found = match_catalog(rows.where(F.col("text") != ""), entries)
    loose, bound = [e for e in entries if not e.near], [e for e in entries if e.near]
    out = found.where(F.col("rule_id").isin([e.id for e in loose])).select("path", "line", "rule_id", "severity")
    for e in bound:
        mine = found.where(F.col("rule_id") == e.id).select("path", "line", "rule_id", "severity")
        told = rows.join(mine.select("path").distinct(), "path", "left_semi").where(F.col("text").rlike(e.near)).select("path", F.col("line").alias("at"))
        # an equi-join on blocks of lines as long as the reach: what is near lies in a block beside
        spread = told.select("path", "at", F.explode(F.array(*[F.floor(F.col("at") / e.reach) + k for k in (-1, 0, 1)])).alias("part"))
        met = mine.withColumn("part", F.floor(F.col("line") / e.reach)).join(spread, ["path", "part"]).where(F.abs(F.col("at") - F.col("line")) <= e.reach)
        out = out.unionByName(met.select("path", "line", "rule_id", "severity").distinct())
    return out


def weak_crypto(files: DataFrame) -> DataFrame:
    """path, line, rule_id, kind (hash or cipher) of files (path, content, language), on lines that are no # or // comments.

    A hash counts where a line within five speaks of passwords and neither its line nor one of the three before is harmless.
    """
    around = Window.partitionBy("path").orderBy("line")
    rows = lines(files)
    found = match_catalog(rows.where((F.col("text") != "") & ~F.col("text").rlike(r"^\s*(#|//)")), (*WEAK_HASHES, *WEAK_CIPHERS))
    hashes = F.col("rule_id").isin([e.id for e in WEAK_HASHES])
    ciphers = found.where(~hashes).select("path", "line", "rule_id", F.lit("cipher").alias("kind"))
    mine = rows.join(found.where(hashes).select("path").distinct(), "path", "left_semi")
    context = mine.select("path", "line", F.max(F.col("text").rlike(PASSWORDS)).over(around.rowsBetween(-5, 5)).alias("secret"), F.max(F.col("text").rlike(HARMLESS)).over(around.rowsBetween(-3, 0)).alias("safe"))
    sure = found.where(hashes).join(context.where("secret AND NOT safe").select("path", "line"), ["path", "line"])
    return ciphers.unionByName(sure.select("path", "line", "rule_id", F.lit("hash").alias("kind")))


PY_IMPORT = r"(?m)^\s*(?:import|from)\s+([A-Za-z_]\w*)"
JS_IMPORT = r"(?:from\s+|require\(\s*|import\(\s*|import\s+)['\"]([^'\"./][^'\"]*)['\"]"


def unknown_packages(files: DataFrame, known: DataFrame, stdlib: Sequence[str] | None = None) -> DataFrame:
    """path, package, line, ecosystem: packages that Python and JavaScript files import and nobody knows.

    Known are the standard library, the packages of `known` (name, ecosystem) and, for Python, files and folders of the
    project at its top or beside the importing file. Python names are compared in lower case with hyphens, JavaScript
    ones without what follows the package. `line` is the first import's.
    """
    import sys

    language = canonical(F.col("language"))
    text = F.coalesce("content", F.lit(""))
    rows = lines(files, ("path", "language")).withColumn("language", language).where(language.isin("python", "javascript"))
    python = F.array_compact(F.array(F.nullif(F.regexp_extract("text", PY_IMPORT, 1), F.lit(""))))
    script = F.regexp_extract_all("text", F.lit(JS_IMPORT), F.lit(1))
    named = rows.select("path", "language", "line", F.explode(F.when(F.col("language") == "python", python).otherwise(script)).alias("raw"))
    scope = F.when(F.startswith("raw", F.lit("@")), F.substring_index("raw", "/", 2)).otherwise(F.substring_index("raw", "/", 1))
    ecosystem = F.when(F.col("language") == "python", "pypi").otherwise("npm")
    used = named.select("path", "line", ecosystem.alias("ecosystem"), F.when(F.col("language") == "python", F.col("raw")).otherwise(scope).alias("package")).groupBy("path", "ecosystem", "package").agg(F.min("line").alias("line"))
    used = used.withColumn("name", F.when(F.col("ecosystem") == "pypi", F.lower(F.translate("package", "_", "-"))).otherwise(F.col("package")))
    used = used.where((F.col("ecosystem") == "npm") | ~F.col("package").isin(list(stdlib or sorted(sys.stdlib_module_names))))
    left = used.join(known.select("name", "ecosystem").distinct(), ["name", "ecosystem"], "left_anti")
    asked = left.where("ecosystem = 'pypi'").select("path", F.col("package").alias("module"), F.lit(0).alias("level"))
    here = resolve_modules(asked, files.where(text.isNotNull())).where("target_file IS NOT NULL").select("path", F.col("module").alias("package"), F.lit("pypi").alias("ecosystem"))
    tops = files.where(F.contains("path", F.lit("/"))).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("package"), F.lit("pypi").alias("ecosystem")).distinct()
    left = left.join(here, ["path", "package", "ecosystem"], "left_anti").join(tops, ["package", "ecosystem"], "left_anti")
    return left.select("path", "package", "line", "ecosystem")
