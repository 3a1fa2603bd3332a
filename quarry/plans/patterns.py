"""Queries of the catalogs: stale calls, weak hashes and ciphers, unknown packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import patterns as P
from quarry.plans.base import query
from quarry.plans.carriers import CARRIERS

# Lines that catalogs hit, nearly hit and pass; a file has nine of them, by its number.
_SNIPPETS = (
    "x = hashlib.md5(data)", "# x = hashlib.md5(data)", "h = hashlib.sha1(b)", "os.popen(cmd)", "myos.popen (cmd)", "parser = optparse.OptionParser()", "obj = pickle.load(f)", "obj = pickle.loads(b)", "cfg = yaml.load(f)",
    "cfg = yaml.load(f, Loader=SafeLoader)", "eval(code)", "my_eval(code)", "literal_eval(code)", "t = env.from_string(s)", "setattr(o, key, v)", "setattr(o, other, v)", "subprocess.run(cmd, shell = True)", "subprocess.run(cmd)",
    "app.run(port=1, debug=True)", "n = random.randint(1, 2)", "requests.get(u, verify=False)", "ctx.verify_mode = ssl.CERT_NONE", "const b = new Buffer(10);", "fs.exists(p, cb)", "crypto.createCipher(a, k)", "const q = require('querystring')",
    "out[key] = value", "for key in request.json.items():", "def check_password(p):", "# password note", "checksum of it", "c = AES.new(k, AES.MODE_ECB)", "c = DES3.new(k)", "crypto.createCipheriv('des', k, iv)", "m = 'aes-128-ecb'",
    "Cipher.getInstance(\"DES/CBC\")", "rc4.NewCipher(k)", "crypto.createHash('md5')", "MessageDigest.getInstance(\"SHA-1\")", "plain line of text", "y = 1", "login(user)", "z = cache.get(k)",
)
_STEPS = (1, 3, 7, 11, 13, 17, 19, 23, 29)


def _line(step: int) -> str:
    cases = " ".join("WHEN {} THEN '{}'".format(i, s.replace("'", "''")) for i, s in enumerate(_SNIPPETS))
    return f"CASE (p_partkey * {step} + p_size) % {len(_SNIPPETS)} {cases} END"


CARRIERS["apis"] = "SELECT 'api/f' || CAST(p_partkey AS STRING) AS path, CASE p_size % 4 WHEN 0 THEN 'py' WHEN 1 THEN 'Python' WHEN 2 THEN 'ts' ELSE NULL END AS language, " + " || chr(10) || ".join(map(_line, _STEPS)) + " AS content FROM part"
_LINES = "SELECT path, CASE lower(language) WHEN 'py' THEN 'python' WHEN 'python' THEN 'python' WHEN 'ts' THEN 'javascript' ELSE '' END AS language, generate_subscripts(string_split(content, chr(10)), 1) AS line, unnest(string_split(content, chr(10))) AS text FROM apis"
#: The two patterns with look-around, as pairs of a pattern and one that must not match.
_PLAIN = {"yaml-load": (r"yaml\.load\(", r"yaml\.load\(.*Loader"), "eval": (r"(^|\W)eval\(", "")}


def _values(entries) -> str:
    rows = []
    for e in entries:
        pattern, never = _PLAIN.get(e.id, (e.pattern, ""))
        rows.append("({})".format(", ".join("'{}'".format(x.replace("'", "''")) for x in (e.id, pattern, never, e.language, e.severity, e.near))))
    return f"(VALUES {', '.join(rows)}) AS r(rule_id, pattern, never, lang, severity, near)"


@query("c9_stale_calls", f"""WITH l AS ({_LINES})
SELECT l.path, l.line, rule_id, severity FROM l JOIN {_values(P.STALE)} ON (lang = language OR language = '') AND regexp_matches(text, pattern) AND (never = '' OR NOT regexp_matches(text, never))
WHERE NOT regexp_matches(text, '^\\s*#') AND (near = '' OR EXISTS (SELECT 1 FROM l AS m WHERE m.path = l.path AND abs(m.line - l.line) <= 10 AND NOT regexp_matches(m.text, '^\\s*#') AND regexp_matches(m.text, near)))""", ("apis",))
def c9(apis):
    return P.stale_calls(apis)


@query("c6_weak_crypto", f"""WITH l AS (SELECT *, bool_or(regexp_matches(text, '{P.PASSWORDS}')) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS secret,
  bool_or(regexp_matches(text, '{P.HARMLESS}')) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS safe FROM ({_LINES}))
SELECT path, line, rule_id, 'hash' AS kind FROM l JOIN {_values(P.WEAK_HASHES)} ON regexp_matches(text, pattern) WHERE secret AND NOT safe AND NOT regexp_matches(text, '^\\s*(#|//)')
UNION ALL SELECT path, line, rule_id, 'cipher' FROM l JOIN {_values(P.WEAK_CIPHERS)} ON regexp_matches(text, pattern) WHERE NOT regexp_matches(text, '^\\s*(#|//)')""", ("apis",))
def c6(apis):
    return P.weak_crypto(apis)


# Files that import packages of suppliers' numbers; those with even numbers are published.
CARRIERS["importing"] = """SELECT CASE WHEN p_size % 9 = 0 THEN 'pkg' || CAST(p_partkey % 50 AS STRING) || '/f' ELSE 'src/f' END || CAST(p_partkey AS STRING) || CASE WHEN p_size % 2 = 0 THEN '.py' ELSE '.ts' END AS path,
 CASE WHEN p_size % 2 = 0 THEN 'python' ELSE 'ts' END AS language,
 CASE WHEN p_size % 2 = 0 THEN 'import os, sys' || chr(10) || 'from Pkg_' || CAST(p_partkey % 30 AS STRING) || '.sub import x' || chr(10) || '  import pkg' || CAST(p_partkey % 60 AS STRING) || ' as p'
 ELSE 'import a from ''@scope/p' || CAST(p_partkey % 30 AS STRING) || '/deep'';' || chr(10) || 'const b = require("lib' || CAST(p_partkey % 30 AS STRING) || '/x"); import c from ''./own'';' END AS content FROM part"""
CARRIERS["published"] = "SELECT 'pkg-' || CAST(s_suppkey AS STRING) AS name, 'pypi' AS ecosystem FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT '@scope/p' || CAST(s_suppkey AS STRING), 'npm' FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'lib' || CAST(s_suppkey AS STRING), 'npm' FROM supplier WHERE s_suppkey % 5 = 0"


@query("c8_unknown_packages", """WITH n AS (SELECT path, 2 AS line, 'Pkg_' || regexp_extract(content, 'from Pkg_(\\d+)', 1) AS package, 'pypi' AS ecosystem FROM importing WHERE language = 'python'
  UNION ALL SELECT path, 3, 'pkg' || regexp_extract(content, 'import pkg(\\d+)', 1), 'pypi' FROM importing WHERE language = 'python'
  UNION ALL SELECT path, 1, '@scope/p' || regexp_extract(content, '@scope/p(\\d+)', 1), 'npm' FROM importing WHERE language = 'ts'
  UNION ALL SELECT path, 2, 'lib' || regexp_extract(content, '"lib(\\d+)', 1), 'npm' FROM importing WHERE language = 'ts')
SELECT path, line, package, ecosystem FROM n WHERE NOT EXISTS (SELECT 1 FROM published k WHERE k.ecosystem = n.ecosystem AND k.name = CASE WHEN n.ecosystem = 'pypi' THEN lower(replace(package, '_', '-')) ELSE package END)
AND NOT (ecosystem = 'pypi' AND package IN (SELECT split_part(path, '/', 1) FROM importing))""", ("importing", "published"))
def c8(files, published):
    return P.unknown_packages(files, published).select("path", F.col("line").cast("int").alias("line"), "package", "ecosystem")
