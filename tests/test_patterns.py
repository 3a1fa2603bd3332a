"""Pattern catalogs: gates lose no match, and checks keep their contexts."""

import re

import pytest

from quarry.operators import patterns
from quarry.plans.patterns import _SNIPPETS

ODD = [r"a+bcd\.x", r"(?:ab|ac)def", r"(foo)?bar\(", r"\bword\b", r"x{2}yz", r"[ab]cde", r"(?i)MixedCase\s*\(", r"^\s*$", r"a|b", r"pre(?:fix)+\.end\(", r".\.mid\.", "é\\.abc"]
LINES = [*_SNIPPETS, "aabcd.x", "abdef", "bar(", "a word.", "xxyz", "bcde", "MIXEDCASE (", "", "b", "prefixfix.end(", "q.mid.", "é.abc", "password = hashlib.MD5 (x)"]


@pytest.mark.parametrize("pattern", [*ODD, *[e.pattern for e in (*patterns.STALE, *patterns.WEAK_HASHES, *patterns.WEAK_CIPHERS)]])
def test_what_a_gate_asks_for_stands_in_every_match(pattern):
    g = patterns.gate(pattern)
    for line in LINES:
        if re.search(pattern, line) and g:
            low = line.lower()
            assert g[1] in (re.findall(r"\w+", low, re.ASCII) if g[0] == "word" else low)


def test_a_catalog_meets_what_each_pattern_meets_alone(spark):
    entries = [patterns.Entry(f"e{i}", p, "any" if i % 2 else "python") for i, p in enumerate(ODD)]
    rows = [("f", i, t, lang) for i, t in enumerate(LINES) for lang in ("python", "go", None)]
    got = {(r["line"], r["rule_id"]) for r in patterns.match_catalog(spark.createDataFrame(rows, "path string, line int, text string, language string"), entries).collect()}
    assert got == {(i, e.id) for i, t in enumerate(LINES) for e in entries if re.search(e.pattern, t)}
    only = patterns.match_catalog(spark.createDataFrame([("f", 1, "aabcd.x", "go")], "path string, line int, text string, language string"), entries)
    assert only.count() == 0  # a python pattern


FILES = "path string, content string, language string"


def test_a_subscript_counts_only_near_user_input(spark):
    gap = "\n".join(["pass"] * 9)
    files = [("near.py", f"for k in request.args:\n{gap}\nout[k] = v", "py"), ("far.py", f"for k in request.args:\n{gap}\npass\nout[k] = v", "python3"), ("note.py", "# request.args\nout[k] = v", None), ("after.py", "out[name] = v\nx = input()", "python")]
    got = {(r["path"], r["line"]) for r in patterns.stale_calls(spark.createDataFrame(files, FILES)).collect()}
    assert got == {("near.py", 11), ("after.py", 1)}


def test_hashes_need_passwords_near_and_no_harmless_word_before(spark):
    files = [
        ("a.py", "def login():\n\n\n\n\n  hashlib.md5(x)", "python"), ("b.py", "def login():\n\n\n\n\n\n  hashlib.md5(x)", "python"), ("c.py", "pwd\n# etag\n\n\nhashlib.sha1(x)", "python"),
        ("d.py", "pwd\n# etag\n\n\n\nhashlib.sha1(x)", "python"), ("e.js", "// crypto.createCipher('des')\ncrypto.createCipher('des')", "js"), ("f.py", None, None),
    ]
    got = {(r["path"], r["line"], r["kind"]) for r in patterns.weak_crypto(spark.createDataFrame(files, FILES)).collect()}
    assert got == {("a.py", 6, "hash"), ("d.py", 6, "hash"), ("e.js", 2, "cipher")}


def test_unknown_packages_are_in_no_registry_and_no_project(spark):
    files = [("src/a.py", "import os, json\nimport numpy as np\nfrom My_Lib.x import y\nimport ghost\nfrom near import z\nimport src.b\nfrom . import q\nimport ghost", "python"), ("src/near.py", "", "python"), ("web/x.ts", "import a from 'react'\nrequire('@me/lib/deep')\nimport('ghost/x')\nimport './own'", "ts"), ("n.go", "import ghost", "go")]
    known = spark.createDataFrame([("numpy", "pypi"), ("my-lib", "pypi"), ("react", "npm"), ("ghost", "cargo")], "name string, ecosystem string")
    got = {tuple(r) for r in patterns.unknown_packages(spark.createDataFrame(files, FILES), known).collect()}
    assert got == {("src/a.py", "ghost", 4, "pypi"), ("web/x.ts", "@me/lib", 2, "npm"), ("web/x.ts", "ghost", 3, "npm")}


def test_nothing_in_nothing_out(spark):
    none = spark.createDataFrame([], FILES)
    assert patterns.stale_calls(none).count() == 0 and patterns.weak_crypto(none).count() == 0
