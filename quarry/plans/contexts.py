"""Queries of evidence: the context of files, and the checks that sets of files need."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import contexts as C
from quarry.plans.base import query
from quarry.plans.carriers import CARRIERS

_PLACES = ("src/core/", "tests/unit/", "examples/", "vendor/x/", "pkg/frames/", "docs/", "config/", "db/migrations/", "mocks/", "build/", "scripts/", "app/")
_ENDS = (".py", "_test.py", ".md", "_pb2.py", ".js", ".yaml", "_demo.py")
_TEXTS = (
    "x = 1", "import pytest\ndef test_a():\n    assert a == b", "# Example: use\n# Usage: it", "class AFrame(ValidationFrame):\n    def detect_pattern(self):", "def upgrade(x):\n  pass\ndef downgrade(x):\n  ALTER TABLE t", "# Generated by tool\nx = 2",
    "# Third-party code", "# quarry-context: Fixture\nx", "# quarry-context: nothing", "from hypothesis import given", "describe('a', () => it('b'))", "import requests\nfrom typing import Any\nclass A:\n  def f(self): eval(x)", "import argparse\npassword = 1\n@dataclass",
)


def _case(values, expression: str) -> str:
    return f"CASE {expression} " + " ".join("WHEN {} THEN {}".format(i, " || chr(10) || ".join("'{}'".format(p.replace("'", "''")) for p in v.split("\n"))) for i, v in enumerate(values)) + " END"


CARRIERS["mixed"] = f"SELECT p_partkey AS id, 'mod' || CAST(p_partkey % 300 AS STRING) AS module, {_case(_PLACES, f'p_partkey % {len(_PLACES)}')} || 'f' || CAST(p_partkey AS STRING) || {_case(_ENDS, f'p_size % {len(_ENDS)}')} AS path, {_case(_TEXTS, f'(p_partkey * 5 + p_size) % {len(_TEXTS)}')} AS content FROM part"


def _sql_any(column: str, patterns, flags: str = "") -> str:
    return "regexp_matches({}, '{}{}')".format(column, flags, "|".join(f"(?:{p})" for p in patterns).replace("'", "''"))


_PATH = "CASE " + " ".join(f"WHEN {_sql_any('path', ps, '(?i)')} THEN '{c}'" for c, ps in C.PATHS.items()) + " END"
_COUNTS = ", ".join("{} AS n_{}".format(" + ".join(f"{_sql_any('content', [p], '(?m)')}::INT" for p in ps), c) for c, ps in C.CONTENTS.items())
_TOOLS = " OR ".join(f"contains(content, '{w} {t}')" for t in C.TEST_IMPORTS for w in ("import", "from"))
_SCORES = " UNION ALL ".join(f"SELECT id, 1 AS place, 'content' AS method, '{c}' AS context, least(round(0.5 + n_{c} * 0.1, 2), 0.95)::DOUBLE AS confidence, {i} AS inner_place FROM t WHERE n_{c} > 0" for i, c in enumerate(C.CONTENTS))


@query("h6_file_contexts", f"""WITH t AS (SELECT id, path, content, {_PATH} AS by_path, {_COUNTS}, path LIKE '%.py' AND ({_TOOLS}) AS tools, lower(regexp_extract(content, '#\\s*quarry-context:\\s*(\\w+)', 1)) AS stated FROM mixed),
e AS (SELECT id, 0 AS place, 'path' AS method, by_path AS context, CASE WHEN by_path IN ('test', 'vendor', 'generated') THEN 0.98 ELSE 0.95 END::DOUBLE AS confidence, 0 AS inner_place FROM t WHERE by_path IS NOT NULL
  UNION ALL {_SCORES} UNION ALL SELECT id, 2, 'imports', 'test', 0.85, 0 FROM t WHERE tools
  UNION ALL SELECT id, 3, 'metadata', CASE WHEN stated IN {C.CONTEXTS} THEN stated WHEN contains(content, '# Generated by') THEN 'generated' ELSE 'vendor' END, CASE WHEN stated IN {C.CONTEXTS} THEN 1.0 ELSE 0.9 END, 0 FROM t
    WHERE stated IN {C.CONTEXTS} OR contains(content, '# Generated by') OR contains(content, '# Third-party')
  UNION ALL SELECT id, 4, 'project_context', 'vendor', 0.9, 0 FROM t WHERE contains(path, 'app/')),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, place, inner_place) AS n FROM e)
SELECT t.path, coalesce(context, 'production') AS context, round(CASE WHEN context = 'test' AND confidence < 0.8 THEN least(confidence + 0.3, 0.95) WHEN context = 'framework' AND confidence < 0.8 THEN least(confidence + 0.2, 0.95) ELSE coalesce(confidence, 0.5) END, 2) AS confidence,
  coalesce(method, 'default') || CASE WHEN context IN ('test', 'framework') AND confidence < 0.8 THEN '+intent_boost' ELSE '' END AS method FROM t LEFT JOIN b ON b.id = t.id AND n = 1""", ("mixed",))
def h6(mixed):
    return C.contexts(mixed, C.Project(vendor_dirs=("app/",), test_framework=True, framework=True))


_HAS = ", ".join("bool_or({}) AS has_{}".format(" OR ".join("contains(low, '{}')".format(w) for w in words), s) for s, (words, _) in C.SIGNALS.items())
_GAIN = " + ".join(f"CASE WHEN has_{s} THEN {gain} ELSE 0 END" for s, (_, gain) in C.SIGNALS.items())
_FRAMES = ", ".join(f"CASE WHEN has_{s} THEN '{s}' END" for s in C.SIGNALS)


@query("h1_module_checks", f"""WITH f AS (SELECT module, lower(content) AS low FROM mixed),
g AS (SELECT module, count(*) AS n, sum(length(low)) AS size, {_HAS}, bool_or({" OR ".join(f"contains(low, '{w}')" for w in C.FORCED)}) AS forced FROM f GROUP BY module),
c AS (SELECT *, 0.7 + {_GAIN} + CASE WHEN n > 5 THEN 0.02 ELSE 0 END AS sure FROM g),
d AS (SELECT *, round(least(CASE WHEN forced OR (n = 1 AND size < 500) THEN least(sure, 0.81) ELSE sure END, 0.95), 4)::DOUBLE AS confidence FROM c)
SELECT module, array_to_string(list_sort(list_filter(['security', {_FRAMES}, CASE WHEN n > 5 THEN 'architecture' END], lambda x: x IS NOT NULL)), ',') AS frames, confidence, confidence >= 0.82 AS skip FROM d""", ("mixed",))
def h1(mixed):
    return C.frames_for(mixed, "module").withColumn("frames", F.array_join("frames", ","))
