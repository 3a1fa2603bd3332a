"""Queries without SQL, held against brute force over all their rows."""

import os
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import findings as O
from quarry.plans import catalog, more
from quarry.plans.carriers import carrier
from tests.test_operators import RANK, sequential_dedup

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_d1_folds_all_findings(spark):
    df = carrier(spark, SF, "findings").withColumn("cls", O.vulnerability_class(F.col("rule_id"), F.col("message")))
    columns = [c for c in df.columns if c not in ("seq", "cls")]
    key = lambda r: (r["seq"], [(r[c] is not None, r[c]) for c in columns])
    rows = [(r["path"], r["line"], r["rule_id"], r["cls"], RANK.get(r["severity"], 1), (r["seq"], r["path"], r["line"], r["severity"])) for r in sorted(df.collect(), key=key)]
    got = catalog.queries()["d1_dedup"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(sequential_dedup(rows))


def test_j20_matches_all_pairs(spark):
    consumers = ["fetchUserOrderItem", "getColourTable", "getItem1", "deleteItem12", "runReport", "computeTotals", "get", "", "createInvoice", "findXInvoice"]
    providers = ["fetchOurOrderItem", "getColorTable", "loadItem12", "removeItem1", "getReportRun", "recomputeTotals", "deleteInvoice", "invoices", "list", "addInvoices"]
    names = spark.createDataFrame([(n,) for n in [*consumers, *providers]], "name string")
    of = {r[0]: (r[1].lower(), r[2]) for r in names.select("name", text.operation_stem(F.col("name")), text.verb_class(F.col("name"))).collect()}
    want = []
    for c in consumers:
        best = []
        for p in providers:
            if of[c][1] and of[p][1] and of[c][1] != of[p][1]:
                continue
            ratio = SequenceMatcher(None, of[c][0], of[p][0]).ratio()
            if ratio >= 0.8:
                best.append((-ratio, p))
        if best:
            want.append((c, min(best)[1], round(-min(best)[0], 6)))
    got = more.j20(names.where(F.col("name").isin(*consumers)), names.where(F.col("name").isin(*providers)))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {("getColourTable", "getColorTable"), ("fetchUserOrderItem", "fetchOurOrderItem"), ("computeTotals", "recomputeTotals")} <= {w[:2] for w in want}


def pairwise_blocks(content):
    """Every pair of places, line by line."""
    rows = content.split("\n")

    def similar(x, y):
        x, y = x.strip(), y.strip()
        return bool(x and y) and not x.startswith(("#", "//")) and not y.startswith(("#", "//")) and SequenceMatcher(None, x, y).ratio() >= 0.8

    out, done = [], set()
    for i in range(len(rows)):
        for j in range(i + 3, len(rows)):
            n = 0
            while (i, j) not in done and i + n < j and j + n < len(rows) and similar(rows[i + n], rows[j + n]):
                n += 1
            if n >= 3:
                out.append((i + 1, j + 1, n))
                done |= {(i + k, j + k) for k in range(n)}
    return sorted(out)


def test_line_blocks_match_every_pair_of_places(spark):
    import random

    from quarry.operators.similarity import line_blocks, similar_lines

    rnd = random.Random(9)
    near = ["".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, 12))) for _ in range(60)]
    near = sorted(set(near + [t[:-1] + "z" for t in near] + [t + "x" for t in near]))
    want = {(i, j) for i, a in enumerate(near) for j, b in enumerate(near) if SequenceMatcher(None, a, b).ratio() >= 0.8}
    assert similar_lines(near, 0.8) == want and len(want) > len(near)
    rnd = random.Random(2)
    pool = ["total = total + price", "total = total + prices", "print(total)", "print (total)", "}", "", "# note", "return compute(total, tax)", "x"]
    texts = ["\n".join(rnd.choice(pool) for _ in range(n)) for n in (0, 1, 5, 20, 40, 60)] + ["\n".join(["a = 1", "b = 2", "c = 3"] * 4), "\n".join(["same"] * 13), "A\nB\nC\nq\nA\nz\nA\nB\nC"]
    got = line_blocks(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("none", None)], "path string, content string")).collect()
    want = [(str(i), *b) for i, t in enumerate(texts) for b in pairwise_blocks(t)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20


def test_halstead_counts_operators_and_operands(spark):
    from math import log2

    from quarry.sources.python_ast import halstead

    code = [("a", "x = a + b * 2\ny = a and not b or x < 2"), ("b", "pass"), ("c", "def ("), ("d", "a << b | c")]
    got = {r["path"]: r for r in halstead(spark.createDataFrame(code, "path string, content string")).collect()}
    # a: + * and not or < once each; x a b 2 y, and a b x 2 again
    assert set(got) == {"a", "d"}
    assert (got["a"]["vocabulary"], got["a"]["length"]) == (6 + 5, 6 + 9)
    assert got["a"]["volume"] == pytest.approx(15 * log2(11)) and got["a"]["difficulty"] == pytest.approx(3 * 9 / 5)
    assert got["d"]["vocabulary"] == 3 and got["d"]["difficulty"] == 0


def test_timeouts_skip_comments_and_see_the_limit(spark):
    from quarry.operators.line_checks import timeout_findings

    text = "REQUESTS.get(u)\n# requests.get(u)\nrequests.get(u, timeout=1)\n&http.Client{}\n&http.Client{ Timeout: 3}\naiohttp.ClientSession()\nhttp.Get(u)"
    got = timeout_findings(spark.createDataFrame([("f", "go", text)], "path string, language string, content string")).collect()
    assert {(r["line"], r["rule_id"]) for r in got} == {(1, "timeout-requests"), (4, "timeout-go-client"), (6, "timeout-aiohttp"), (7, "timeout-go-http")}
    assert {r["severity"] for r in got} == {"high"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_w4_packs_units_in_order(spark):
    want = []
    for r in carrier(spark, SF, "code").collect():
        chunk, used = 0, 4
        for line, text_ in enumerate(r["content"].split("\n"), 1):
            tokens = len(text_) // 4
            if tokens < 1:
                continue
            if used > 4 and used + tokens > 20:
                chunk, used = chunk + 1, 4
            used += tokens
            want.append((r["path"], line, tokens, chunk))
    got = catalog.queries()["w4_packed_chunks"](spark, SF).select("path", "line", "tokens", "chunk").collect()
    assert sorted(map(tuple, got)) == sorted(want) and max(w[3] for w in want) > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_x9_is_the_sequence_ratio(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").collect()
    want = {r["p_partkey"]: round(SequenceMatcher(None, r["p_name"], r["p_type"].lower()).ratio(), 6) for r in parts}
    got = catalog.queries()["x9_line_similarity"](spark, SF).collect()
    assert {r["p_partkey"]: r["ratio"] for r in got} == pytest.approx(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("most,wait", [(3, 300), (1, 100_000)])
def test_st8_replays_every_request(spark, most, wait):
    from quarry.streaming import lifecycle

    want, now = [], {}  # provider -> (failures in a row, when it opened or None)
    requests = carrier(spark, SF, "requests")
    rows = requests.selectExpr("provider", "seq", "unix_micros(cast(ts AS timestamp)) / 1e6 AS at", "ok").collect()
    for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
        failures, opened = now.get(r["provider"], (0, None))
        if opened is not None and r["at"] - opened < wait:
            want.append((r["provider"], r["seq"], "open", False))
            continue
        failures = 0 if r["ok"] else failures + 1
        again = not r["ok"] and (opened is not None or failures >= most)
        now[r["provider"]] = (failures, r["at"] if again else None)
        want.append((r["provider"], r["seq"], "open" if again else "closed", True))
    got = lifecycle.replay_breakers(requests, most, wait).select("provider", "seq", "state", "allowed").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert most == 3 or {w[3] for w in want} == {True, False}
