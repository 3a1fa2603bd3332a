"""Operators on findings: suppression, baselines, de-duplication, ranking, status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scores import severity_rank
from quarry.functions.text import glob_regex

# Fixed values, in the order in which they are tried.
VULNERABILITY_CLASSES = (
    ("sql", "SQL_INJECTION"), ("sqli", "SQL_INJECTION"), ("injection", "INJECTION"), ("xss", "XSS"),
    ("cmd", "COMMAND_INJECTION"), ("command", "COMMAND_INJECTION"), ("path", "PATH_TRAVERSAL"), ("traversal", "PATH_TRAVERSAL"),
    ("ssrf", "SSRF"), ("deserialization", "DESERIALIZATION"), ("pickle", "DESERIALIZATION"), ("yaml", "DESERIALIZATION"),
    ("eval", "CODE_EXECUTION"), ("exec", "CODE_EXECUTION"), ("rce", "CODE_EXECUTION"), ("ssti", "TEMPLATE_INJECTION"),
    ("template", "TEMPLATE_INJECTION"), ("hardcoded", "HARDCODED_SECRET"), ("secret", "HARDCODED_SECRET"), ("password", "HARDCODED_SECRET"),
    ("credential", "HARDCODED_SECRET"), ("taint", "TAINT_FLOW"), ("division", "DIVISION_BY_ZERO"), ("zero", "DIVISION_BY_ZERO"),
)


def vulnerability_class(rule: Column, message: Column) -> Column:
    """The first keyword in the rule's name, then in the message, else the rule itself."""
    tries = [F.when(F.lower(c).contains(k), F.lit(v)) for c in (rule, message) for k, v in VULNERABILITY_CLASSES]
    return F.coalesce(*tries, rule)


def split_location(location: Column) -> tuple[Column, Column]:
    """Path and line, parted at the last colon; what is no number leaves the whole and 0."""
    pattern = r"^(.*):([+-]?\d+)$"
    ok = location.rlike(pattern)
    return F.when(ok, F.regexp_extract(location, pattern, 1)).otherwise(location), F.when(ok, F.regexp_extract(location, pattern, 2).cast("int")).otherwise(0)


def suppress_globals(findings: DataFrame, rules: list[str], globs: list[str]) -> DataFrame:
    out = findings.where(~F.col("rule_id").isin(*rules)) if rules else findings
    return reduce(lambda df, g: df.where(~F.col("path").rlike(glob_regex(g))), globs, out)


def entry_matches(entry: dict, rule: Column, path: Column, line: Column) -> Column:
    """One suppression entry: no rules means all; an exact path or a glob decides; else the line; else everything.

    A plain path that differs does not decide: an entry with path and line can match another file by its line.
    """
    if not entry.get("enabled", True):
        return F.lit(False)
    by_rule = rule.isin(*entry["rules"]) if entry.get("rules") else F.lit(True)
    file, at = entry.get("file"), entry.get("line")
    rest = (line == at) if at is not None else F.lit(file is None)
    if file and ("*" in file or "?" in file):
        return by_rule & path.rlike(glob_regex(file))
    return by_rule & ((F.lit(True) & (path == file)) | rest if file else rest)


def suppress_entries(findings: DataFrame, entries: list[dict]) -> DataFrame:
    hit = reduce(Column.__or__, [entry_matches(e, F.col("rule_id"), F.col("path"), F.col("line")) for e in entries])
    return findings.where(~F.coalesce(hit, F.lit(False)))


def suppression_reason(findings: DataFrame, rules: list[str], globs: list[str], entries: list[dict]) -> DataFrame:
    """Adds the first tier that suppresses a finding: a global rule, an ignored file, an entry's reason; null if none."""
    tiers = [F.when(F.col("rule_id").isin(*rules), F.lit("global rule"))]
    tiers += [F.when(F.col("path").rlike(glob_regex(g)), F.lit("ignored file")) for g in globs]
    tiers += [F.when(entry_matches(e, F.col("rule_id"), F.col("path"), F.col("line")), F.lit(e.get("reason", "entry"))) for e in entries]
    return findings.withColumn("reason", F.coalesce(*tiers))


def suppress_learned(findings: DataFrame, patterns: DataFrame, confidence: float = 0.8) -> DataFrame:
    """Drops findings that a false-positive pattern (rule, path_part, message_part; empty matches all) is sure of.

    Patterns with a rule meet findings by key; only those for any rule, a short list, are tried on all.
    """
    sure = patterns.where((F.col("confidence") >= confidence) & (F.col("kind") == "false_positive")).select(F.col("rule").alias("p_rule"), "path_part", "message_part")
    test = ((F.col("path_part") == "") | F.contains("path", "path_part")) & ((F.col("message_part") == "") | F.contains("message", "message_part"))
    keyed = findings.join(sure.where("p_rule <> ''"), (F.col("rule_id") == F.col("p_rule")) & test, "left_anti")
    return keyed.join(sure.where("p_rule = ''"), test, "left_anti")


def apply_baseline(findings: DataFrame, baseline: DataFrame, key: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """What is new, and what the baseline holds."""
    known = baseline.select(key).distinct()
    return findings.join(known, key, "left_anti"), findings.join(known, key, "left_semi")


def filter_changed_lines(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Files that the diff does not name pass, as do findings on line 0; the rest must stand on a changed line."""
    files = changed.select(F.col("path").alias("c_path")).distinct()
    named = findings.join(files, F.col("path") == F.col("c_path"), "left")
    spots = changed.select(F.col("path").alias("s_path"), F.col("line").alias("s_line")).distinct()
    met = named.join(spots, (F.col("path") == F.col("s_path")) & (F.col("line") == F.col("s_line")), "left")
    return met.where(F.col("c_path").isNull() | (F.col("line") == 0) | F.col("s_path").isNotNull()).drop("c_path", "s_path", "s_line")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def dedup_findings(findings: DataFrame, reach: int = 3) -> DataFrame:
    """Greedy de-duplication in order of `seq`, within each file.

    A finding with the line and rule of one that was kept before takes its place if it is strictly more severe, else
    goes. Any other goes if a kept one of its class stands within `reach` lines, unless it is strictly more severe:
    then that one goes, and the new one is kept at its own line, as the last of its class. Findings without a path stay.
    The fold depends on order and is not transitive, so it runs in order over the rows of one segment: lines of a file
    that are at most `reach` apart from line to line. No two segments can touch each other. Numbers in `seq` may repeat:
    such rows follow in the order of their other columns. A task holds a segment's kept findings, not its rows.
    """
    cls, rank, segment = (next(n for n in (f"{'_' * k}{name}" for k in range(9)) if n not in findings.columns) for name in ("cls", "rank", "segment"))
    line, message = F.coalesce("line", F.lit(0)), F.coalesce("message", F.lit(""))
    keyed = findings.where("path is not null").withColumn(cls, vulnerability_class(F.col("rule_id"), message)).withColumn(rank, severity_rank(F.coalesce("severity", F.lit("low"))))
    # segments come from a file's different lines only
    at = Window.partitionBy("of").orderBy("at")
    lines = findings.where("path is not null").select(F.col("path").alias("of"), line.alias("at")).distinct()
    starts = lines.withColumn("new", F.coalesce((F.col("at") - F.lag("at").over(at) > reach).cast("int"), F.lit(0)))
    parted = starts.select("of", "at", F.sum("new").over(at).alias(segment))
    placed = keyed.join(parted, (F.col("path") == F.col("of")) & (line == F.col("at"))).select(*findings.columns, cls, rank, segment)
    names = findings.columns

    def fold(batches):
        import pyarrow as pa

        def emit(done):
            of: dict[int, tuple] = {}
            for batch, i in done:
                of.setdefault(id(batch), (batch, []))[1].append(i)
            for batch, at in of.values():
                yield batch.take(pa.array(at)).select(names)

        now, kept, by_class = None, {}, {}  # (line, rule) -> [rank, batch, row]; class -> [(line, rule)] in order
        for batch in batches:
            done = []
            paths, segments, ats, rules, classes, ranks = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", segment, "line", "rule_id", cls, rank))
            for i, here in enumerate(zip(paths, segments)):
                if here != now:
                    done += [(x[1], x[2]) for x in kept.values()]
                    now, kept, by_class = here, {}, {}
                key, own = (ats[i] or 0, rules[i]), by_class.setdefault(classes[i], [])
                if key in kept:
                    if ranks[i] > kept[key][0]:
                        kept[key] = [ranks[i], batch, i]
                    continue
                near = next((k for k in own if abs(k[0] - key[0]) <= reach), None)
                if near is not None:
                    if ranks[i] <= kept[near][0]:
                        continue
                    del kept[near]
                    own.remove(near)
                own.append(key)
                kept[key] = [ranks[i], batch, i]
            yield from emit(done)
        yield from emit([(x[1], x[2]) for x in kept.values()])

    chosen = placed.repartition("path", segment).sortWithinPartitions("path", segment, "seq", *[c for c in names if c != "seq"]).mapInArrow(fold, findings.schema)
    return chosen.unionByName(findings.where("path is null"))


def aggregate_frames(frames: DataFrame) -> DataFrame:
    s = F.lower("status")
    return frames.agg(
        F.count_if(s.isin("passed", "warning")).alias("passed"),
        F.count_if(s.isin("failed", "error", "timeout")).alias("failed"),
        F.count_if(~s.isin("passed", "warning", "failed", "error", "timeout")).alias("skipped"),
        F.sum("findings").alias("findings"),
    )


def overcrowded(findings: DataFrame, most: int = 50) -> DataFrame:
    """Findings of files with `most` findings or fewer."""
    return findings.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("path"))).where(F.col("__n") <= most).drop("__n")


def risk_ordered(findings: DataFrame, churn: DataFrame) -> DataFrame:
    """Adds risk = severity x (1 + ln(1 + churn) / 5); an unknown severity counts as medium."""
    joined = findings.join(churn, "path", "left")
    return joined.withColumn("risk", severity_rank(F.col("severity"), 2) * (1 + F.log1p(F.coalesce("churn", F.lit(0))) * 0.2)).drop("churn")


def evicted(entries: DataFrame, at: str, key: str, most: int) -> DataFrame:
    """A cache after eviction: with over `most` entries, the newest four fifths of `most` stay (ties by key), else all."""
    if len(entries.select(key).limit(most + 1).collect()) <= most:
        return entries
    return entries.orderBy(F.desc(at), key).limit(most * 4 // 5)


def nearest_function(targets: DataFrame, functions: DataFrame) -> DataFrame:
    """Adds number: the function (path, number, first, last) of the target's file that encloses or is nearest to its line.

    Ties go to the first by number; targets in files without functions go. A file's functions are one array, one entry for
    those that begin and end alike, and each different line of a file meets it once, however many targets are there.
    """
    alike = functions.groupBy("path", "first", "last").agg(F.min(F.struct("number")).alias("least"))
    per = alike.groupBy("path").agg(F.collect_list(F.struct("first", "last", "least.number")).alias("of"))
    apart = F.transform("of", lambda f: F.struct(F.greatest(f["first"] - F.col("line"), F.col("line") - f["last"], F.lit(0)).alias("apart"), f["number"].alias("number")))
    met = targets.select("path", "line").distinct().join(per, "path").select(F.col("path").alias("__path"), F.col("line").alias("__line"), F.array_min(apart)["number"].alias("number"))
    return targets.join(met, (F.col("path") == F.col("__path")) & F.col("line").eqNullSafe(F.col("__line"))).drop("__path", "__line")


def module_debt(current: DataFrame, baseline: DataFrame, debt: DataFrame) -> DataFrame:
    """module, findings, new_debt, resolved_debt, total_debt of every module with current findings.

    All have module and fingerprint. A current finding outside the baseline and the debt is new debt, row by row; debt
    that no current finding shows is resolved; the total is the debt that stays and the new.
    """
    known = baseline.select("module", "fingerprint").distinct().withColumn("known", F.lit(True))
    held = debt.select("module", "fingerprint").distinct().withColumn("held", F.lit(True))
    rows = current.groupBy("module", "fingerprint").agg(F.count(F.lit(1)).alias("n")).join(known, ["module", "fingerprint"], "left").join(held, ["module", "fingerprint"], "full_outer")
    fresh = F.col("n").isNotNull() & F.col("known").isNull() & F.col("held").isNull()
    per = rows.groupBy("module").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("findings"),
        F.coalesce(F.sum(F.when(fresh, F.col("n"))), F.lit(0)).alias("new_debt"),
        F.count_if(F.col("n").isNull() & F.col("held")).alias("resolved_debt"),
        F.count_if(F.col("n").isNotNull() & F.coalesce("held", F.lit(False))).alias("stays"),
    )
    return per.where("findings > 0").select("module", "findings", "new_debt", "resolved_debt", (F.col("stays") + F.col("new_debt")).alias("total_debt"))


def with_first_flow(findings: DataFrame, flows: DataFrame, reach: int = 3) -> DataFrame:
    """Findings (rule_id, path, line, ...) with `flow` and `vulnerability_class` of the first flow that starts or ends near them.

    Flows have path, position, source, source_line, sink, sink_line; first is by position, near is within `reach` lines. `flow` has
    position, source and sink with their lines, and is null without one, or for line 0. The class is the middle of a
    rule's name of three words or more. Both ends of a flow meet findings by blocks of lines.
    """
    size = reach + 1
    named = lambda n: F.concat(F.col(n), F.lit(" (line "), F.col(f"{n}_line").cast("string"), F.lit(")"))
    ends = flows.select("path", F.struct("position", named("source").alias("source"), named("sink").alias("sink")).alias("flow"), F.explode(F.array("source_line", "sink_line")).alias("at")).withColumn("block", F.floor(F.col("at") / size))
    asked = findings.select("path", "line").where("line > 0").distinct().withColumn("block", F.explode(F.array(*[F.floor(F.col("line") / size) + k for k in (-1, 0, 1)])))
    near = asked.join(ends, ["path", "block"]).where(F.abs(F.col("at") - F.col("line")) <= reach).groupBy("path", "line").agg(F.min("flow").alias("flow"))
    parts = F.split("rule_id", "-")
    middle = F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 2), "-")).otherwise("unknown")
    return findings.join(near, ["path", "line"], "left").withColumn("vulnerability_class", F.when(F.col("flow").isNotNull(), middle))
